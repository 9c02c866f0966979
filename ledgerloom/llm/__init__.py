"""Training-data operators: deduplication, scoring, scanning, filtering, mixing and sharding of corpora."""
