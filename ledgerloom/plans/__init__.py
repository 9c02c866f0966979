"""Whole runs: the filings pipeline, its command line and the query catalogue."""
