"""Operators over filings, chunks, summaries and vectors."""
