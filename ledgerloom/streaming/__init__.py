"""Structured Streaming over incoming filings."""
