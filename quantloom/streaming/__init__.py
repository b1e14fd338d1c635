"""Structured Streaming forms of bar building and of the ledger."""
