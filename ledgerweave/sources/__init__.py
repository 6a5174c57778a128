"""Reading, writing and streaming ledger tables."""
