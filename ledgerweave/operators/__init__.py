"""Batch operators over ledger tables."""
