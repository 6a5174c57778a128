"""Ledger analytics as Spark jobs: accounts, transactions, messages, blocks and streams."""

from ledgerweave.session import tuned_session
from ledgerweave.sources.ledger import Ledger, load_ledger

__all__ = ["Ledger", "load_ledger", "tuned_session"]
