"""Ready-made queries over the given tables, each with a SQL twin where SQL can say it."""

from ledgerweave.plans import (
    accounts, chains, flows, graphs, layouts, places, python_side, streams, streams_more,
)
from ledgerweave.plans.registry import Plan, all_plans

__all__ = [
    "Plan",
    "accounts",
    "all_plans",
    "chains",
    "flows",
    "graphs",
    "layouts",
    "places",
    "python_side",
    "streams",
    "streams_more",
]
