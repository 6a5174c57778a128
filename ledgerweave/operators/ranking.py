"""Top-n reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_holders(accounts: DataFrame, balance: str, ident: str, n: int) -> DataFrame:
    """The n largest balances, lowest id first among equals."""
    return accounts.orderBy(F.col(balance).desc(), F.col(ident).asc()).limit(n)


def latest_per_account(
    tx: DataFrame, key: str, order: Sequence[Column], n: int, out: str = "rank"
) -> DataFrame:
    """The first n rows per account in ``order``. Each map task keeps only n rows per
    account before the shuffle, so an account with very many rows is no burden."""
    window = Window.partitionBy(key).orderBy(*order)
    return tx.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)
