"""Amounts of several currencies: maps from a currency's id to whole units."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 20  # of the lower limb
_LIMB = 10**DIGITS


def _whole(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def _limb() -> Column:
    return F.lit(Decimal(_LIMB)).cast(f"decimal({DIGITS + 1},0)")


def _high(amount: Column) -> Column:
    return ((amount - _low(amount)).cast("decimal(38,0)") / _limb()).cast("decimal(38,0)")


def _low(amount: Column) -> Column:
    return (amount % _limb()).cast("decimal(38,0)")


def exact_sum(high: Column, low: Column) -> Column:
    """The digits of ``high * 10^20 + low``, of any sign each, as text."""
    carried = high + _high(low)
    rest = _low(low)
    # both parts get the sign of the whole
    borrow = F.when((carried > 0) & (rest < 0), -1).when((carried < 0) & (rest > 0), 1).otherwise(0)
    upper = (carried + borrow).cast("decimal(38,0)")
    lower = (rest - borrow * _limb()).cast("decimal(38,0)")
    sign = F.when((upper < 0) | (lower < 0), "-").otherwise("")
    text = lambda x: F.abs(x).cast("string")
    return F.concat(
        sign,
        F.when(upper == 0, text(lower)).otherwise(
            F.concat(text(upper), F.lpad(text(lower), DIGITS, "0"))
        ),
    )


def currency_totals(df: DataFrame, keys: Sequence[str], amounts: str) -> DataFrame:
    """``keys, currency, n, total``: per key and currency how many amounts there are, and their
    exact sum as text, whatever number of digits it has.

    ``amounts`` is a map from currency to a whole amount of up to 38 digits. Amounts are added up
    in two limbs of 20 digits, so that no sum overflows below 10^18 rows. Null maps and null
    amounts add nothing; null keys are keys like others. Maps are taken apart where they lie, and
    one row a currency and key is what is shuffled.
    """
    flat = df.select(*keys, F.explode(amounts).alias("currency", "_amount")).filter("_amount is not null")
    amount = _whole("_amount")
    sums = flat.groupBy(*keys, "currency").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_high(amount)).alias("_high"),
        F.sum(_low(amount)).alias("_low"),
    )
    return sums.select(*keys, "currency", "n", exact_sum(F.col("_high"), F.col("_low")).alias("total"))


def currency_maps(df: DataFrame, keys: Sequence[str], amounts: str) -> DataFrame:
    """``keys, totals``: the ``currency_totals`` of each key as one map, in order of currency. Keys of
    whose maps nothing is left are not given."""
    entries = F.sort_array(F.collect_list(F.struct("currency", "total")))
    totals = currency_totals(df, keys, amounts)
    return totals.groupBy(*keys).agg(F.map_from_entries(entries).alias("totals"))
