"""Column expressions used inside the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST_LENGTH = 64  # hex digits of a SHA-256


def digest(column: str | Column) -> Column:
    """SHA-256 of the value's text, as lower-case hex."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sha2(column.cast("string"), 256)


def with_shard(df: DataFrame, id_col: str, depth: int, out: str = "shard") -> DataFrame:
    """Shard = the first ``depth`` hex digits of the id's digest."""
    return df.withColumn(out, F.substring(digest(id_col), 1, depth))


def to_units(column: str | Column, scale: int) -> Column:
    """Exact money with 38 digits, ``scale`` of them after the point.

    Cast before summing: floating sums depend on row order. Sums keep 38 digits too.
    """
    column = F.col(column) if isinstance(column, str) else column
    return column.cast(f"decimal(38,{scale})")


def base_units(column: str | Column, scale: int) -> Column:
    """Money as a whole number of its smallest unit, as ``decimal(38,0)``.

    Exact for all amounts whose number of units has 38 digits or fewer; ``scale`` is at most 18.
    The whole part and the rest are multiplied apart, as one product would need more digits than
    a decimal has.
    """
    if not 0 <= scale <= 18:
        raise ValueError("scale must be between 0 and 18")
    amount = to_units(column, scale)
    if scale == 0:
        return amount.cast("decimal(38,0)")
    factor = F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    whole = F.when(amount < 0, F.ceil(amount)).otherwise(F.floor(amount))
    rest = (amount % F.lit(1).cast("decimal(1,0)")).cast(f"decimal({scale + 1},{scale})")
    units = (rest * factor).cast(f"decimal({scale + 1},0)")
    return ((whole.cast(f"decimal({39 - scale},0)") * factor).cast("decimal(38,0)") + units).cast(
        "decimal(38,0)"
    )


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch (session timezone UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def block_day(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.to_date(column)


def time_bucket(column: str | Column, width: str) -> Column:
    """Start of the tumbling bucket that holds a time."""
    return F.window(column, width).getField("start")


def json_field(column: str | Column, path: str) -> Column:
    return F.get_json_object(column, path)


def variant_field(column: str | Column, path: str, kind: str) -> Column:
    return F.variant_get(F.parse_json(column), path, kind)


def hex_form(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.hex(column.cast("string"))


def base64_form(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.base64(column.cast("string").cast("binary"))


def json_entries(column: str | Column, value_type: str = "string") -> Column:
    """A flat JSON object as an array of ``struct<key, value>``."""
    return F.map_entries(F.from_json(column, f"map<string,{value_type}>"))
