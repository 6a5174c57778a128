"""Shards as binary prefixes of the digest, of any length, and their changes in time.

A prefix of n bits holds the digests of one interval. The places where intervals begin and end cut
the whole range into segments; a segment has one most specific prefix, or none. Accounts then find
their segment in one sorted sweep over accounts and segments, whatever lengths are in use; nothing
is joined once a length. Sweeps run within the first hex digits of the digest, so that they are
spread evenly, and a place with very many rows is cut like every ordered key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import DIGEST_LENGTH, digest
from ledgerweave.operators.hotkeys import MIN_SLICE_ROWS, KeyedOrder
from ledgerweave.operators.temporal import state_as_of_each
from ledgerweave.session import written

BITS = 4 * DIGEST_LENGTH
AREA_DIGITS = 2  # hex digits within which a sweep runs: 256 areas
_WORD = 64  # bits turned into hex digits at once


def _hex(bits: Column) -> Column:
    """256 binary digits as 64 hex digits."""
    words = [
        F.lpad(F.lower(F.conv(F.substring(bits, 1 + at, _WORD), 2, 16)), _WORD // 4, "0")
        for at in range(0, BITS, _WORD)
    ]
    return F.concat(*words)


def _filled(bits: Column) -> Column:
    return F.rpad(bits, BITS, "0")


def _after(bits: Column) -> Column:
    """Where the next prefix of this length begins; null after the last one."""
    return F.when(F.contains(bits, F.lit("0")), F.regexp_replace(bits, "01*$", "1"))


def _checked(shards: DataFrame, prefix: str) -> DataFrame:
    """``_bits``: the different prefixes; null is none, anything else but 0 and 1 an error."""
    bits = F.col(prefix)
    good = F.when(
        bits.rlike(f"^[01]{{0,{BITS}}}$"), bits
    ).otherwise(F.raise_error(F.concat(F.lit("no binary prefix: "), bits)))
    return shards.filter(bits.isNotNull()).select(good.alias("_bits")).distinct()


def _lengths(known: DataFrame) -> list[int]:
    rows = known.select(F.length("_bits").alias("n")).distinct().collect()  # 257 at most
    return sorted(row["n"] for row in rows)


def _breaks(known: DataFrame) -> DataFrame:
    """``_at, _full``: the places where a prefix begins or ends and where areas begin."""
    spark = known.sparkSession
    ends = F.explode(F.array(F.col("_bits"), _after(F.col("_bits")))).alias("_bits")
    areas = spark.range(16**AREA_DIGITS).select(
        F.lpad(F.bin("id"), 4 * AREA_DIGITS, "0").alias("_bits")
    )
    full = known.select(ends).filter("_bits is not null").unionByName(areas)
    return (
        full.select(_filled(F.col("_bits")).alias("_full"))
        .distinct()
        .select(_hex(F.col("_full")).alias("_at"), "_full")
    )


def _covering(breaks: DataFrame, known: DataFrame) -> DataFrame:
    """``_at, _bits`` of each prefix that holds a break's place. There are as many breaks as
    shards and areas, few beside accounts, so these may be joined once a length."""
    lengths = F.array(*[F.lit(n) for n in _lengths(known)]).cast("array<int>")
    probes = breaks.withColumn("_n", F.explode(lengths)).select(
        "_at", F.expr("substring(_full, 1, _n)").alias("_bits")
    )
    return probes.join(known, "_bits")


def _segments(known: DataFrame) -> DataFrame:
    """``_at, shard, n_covering``: where each segment begins, its most specific prefix (null for
    none) and how many prefixes hold it."""
    breaks, _ = written(_breaks(known), "shard-breaks")
    owners = (
        _covering(breaks, known)
        .groupBy("_at")
        .agg(
            F.max_by("_bits", F.length("_bits")).alias("shard"),
            F.count(F.lit(1)).alias("n_covering"),
        )
    )
    return breaks.join(owners, "_at", "left").select(
        "_at", "shard", F.coalesce("n_covering", F.lit(0)).cast("long").alias("n_covering")
    )


def shard_segments(
    shards: DataFrame, prefix: str, min_slice_rows: int = MIN_SLICE_ROWS
) -> DataFrame:
    """``first, last, shard, n_covering``: the whole range of digests in consecutive segments.

    ``first`` and ``last`` are hex digests, both included. A gap is a segment whose ``shard`` is null,
    an overlap one with ``n_covering`` over 1. Neighbours of one shard and number are one segment.
    """
    spark = shards.sparkSession
    found, _ = written(_segments(_checked(shards, prefix).transform(_kept)), "shard-segments")
    closing = spark.createDataFrame([("g", None, -1)], "_at string, shard string, n_covering long")
    rows = found.unionByName(closing)  # after all digits: the end of the range
    state = F.struct("shard", "n_covering")
    ordered = KeyedOrder(rows, [], ["_at"], (), min_slice_rows)
    ordered = ordered.last("_before", F.struct(state.alias("state")), inclusive=False)
    changed = F.col("_before").isNull() | ~F.col("_before.state").eqNullSafe(state)
    starts = ordered.done().filter(changed).select("_at", "shard", "n_covering")
    starts, _ = written(starts, "shard-starts")
    ordered = KeyedOrder(starts, [], ["_at"], (), min_slice_rows)
    ordered = ordered.last("_segment", F.struct("_at", "shard", "n_covering"), inclusive=False)
    # the last digest before a place: its own, less one in the last of the digits that count
    return (
        ordered.done()
        .filter("_segment is not null")
        .select(
            F.col("_segment._at").alias("first"),
            _before(F.col("_at")).alias("last"),
            F.col("_segment.shard").alias("shard"),
            F.col("_segment.n_covering").alias("n_covering"),
        )
    )


def _kept(known: DataFrame) -> DataFrame:
    return written(known, "shard-prefixes")[0]


def _before(at: Column) -> Column:
    """The digest just before a place; places end in zeros but for the end of the range."""
    head = F.regexp_replace(at, "0*$", "")
    last = F.right(head, F.lit(1))
    digits = F.lit("0123456789abcdef")
    lower = F.substr(digits, F.position(last, digits) - 1, F.lit(1))
    short = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), lower)
    return F.when(at == "g", F.lit("f" * DIGEST_LENGTH)).otherwise(
        F.rpad(short, DIGEST_LENGTH, "f")
    )


def assign_most_specific(
    accounts: DataFrame,
    shards: DataFrame,
    id_col: str,
    prefix_col: str,
    hashed: bool = True,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Each account with ``shard``, the longest binary prefix that its digest starts with, and
    ``n_covering``, how many prefixes that are.

    Accounts in a gap have a null shard and 0. Prefixes are texts of up to 256 digits 0 and 1, the
    empty one holding everything; equal ones count once, null is none. ``hashed=False`` takes
    ``id_col`` itself as the digest; what is not 64 lower-case hex digits is in no shard, as is a null
    id. Columns of ``accounts`` called like the new ones are replaced.
    """
    known = _kept(_checked(shards, prefix_col))
    found, _ = written(_segments(known), "shard-segments")
    return _swept(accounts, found, id_col, hashed, ["shard", "n_covering"], min_slice_rows).withColumn(
        "n_covering", F.coalesce("n_covering", F.lit(0)).cast("long")
    )


def _swept(
    accounts: DataFrame, segments: DataFrame, id_col: str, hashed: bool, values: list[str],
    min_slice_rows: int,
) -> DataFrame:
    """Accounts with the values of the segment that holds their digest."""
    full = digest(id_col) if hashed else F.col(id_col)
    if not hashed:
        full = F.when(full.rlike(f"^[0-9a-f]{{{DIGEST_LENGTH}}}$"), full)
    area = lambda at: F.substring(at, 1, AREA_DIGITS)
    records = segments.select(area("_at").alias("_area"), F.col("_at"), *values)
    bare = accounts.drop(*values)
    probes = bare.withColumn("_digest", full).withColumn("_area", area("_digest"))
    placed = state_as_of_each(
        records, probes, "_area", "_at", "_digest", [], values, min_slice_rows
    )
    return placed.select(*bare.columns, *values)


def assign_shard_at(
    probes: DataFrame,
    shards: DataFrame,
    id_col: str,
    time_col: str,
    prefix_col: str,
    from_col: str,
    until_col: str,
    hashed: bool = True,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Each probe with ``shard`` and ``shard_since``: the prefix that held its digest at its time.

    ``shards`` has a row for each prefix and time it was valid, from ``from_col`` to just before
    ``until_col`` (null: still). A split ends one prefix and begins two longer ones, a merge the
    other way round. The range is cut at all places where any prefix begins or ends; a first sweep
    finds each probe's segment, a second one, by time within segments, what was begun there last.
    A segment has a row for each prefix that ever held it: together as many as shards, times the
    splits that followed them.

    Of prefixes that hold one place at one time, that which began last counts (of those that began
    together, the longest); if it has ended, there is none. So histories in which each place has
    one shard at a time are answered exactly. Probes without id, time or shard have nulls. Rows of
    ``shards`` without prefix or beginning are nothing.
    """
    rows = shards.filter(F.col(prefix_col).isNotNull() & F.col(from_col).isNotNull())
    known = _kept(_checked(rows, prefix_col))
    breaks, _ = written(_breaks(known), "shard-breaks")
    held = _covering(breaks, known).join(
        rows.select(
            F.col(prefix_col).alias("_bits"), F.col(from_col).alias("_from"), F.col(until_col).alias("_until")
        ),
        "_bits",
    )
    versions, _ = written(
        held.select("_at", "_bits", "_from", "_until", F.length("_bits").alias("_depth")), "shard-versions"
    )
    places = breaks.select("_at", F.col("_at").alias("_segment"))
    placed = _swept(probes, places, id_col, hashed, ["_segment"], min_slice_rows)
    found = state_as_of_each(
        versions.withColumnRenamed("_at", "_segment"), placed, "_segment", "_from", time_col, ["_depth"],
        ["_bits", "_until"], min_slice_rows,
    )
    valid = F.col("_bits").isNotNull() & (
        F.col("_until").isNull() | (F.col(time_col) < F.col("_until"))
    )
    columns = [c for c in probes.columns if c not in ("shard", "shard_since")]
    return found.select(
        *columns,
        F.when(valid, F.col("_bits")).alias("shard"),
        F.when(valid, F.col("_from")).alias("shard_since"),
    )
