"""Lines that many sites share, found by sketches of the sites of each line.

Everything here is a DataFrame expression. Per line, HyperLogLog sketches of its sites are
merged by aggregation, on the map side first. An estimate that is clearly over or under the
limit decides; lines near the limit get an exact distinct count, which is first made per
(line, site) and so splits a line that is everywhere. Only hashes and numbers are moved until
the texts meet the numbers of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import written

MIN_SITES = 10
LG_CONFIG = 12
# five standard errors of a sketch with 2^12 registers and HLL estimator (1.04 / sqrt(2^12))
MARGIN = 5 * 1.04 / 2 ** (LG_CONFIG / 2)

LINE = ["h1", "h2"]
ROW = ["row_id", "row_h1", "row_h2"]


def _hashes(value: Column, one: str, two: str) -> list[Column]:
    """128 bits that stand for a text, as two numbers."""
    return [
        F.xxhash64(value).alias(one),
        F.xxhash64(F.lit("second"), value).alias(two),
    ]


def _lines(docs: DataFrame, id_column: str, text: str, site: str) -> DataFrame:
    """A row for each line: the row's id and text hash, site, number and hash of the line."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("row_id"),
        *_hashes(content, "row_h1", "row_h2"),
        F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(content, "\n", -1)).alias("number", "line"),
    )
    return rows.select(
        *ROW, "site", "number", *_hashes(F.col("line"), *LINE),
        (F.trim(F.regexp_replace("line", r"[\t\x0B\f\r]", " ")) == "").alias("blank"),
    )


def widespread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2`` and the first place (``first``) of each line on ``min_sites`` sites or more."""
    spread, _ = written(
        lines.filter(~F.col("blank"))
        .groupBy(*LINE)
        .agg(
            F.count(F.lit(1)).alias("places"),
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_CONFIG))).alias("sites"),
            # rows with an id come first
            F.min(
                F.struct(F.col("row_id").isNull().alias("no_id"), *ROW, "number")
            ).alias("first"),
        )
        .filter(F.col("places") >= min_sites)
        .filter(F.col("sites") >= min_sites * (1 - MARGIN) - 1),
        "spread",
    )
    sure = F.col("sites") > min_sites * (1 + MARGIN) + 1
    near = spread.filter(~sure)
    exact = (
        lines.join(near.select(*LINE), LINE, "left_semi")
        .groupBy(*LINE, "site")
        .agg(F.lit(1).alias("one"))
        .groupBy(*LINE)
        .agg(F.count("one").alias("exact_sites"))
        .filter(F.col("exact_sites") >= min_sites)
    )
    columns = [*LINE, "first"]
    return (
        spread.filter(sure)
        .select(*columns)
        .unionByName(near.join(exact, LINE, "left_semi").select(*columns))
    )


def remove_widespread_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``text`` freed of lines that stand on at least ``min_sites`` sites.

    Added: ``<prefix>n_lines``, ``<prefix>n_removed``. Lines are what newlines part; the text
    that is left keeps its lines, order and newlines. Of each such line the first place stays
    (smallest id, then smallest text hash, then line number), so nothing that was said is
    lost. Blank lines always stay.

    Null texts count as empty and stay null; an empty text is one blank line. A null site is
    the site ''. Rows without an id come after all others. Rows that are equal in id and text
    are one place: both keep what stays there. Other columns pass through untouched.
    """
    lines = _lines(docs, id_column, text, site)
    wide = widespread_lines(lines, min_sites)
    here = F.struct(F.col("row_id").isNull().alias("no_id"), *ROW, "number")
    gone, _ = written(
        lines.select(*ROW, "number", *LINE)
        .distinct()
        .join(wide, LINE)
        .filter(~here.eqNullSafe(F.col("first")))
        .groupBy(*ROW)
        .agg(F.sort_array(F.collect_list("number")).alias("gone")),
        "gone-lines",
    )
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_column}`").alias("row_id"),
        *_hashes(content, "row_h1", "row_h2"),
        content.alias("content"),
    )
    same = F.lit(True)
    for name in ROW:
        same = same & marked[name].eqNullSafe(gone[name])
    joined = marked.join(gone, same, "left")
    parts = F.split("content", "\n", -1)
    # as a map, so that looking up each line does not search the list of gone lines
    flags = F.map_from_arrays("gone", F.transform("gone", lambda _: F.lit(True)))
    left = F.array_join(
        F.filter(F.col("parts"), lambda _, i: F.element_at(F.col("flags"), i).isNull()), "\n"
    )
    out = joined.select(
        "row", "gone", F.when(F.col("gone").isNotNull(), parts).alias("parts"),
        F.when(F.col("gone").isNotNull(), flags).alias("flags"),
        (F.size(parts)).alias("n_lines"),
    )
    old = F.col("row").getField(text)
    return out.select(
        *[
            (F.when(F.col("gone").isNull(), old).otherwise(left) if c == text
             else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ],
        F.col("n_lines").cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(f"{prefix}n_removed"),
    )
