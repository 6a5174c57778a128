"""A corpus made ready for training: filtered, freed of repeats, mixed and encoded.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows that the stage
before it kept, written as Parquet and read again. All but the last give the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import bpe, jaccard, lines, mixing, quality
from ledgerweave.llm.queries import domains, fold, table
from ledgerweave.session import apply_runtime_defaults, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Multiples of the shares there are. Junk is gone by then, so it is no domain here.
TARGETS = {"clean": 1.0, "toxic": 0.8}
TOTAL_FACTOR = 1.1  # so that clean text need not be thinned out to reach its share


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the size of the text that is left."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Each row is judged by its text alone, so repeated rows and rows that share an id stay or go by
    their texts; null and empty texts have the score of the classifier's bias. A null id teaches
    nothing. Scores of exactly the threshold stay.
    """
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id") != 0)
    scored = quality.score_quality(docs, labels)
    return scored.filter(F.col("predicted") == 1).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without widespread lines. All stay; one whose lines all stand elsewhere is empty."""
    return _columns(lines.remove_widespread_lines(docs, prefix="_"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Groups are of rows and not of ids: rows without an id come after all others, and rows that
    share an id are told apart by their text. Rows that are equal in both are one. Documents
    without words are no duplicates of anything and stay, each row once.
    """
    row = ["id", "h1", "h2"]
    first = (
        jaccard.grouped_rows(docs)
        .filter("n_shingles > 0")
        .groupBy("label")
        .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), *row)).alias("first"))
        .select(*[F.col("first").getField(name).alias(f"first_{name}") for name in row])
    )
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\t-\r]", " ")), F.lit("")) == ""
    single = (
        docs.filter(~blank)
        .select(F.col("doc_id").alias("id"), *jaccard.text_hashes("text"), F.struct(*COLUMNS).alias("row"))
        .groupBy(*row)
        .agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    )
    same = F.lit(True)
    for name in row:
        same = same & single[name].eqNullSafe(first[f"first_{name}"])
    kept = single.join(first, same, "left_semi").select("row.*")
    return docs.filter(blank).select(*COLUMNS).unionByName(kept)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that domains have their target shares.

    Equal texts have equal rates and copies, whatever their ids, and repeated rows are each given
    as often. Null and empty texts count no tokens; they get a rate from the classifier's bias.
    """
    labelled = domains(table(spark, sf_dir, "labels")).filter(F.col("domain").isin(*TARGETS))
    mixed = mixing.mix(docs, labelled, TARGETS, total_factor=TOTAL_FACTOR, relative=True)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter("copies > 0").withColumn("copy", copies).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, a row for each row; null and empty texts have none."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", duplicates_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

# The trained stages cannot be said in SQL; tests compare the others with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    apply_runtime_defaults(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
