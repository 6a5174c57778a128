"""The registered queries of the text operators, and the pipeline stage by stage."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import check
import corpus_pipeline
from ledgerweave.llm.queries import QUERIES, SQL
from ledgerweave.session import written

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry_module.queries())
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, name):
    assert check.compare(spark, check.database(MEDIUM), name, MEDIUM) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs_over_whole_tables(spark, name):
    found = QUERIES[name](spark, SMALL)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    if "doc_id" in found.columns and name != "pipeline":
        assert rows_of(found) == rows_of(documents)
    else:
        assert found.count() > 0


def rows_of(df):
    return sorted({row["doc_id"] for row in df.select("doc_id").collect()})


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SMALL), f"test-{name}")[0])
    first, good, cut, single, mixed, encoded = kept
    for part in kept[:-1]:
        assert part.columns == corpus_pipeline.COLUMNS
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = labels.filter("quality = 1").join(first, "doc_id", "left_semi")
    assert clean.join(good, "doc_id", "left_semi").count() == clean.count()
    assert good.count() < first.count()
    # no text of two documents that are near copies is left
    again = corpus_pipeline.duplicates_stage(spark, single, SMALL)
    assert rows_of(again) == rows_of(single) and single.count() == len(rows_of(single))
    assert set(rows_of(mixed)) <= set(rows_of(single)) <= set(rows_of(cut)) <= set(rows_of(good))
    assert rows_of(encoded) == rows_of(mixed)
    assert encoded.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_on_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (None, "a text", "en", "s", 6), (2, "", "en", "s", 0),
        (3, "same words here and there again", "en", "s", 31), (3, "same words here and there again", None, "t", 31),
        (None, None, None, None, None), (4, " \n ", "en", None, 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        given = docs
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = written(stage(spark, before, SMALL), f"odd-{name}")[0]
            if name == "encode":
                assert docs.count() == before.count()
                assert docs.filter("n_tokens <> size(ids)").count() == 0
                assert docs.join(before.filter("text is null or trim(text) = ''"), "doc_id", "left_semi").filter("n_tokens > 0").count() == 0
                continue
            assert docs.columns == corpus_pipeline.COLUMNS
            # no stage makes up a row: text and id stand in the stage's input, but for lines taken out
            if name != "lines":
                pairs = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
                assert pairs(docs) <= pairs(before), name
            else:
                assert docs.count() == before.count()
        assert docs.columns[0] == "doc_id" and (given.count() > 0) >= (docs.count() > 0)


def test_quality_stage_goes_by_text(spark):
    """Rows of one text stay or go together, and a row stays if its score reaches the threshold."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    again = docs.withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs)
    kept = corpus_pipeline.quality_stage(spark, again, SMALL)
    counts = {r["text"]: r["n"] for r in again.groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert all(counts[r["text"]] == r["n"] for r in kept.groupBy("text").agg(F.count("*").alias("n")).collect())
    assert 0 < kept.count() < again.count()


def test_digests_of_stored_media(spark):
    """The stored form of each document, made and read back here without the operator's code."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in QUERIES["op3_media_columns"](spark, SMALL).collect():
        text = docs[row["doc_id"]]
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (row["n_bytes"], row["payload_bytes"]) == (len(text), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])
        lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
        parts = [(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)), (b"lnTh", struct.pack(">Q", len(text))),
                 (b"IDAT", zlib.compress(lines, 6)), (b"IEND", b"")]
        image = b"\x89PNG\r\n\x1a\n" + b"".join(
            struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts
        )
        assert (row["media_bytes"], row["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        counts = Counter(payload)
        mean = sum(v * n for v, n in counts.items()) / len(payload)
        spread = sum(v * v * n for v, n in counts.items()) / len(payload) - mean * mean
        entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in counts.values())
        said = dict(part.split("=") for part in row["feature"].split()[1:])
        assert row["feature"].startswith(f"64x{len(payload) // 64} ")
        assert [float(said[k]) for k in ("mean", "var", "entropy")] == pytest.approx([mean, spread, entropy], abs=1e-3)


def test_each_group_of_rows_keeps_one(spark):
    """Groups of rows whose ids are null or repeated."""
    alone, near, other, third, fourth = (
        " ".join(f"{c}{i}" for i in range(40)) for c in ("a", "n", "o", "t", "f")
    )
    rows = [
        (None, alone), (None, other), (None, other + " end"), (None, third), (7, third),
        (3, near), (5, near + " end"), (5, fourth), (5, fourth),
        (5, " "), (5, None), (None, ""), (None, ""),
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    found = corpus_pipeline.duplicates_stage(spark, docs, SMALL)
    kept = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr)
    of_other = next(t for i, t in kept if (t or "").startswith("o0"))
    assert of_other in (other, other + " end")
    wanted = [(None, alone), (None, of_other), (7, third), (3, near), (5, fourth),
              (5, " "), (5, None), (None, ""), (None, "")]
    assert kept == sorted(wanted, key=repr)


def test_documents_stay_when_all_their_lines_go(spark):
    rows = [(i, "De.", "en", f"s{i}", 3) for i in range(12)] + [(20, "De.\nown line", "en", "s", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines_stage(spark, docs, SMALL).collect()}
    assert found == {0: ("De.", 3), 20: ("own line", 8)} | {i: ("", 0) for i in range(1, 12)}
