"""The text operators against plain versions, with the rows that break careless code."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm import (
    anchors, ann, bpe, deal, jaccard, lines, media, mixing, quality, suffixes, text, tokens,
)

# Columns that operators use inside or give; they must not be taken for theirs.
CLASHING = ["score", "k1", "row", "shard", "component_id", "n_removed", "ids", "kept", "label"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("source", T.StringType()),
     *[T.StructField(name, T.StringType()) for name in CLASHING]]
)
WORDS = [a + b for a in "bcdfgl" for b in ("an", "er", "oul", "st")]


def prose(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and long texts, repeated rows, ties, passages, near copies."""
    pick = random.Random(4)
    base = prose(pick, 120)
    shared = prose(pick, 60)
    texts = [None, "", " \t\n", "one", "a b c d", "A B c D", "x" * 700, "ab" * 400, "Żółw é " * 50,
             base, base, base.replace(" ", "\n", 3), base + " end", base.upper(), "a " * 300,
             "line one\nline two\nline one\n\nline three", "\x00zero\x00 \x1fmark",
             prose(pick, 9000) + " " + shared]
    texts += [prose(pick, pick.randrange(5, 90)) + f" {shared} " + prose(pick, 20) for _ in range(8)]
    for _ in range(25):
        words = base.split()
        for _ in range(pick.randrange(5)):
            words[pick.randrange(len(words))] = pick.choice(WORDS) + "x"
        texts.append(" ".join(words))
    texts += [prose(pick, pick.randrange(1, 14)) for _ in range(40)]
    rows = [(i, t, f"s{i % 12}" if i % 9 else None) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[20], (None, base, "s1"), (None, "only here", None), (3, base, "s2")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*row, *[f"{c}{n}" for c in CLASHING]) for n, row in enumerate(odd_rows())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def expected(of):
    return sorted([(i, *of(t or "")) for i, t, _ in odd_rows()], key=repr)


# words and hashes


def test_words_are_the_runs_without_white_space():
    texts = [(t or "").encode() for _, t, _ in odd_rows()]
    words = text.Words(texts)
    for d, content in enumerate(texts):
        found = [words.buffer[words.start[i]:words.end[i]].tobytes()
                 for i in range(words.first[d], words.first[d + 1])]
        assert found == re.findall(rb"[^\x20\x09-\x0D]+", content)
    hashes, seen = words.hashes(), {}
    for i, h in enumerate(hashes):
        seen.setdefault(words.buffer[words.start[i]:words.end[i]].tobytes(), set()).add(int(h))
    assert all(len(v) == 1 for v in seen.values())
    assert len({min(v) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("width", [1, 2, 5, 18, 35])
def test_rolling_hashes_tell_runs_apart(width):
    values = np.random.default_rng(1).integers(0, 3, 4000).astype(np.uint64)
    found = {}
    for i, h in enumerate(text.rolling(values, width)):
        found.setdefault(values[i : i + width].tobytes(), set()).add(int(h))
    assert all(len(v) == 1 for v in found.values())
    assert len({min(v) for v in found.values()}) == len(found)


# 1: byte strings


def test_suffix_arrays_and_common_prefixes():
    pick = random.Random(2)
    for _ in range(150):
        content = bytes(pick.choices(b"abc"[: pick.randrange(1, 4)], k=pick.randrange(1, 90)))
        values = np.append(np.frombuffer(content, np.uint8).astype(np.int16) + 1, 0)
        order = suffixes.suffix_array(values, 257, 1000)
        assert list(order) == sorted(range(len(values)), key=lambda i: tuple(values[i:]))
        shared = suffixes.common_prefixes(np.frombuffer(content + b"\xfe" * 8, np.uint8), order)
        for one, two in zip(order, order[1:]):
            n = 0
            while max(one, two) + n < len(content) and content[one + n] == content[two + n]:
                n += 1
            assert shared[two] == n


@pytest.mark.parametrize("small", [0, 2000])
def test_names_sorted_by_ranks_or_by_inducing(monkeypatch, small):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
    values = np.append(np.random.default_rng(small).integers(1, 4, 3000), 0).astype(np.int16)
    order = suffixes.suffix_array(values, 257, 5000)
    whole = values.astype(np.uint8).tobytes()
    assert list(order) == sorted(range(len(values)), key=lambda i: whole[i:])


def plain_bytes(texts, length=200):
    counts = Counter()
    for t in texts:
        counts.update(t[i : i + length] for i in range(len(t) - length + 1))

    def of(content):
        t = content.encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        return len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept

    return of


@pytest.mark.parametrize("block", [2_000, 1_000_000])
def test_repeated_bytes(spark, odd, monkeypatch, block):
    pieces = sorted({(t or "").encode() for _, t, _ in odd_rows()})
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    masks = suffixes.repeated_starts(pieces, 200)
    counts = Counter(p[i : i + 200] for p in pieces for i in range(len(p) - 199))
    for piece, mask in zip(pieces, masks):
        assert list(mask) == [counts[piece[i : i + 200]] > 1 for i in range(len(piece) - 199)]


def test_many_pieces_around_one_long_gram(monkeypatch):
    """Different pieces that share 192 bytes and more, in blocks that no gram cuts."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3_000)
    pick = random.Random(3)
    middle = bytes(pick.choice(b"abcd") for _ in range(195))
    pieces = {bytes(pick.choice(b"xy") for _ in range(pick.randrange(9))) + middle + bytes(pick.choice(b"xy") for _ in range(8))
              for _ in range(400)}
    pieces = sorted(p for p in pieces if len(p) >= 200)
    counts = Counter(p[i : i + 200] for p in pieces for i in range(len(p) - 199))
    for found in (suffixes.repeated_starts(pieces, 200), suffixes._counted_starts(pieces, 200)):
        assert [m.tolist() for m in found] == [[counts[p[i : i + 200]] > 1 for i in range(len(p) - 199)] for p in pieces]
    assert len(pieces) > 100 and min(counts.values()) == 1 < max(counts.values())


def test_remove_repeated_bytes(odd):
    of = plain_bytes([(t or "").encode() for _, t, _ in odd_rows()])
    found = suffixes.remove_repeated_bytes(odd)
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == expected(
        lambda t: (*of(t)[:3], bytearray(of(t)[3]))
    )


# 2: mixing


def labelled_texts(spark, n=400):
    pick = random.Random(8)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(pick, pick.randrange(20, 60)).split()
        if bad:
            words[3:3] = ["vile", "vile", "foul"]
        rows.append((i, " ".join(words), "bad" if bad else "good"))
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_rates_reach_the_targets(spark):
    docs = labelled_texts(spark)
    mixed = mixing.mix(docs, docs, {"good": 0.9, "bad": 0.1}, total_factor=1.2).cache()
    sums = mixed.agg(
        F.sum("n_tokens"),
        F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[0]),
        F.sum(F.col("n_tokens") * F.col("rate") * F.col("posterior")[1]),
        F.min("rate"),
    ).first()
    assert sums[1] == pytest.approx(1.2 * 0.9 * sums[0], rel=1e-5)
    assert sums[2] == pytest.approx(1.2 * 0.1 * sums[0], rel=1e-5)
    assert sums[3] >= 0
    rates = {r["domain"]: r[1] for r in mixed.groupBy("domain").agg(F.avg("rate")).collect()}
    assert rates["bad"] < rates["good"]
    assert mixed.filter("copies < floor(rate) or copies > ceil(rate)").count() == 0


def test_projected_steps_equal_a_plain_solver(spark):
    """Where rates are cut at zero, against the same steps in numpy."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    t = rng.integers(1, 100, 300)
    df = spark.createDataFrame(
        [(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "n_tokens long, posterior array<double>"
    )
    steps, wanted, reached = mixing.fit_rates(df, [0.05, 0.05, 0.9])
    gram = (p * t[:, None]).T @ p
    rate = np.ones(300)
    for step in steps:
        rate = np.maximum(0, rate - p @ step)
    assert np.allclose((rate * t) @ p, reached) and (rate == 0).any()
    assert np.linalg.matrix_rank(gram) == 3 and np.abs(reached - wanted).max() < 1e-3 * wanted.sum()


def test_mixing_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(3, "good"), (9, "bad"), (None, "bad"), (5, None)], "doc_id long, domain string")
    mixed = mixing.mix(odd, labels, {"good": 1.0, "bad": 1.0})
    assert mixed.count() == odd.count() and set(CLASHING) <= set(mixed.columns)
    assert mixed.filter("rate is null or copies is null or size(posterior) <> 2").count() == 0
    assert mixed.groupBy("text").agg(F.count_distinct("rate").alias("n")).filter("n > 1").count() == 0
    assert mixing.mix(nothing, labels, {"good": 1.0, "bad": 1.0}).count() == 0
    assert mixing.mix(odd, labels.filter("false"), {"good": 1.0, "bad": 1.0}).count() == odd.count()


# 3: media


def test_media_round_trip(odd, nothing):
    def of(content):
        t = content.encode()
        payload = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        return len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])

    found = media.media_column(odd)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    assert got(found, *names) == expected(of)
    same = found.groupBy("payload_sha256").agg(F.count_distinct("media_sha256", "feature").alias("n"))
    assert same.filter("n > 1").count() == 0
    assert media.media_column(nothing).count() == 0


def test_partitions_hold_each_member_once(spark, odd, folder):
    path = f"file://{folder}/archive"
    media.store_texts(odd, path)
    for size in (100, 10_000, 10**9):
        read = media.read_media(spark, path, size)
        assert read.count() == odd.count() == read.select("archive", "offset").distinct().count()
    assert media.read_media(spark, path, 100).rdd.getNumPartitions() > 10


class Flaky:
    """A file that fails or lies at one offset, a number of times."""

    def __init__(self, content, offset, wrongs):
        self.content, self.offset, self.wrongs, self.reads = content, offset, wrongs, []
        self.renewed = 0

    def renew(self):
        self.renewed += 1

    def read_at(self, length, offset):
        self.reads.append(offset)
        if offset == self.offset and self.wrongs:
            wrong = self.wrongs.pop()
            if wrong == "error":
                raise OSError("lost")
            return self.content[offset : offset + length - 1] + b"?"
        return self.content[offset : offset + length]


def test_members_are_retried_alone():
    parts = [b"first", b"second", b"third"]
    flaky = Flaky(b"".join(parts), 5, ["error", "lie"])
    at = 0
    for part in parts:
        assert media.read_member(flaky, at, len(part), zlib.crc32(part), wait=0) == part
        at += len(part)
    assert flaky.reads == [0, 5, 5, 5, 11] and flaky.renewed == 2
    with pytest.raises(ValueError):
        media.read_member(Flaky(b"abc", 0, ["lie"] * 9), 0, 3, zlib.crc32(b"abc"), wait=0)


def test_a_lost_connection_is_opened_again():
    opened = []

    class Connection:
        def __init__(self):
            self.alive = True
            opened.append(self)

        def read_at(self, length, offset):
            if len(opened) == 1 and offset == 3:
                self.alive = False
            if not self.alive:
                raise OSError("lost")
            return b"onetwo"[offset : offset + length]

        def close(self):
            raise OSError("already lost")

    source = media.OpenFile(Connection)
    assert media.read_member(source, 0, 3, zlib.crc32(b"one"), wait=0) == b"one"
    assert media.read_member(source, 3, 3, zlib.crc32(b"two"), wait=0) == b"two"
    assert media.read_member(source, 0, 3, zlib.crc32(b"one"), wait=0) == b"one"
    assert len(opened) == 2
    source.renew()


def test_ids_of_archives_are_whole_numbers(spark, folder):
    with pytest.raises(TypeError, match="whole numbers"):
        media.store_texts(spark.createDataFrame([("a", "b")], "doc_id string, text string"), folder)


def test_damage_is_found(folder):
    image = bytearray(media.to_png(media.padded(b"some text"), 9))
    assert media.from_png(bytes(image)) == (media.padded(b"some text"), 9)
    image[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))


# 4: quality


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = quality.score_quality(docs, labels.filter(~held)).join(labels, "doc_id").filter(held)
    rows = scored.select("score", "quality").collect()
    good = [s for s, q in rows if q == 1]
    bad = [s for s, q in rows if q == 0]
    assert sum(g > b for g in good for b in bad) > 0.97 * len(good) * len(bad) > 0
    assert min(good) >= 0.3


def test_quality_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(3, 1), (9, 0), (10, 1), (None, 0), (4, None)], "doc_id long, quality int")
    scored = quality.score_quality(odd, labels)
    assert scored.count() == odd.count()
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert scored.filter("(score >= 0.3) <> (predicted = 1)").count() == 0
    assert scored.groupBy("text").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0
    assert quality.score_quality(nothing, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.filter("false")).collect()} == {0.5}


def test_training_rows_are_bounded(spark):
    docs = labelled_texts(spark, 300)
    labels = docs.select("doc_id", (F.col("domain") == "good").cast("int").alias("label"))
    some = quality.train(docs, labels, "doc_id", "text", "label", max_rows=60)
    assert np.count_nonzero(some) < np.count_nonzero(quality.train(docs, labels, "doc_id", "text", "label"))


# 5: passages


def plain_passages(window=35):
    counts, split = Counter(), {}
    for _, t, _ in odd_rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))

    def of(content):
        w = re.findall(r"[^\x20\x09-\x0D]+", content)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        return len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)

    return of


def test_repeated_passages(odd, nothing):
    found = anchors.remove_repeated_passages(odd)
    assert got(found, "doc_id", "n_words", "n_removed", "kept") == expected(plain_passages())
    assert anchors.remove_repeated_passages(nothing).count() == 0


def test_distinct_texts(odd, nothing):
    texts = {t or "" for _, t, _ in odd_rows()}
    found = deal.distinct_texts(odd)
    assert found.count() == len(texts) and found.agg(F.sum("copies")).first()[0] == odd.count()
    assert deal.distinct_texts(nothing).count() == 0


# 6: lines


def plain_lines(rows, least):
    spread, first = {}, {}
    for i, t, s in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\x0b\x0c\r"):
                spread.setdefault(line, set()).add(s or "")
                place = (i is None, -1 if i is None else i, n)
                first[line] = min(first.get(line, place), place)
    out = []
    for i, t, _ in rows:
        kept = [
            line for n, line in enumerate((t or "").split("\n"))
            if len(spread.get(line, ())) < least or first[line] == (i is None, -1 if i is None else i, n)
        ]
        out.append((i, None if t is None else "\n".join(kept), (t or "").count("\n") + 1 - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 10])
def test_widespread_lines(spark, nothing, least):
    pick = random.Random(6)
    common = [f"common line {n}" for n in range(30)]
    rows = [
        (i, "\n".join(pick.choice([*common, "", "  ", f"own {i} {n}"]) for n in range(pick.randrange(9))),
         None if i % 31 == 0 else f"s{pick.randrange(25)}")
        for i in range(260)
    ] + [(500, None, "s1"), (501, "", "s2"), (502, "\n\n", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = lines.remove_widespread_lines(df, min_sites=least)
    assert got(found, "doc_id", "text", "n_removed") == plain_lines(rows, least)
    assert found.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert lines.remove_widespread_lines(nothing, prefix="_").count() == 0


def test_lines_of_odd_rows(odd):
    found = lines.remove_widespread_lines(odd, prefix="_", min_sites=2)
    assert found.count() == odd.count() and set(found.columns) == {*odd.columns, "_n_lines", "_n_removed"}
    assert found.filter("text is null").count() == odd.filter("text is null").count()


# 7: vectors


def test_nearest_vectors(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((700, 24)).astype(np.float32)
    vectors[50:80] = vectors[49]  # ties
    vectors[90] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, rows[0][1]), (1000, None), (1001, [1.0] * 23), (1002, [None] + [1.0] * 23),
             (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    found = ann.nearest(df, df.filter("vec_id % 50 = 0"))
    wide = vectors.astype(np.float64)
    usable = [i for i in range(700) if i != 90]
    hits, wanted = 0, {}
    for q in (i for i in usable if i % 50 == 0):
        cosine = {i: float((wide[i] * wide[q]).sum() / (np.sqrt((wide[i] ** 2).sum()) * np.sqrt((wide[q] ** 2).sum())))
                  for i in usable if i != q}
        wanted[q] = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
    for row in found.collect():
        hits += row["vec_id"] == wanted[row["query_id"]][row["rank"] - 1]
    assert found.count() == 5 * len(wanted) and hits >= 0.98 * 5 * len(wanted)
    assert ann.nearest(df, df.filter("false")).count() == 0
    assert ann.nearest(df.filter("false"), df.filter("vec_id % 50 = 0")).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 2


def test_odd_lengths_do_not_set_the_dimension(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((20, 8)))]
    rows += [(90, [float("nan")] * 9), (91, [None] + [1.0] * 11), (None, [1.0] * 12), (92, [0.0] * 10),
             (93, [float("inf")] * 13), (94, [1.0] * 14), (95, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.filter("vec_id < 20")).collect()
    assert len(found) == 100 and {r["query_id"] for r in found} == set(range(20))
    assert {r["vec_id"] for r in found} <= set(range(20))
    assert ann.nearest(df.filter("vec_id in (90, 91, 92, 93, 95)"), df).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    wide = np.array([r["embedding"] for r in rows], dtype=np.float64)
    wide /= np.sqrt((wide * wide).sum(axis=1))[:, None]
    found = {}
    for row in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for q in found:
        cosine = wide @ wide[ids == q][0]
        cosine[ids == q] = -2
        hits += len(found[q] & set(ids[np.argsort(-cosine)[:5]]))
    assert hits >= 0.95 * 5 * len(found) and len(found) == (ids % 50 == 0).sum()


def test_bounds_hold_mostly():
    rng = np.random.default_rng(1)
    vectors, query = rng.standard_normal((5000, 64)), rng.standard_normal(64)
    turn = ann.rotation(64, 256)
    codes, product = ann.encode(vectors, turn)
    true = vectors @ query / np.sqrt((vectors**2).sum(axis=1)) / np.sqrt((query**2).sum())
    estimate, off = ann.estimates(codes, product, query / np.sqrt((query**2).sum()) @ turn)
    assert (np.abs(true - estimate) <= off).mean() > 0.98 and off.max() < 0.3


def test_population_counts_are_products():
    rng = np.random.default_rng(2)
    codes, products = ann.encode(rng.standard_normal((50, 20)), ann.rotation(20, 128))
    query = rng.standard_normal(128)
    rounded = ann.planes(query)[3]
    signs = np.unpackbits(codes.view(np.uint8), axis=1) * 2.0 - 1
    wanted = signs @ rounded / np.sqrt(128) / products
    assert np.allclose(ann.estimates(codes, products, query)[0], wanted)
    assert np.abs(rounded - query).max() <= (query.max() - query.min()) / 30 + 1e-12


def test_vectors_of_any_size_and_many_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 6))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(base, [1e-300, 1.0, 1e200] * 20, strict=True))]
    rows += [(1000 + i, [5.0, 1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(300)] + [(1007, [5.0, 1.0, 2.0, 3.0, 4.0, 5.0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in ann.nearest(df, df.filter("vec_id < 20 or vec_id in (1000, 1002, 1299)")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (1000, 1002, 1299):
        want = [i for i in range(1000, 1007) if i != q][:5]
        assert [v for _, v, _ in sorted(found[q])] == want and all(s == pytest.approx(1) for *_, s in found[q])
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    for q in range(20):
        best = sorted((i for i in unit if i != q), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5]
        assert [v for _, v, _ in sorted(found[q])] == best


# 8: near duplicates


def plain_components(rows, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for n, row in enumerate(rows):
        groups.setdefault(find(n), []).append(row[0])
    out = []
    for n, row in enumerate(rows):
        known = [i for i in groups[find(n)] if i is not None]
        out.append((row[0], len(sets[n]), min(known, default=None) if sets[n] else row[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [40, 3000])
def test_near_duplicates(odd, nothing, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    found = jaccard.near_duplicates(odd)
    assert got(found, "doc_id", "n_shingles", "component_id") == plain_components(odd_rows())
    assert jaccard.near_duplicates(nothing).count() == 0


def edited(seed, n, length, changes):
    """A family of texts at all distances from each other, of sizes around the bands' ends."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(10**6)}" for _ in range(length)]
    for i in range(n):
        words = list(base[: max(1, length - pick.randrange(length // 4 + 1))])
        for _ in range(pick.randrange(changes + 1)):
            words[pick.randrange(len(words))] = f"e{pick.randrange(10**6)}"
        yield i, " ".join(words), "s"


def test_near_duplicates_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 30)
    rows = []
    for seed, (length, changes) in enumerate(
        [(5, 1), (6, 1), (9, 1), (14, 1), (15, 2), (17, 2), (20, 2), (48, 4), (53, 3), (60, 5), (190, 9),
         (200, 12), (800, 40)]
    ):
        rows += [(len(rows) + i, t, s) for i, t, s in edited(seed, 24, length, changes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = got(jaccard.near_duplicates(df), "doc_id", "n_shingles", "component_id")
    wanted = plain_components(rows)
    assert found == wanted and 20 < len({c for _, _, c in wanted}) < len(rows) - 20


def test_similar_sets_share_signatures():
    """The pigeonhole itself: every similar pair meets more often than the spare."""
    pick = random.Random(12)
    for size in [1, 3, 4, 5, 8, 9, 10, 12, 13, 15, 16, 40, 48, 49, 60, 61, 150, 192, 193, 240, 700]:
        for _ in range(12):
            words = [f"w{pick.randrange(10**9)}" for _ in range(size + 4)]
            other = list(words)
            cut = pick.randrange(3)
            other = other[: len(other) - cut * (size // 11)]
            if pick.random() < 0.5 and size > 20:
                other[pick.randrange(len(other))] = "changed"
            sets = jaccard.Sets([" ".join(words).encode(), " ".join(other).encode()], 5, 0)
            one, two = (set(sets.token[sets.first[i] : sets.first[i + 1]]) for i in (0, 1))
            if 100 * len(one & two) < 80 * len(one | two) or one == two:
                continue
            doc, signature = jaccard.signatures(sets, np.array([0, 1]), 80)
            shared = set(signature[doc == 0]) & set(signature[doc == 1])
            top = max(jaccard.band_of(np.array([len(one), len(two)])))
            assert len(shared) > jaccard.spare_of(np.array([top]))[0]


def test_short_sets_share_no_constant_signature():
    """Unrelated short texts meet nowhere, and all similar ones do."""
    pick = random.Random(21)
    texts = [" ".join(f"w{pick.randrange(10**9)}" for _ in range(n)) for n in range(1, 17) for _ in range(60)]
    sets = jaccard.Sets([t.encode() for t in texts], 5, 0)
    doc, signature = jaccard.signatures(sets, np.arange(len(texts)), 80)
    pairs = set(zip(doc.tolist(), signature.tolist()))
    assert max(Counter(s for _, s in pairs).values()) == 1
    assert min(sets.size[doc]) > 3  # smaller ones are similar to equal sets only
    for _ in range(4000):
        one = [f"e{pick.randrange(10**9)}" for _ in range(pick.randrange(4, 13))]
        apart = pick.randrange(1, 3)
        lost = pick.randrange(apart + 1)
        other = one[lost:] + [f"o{pick.randrange(10**9)}" for _ in range(apart - lost)]
        if len(other) > 12 or 100 * (len(one) - lost) < 80 * (len(one) + apart - lost):
            continue
        made = jaccard.Sets([b""], 5, 0)
        tokens = [np.sort([np.uint64(hash_of(e)) for e in part]) for part in (one, other)]
        made.token = np.concatenate(tokens)
        made.size = np.array([len(t) for t in tokens])
        made.first = np.append(0, np.cumsum(made.size))
        made.doc = np.repeat([0, 1], made.size)
        doc, signature = jaccard.signatures(made, np.array([0, 1]), 80)
        assert set(signature[doc == 0]) & set(signature[doc == 1])


def hash_of(name):
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def test_families_are_cut_by_elements(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 100)
    rows = [(i, i, 25, 1) for i in range(40)]
    cells = jaccard._cells(spark.createDataFrame(rows, "s long, label long, n int, family long"))
    assert cells.select("block").distinct().count() > 1


# 9: token counts


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_lines(odd, nothing, rule):
    encoding, sizes = tokens.encoder(tokens.default_path())

    def of(content):
        t = content.encode()
        ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+$", t)] or [0]
        counts, at = [0] * len(ends), 0
        for number in encoding.encode_ordinary(content):
            span = range(at, at + int(sizes[number]))
            at = span.stop
            where = [next(k for k, e in enumerate(ends) if b < e) for b in span]
            held = Counter(where)
            pick = {"start": where[0], "end": where[-1],
                    "most": max(held, key=lambda k: (held[k], -k))}[rule]
            counts[pick] += 1
        return counts

    found = got(tokens.section_counts(odd, rule=rule), "doc_id", "section", "n_tokens")
    wanted = [(i, n, c) for i, t, _ in odd_rows() for n, c in enumerate(of(t or ""))]
    assert found == sorted(wanted, key=repr)
    assert tokens.section_counts(nothing).count() == 0


def test_tokens_over_boundaries():
    ends, bounds = np.array([2, 7, 8, 12]), np.array([3, 8, 12])
    assert list(tokens.allocate(ends, bounds, "start")[0]) == [2, 1, 1]
    assert list(tokens.allocate(ends, bounds, "end")[0]) == [1, 2, 1]
    assert list(tokens.allocate(ends, bounds, "most")[0]) == [1, 2, 1]
    assert list(tokens.allocate(ends, bounds, "start")[1]) == [1, 0, 0]


# 10: encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_encoding_equals_the_library(odd, nothing, library):
    def of(content):
        ids = library.encode(content, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return ids, decoded

    found = bpe.decode(bpe.encode(odd))
    assert got(found, "doc_id", "ids", "decoded") == expected(of)
    digests = bpe.digests(odd.select("doc_id", "text"))
    assert got(digests, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(
        lambda t: (
            len(of(t)[0]),
            hashlib.sha256(struct.pack(f"<{len(of(t)[0])}I", *of(t)[0])).hexdigest(),
            hashlib.sha256(of(t)[1].encode()).hexdigest(),
        )
    )
    assert bpe.encode(nothing).count() == 0


TRICKY = [
    "<|endoftext|>a<|startoftext|> b <|endoftext", "É é ΑΣ ΣΑΣ. İstanbul ǅ ß", "a" * 5000,
    "I'm we'LL 'S's 123 ½ ²\x1c\x85 x\x00y\x1fz", "漢字 かな カナ 한국어 \U0001f600 \U0001f468‍\U0001f469",
    " 　 tab\tnew\nline\r\n", "'''s 'd'd'll", "é Å ﬁ ſ K", "12345 1.2.3 a1b2",
]


def test_tricky_texts(library, monkeypatch):
    codec = bpe.Codec(bpe.default_path())
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)  # forgets all the time
    pick = random.Random(3)
    letters = [chr(c) for c in [*range(1, 0x180), *range(0x391, 0x3CA), *range(0x410, 0x450)]]
    texts = TRICKY + ["".join(pick.choices([*letters, " ", "'s", "th"], k=40)) for _ in range(300)]
    for begin in range(0, len(texts), 50):
        part = texts[begin : begin + 50]
        flat, ends = codec.encode(part)
        wanted = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [list(x) for x in np.split(flat, ends)[:-1]] == wanted
