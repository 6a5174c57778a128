"""Learning, scoring and token counts against plain versions; long texts."""

import base64
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import bpe, mixing, quality, tokens

BITS = quality.BITS


def texts(n, seed=3):
    pick = random.Random(seed)
    words = ["Lorem", "ipsum,", "dolor", "sit", "amet!", "AMET", "éa", "x1", "the", "the"]
    return [" ".join(pick.choice(words) for _ in range(pick.randrange(0, 25))).encode() for _ in range(n)]


def plain_ftrl(rows):
    """Follow the regularised leader, one coordinate at a time, in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(slot):
        l1 = 0.0 if slot == "bias" else quality.L1
        if abs(z[slot]) <= l1:
            return 0.0
        slope = (quality.BETA + math.sqrt(n[slot])) / quality.ALPHA + quality.L2
        return (math.copysign(l1, z[slot]) - z[slot]) / slope

    for batch in rows:
        gradient = defaultdict(float)
        for features, label in batch:
            margin = weight("bias") + sum(weight(s) * v for s, v in features)
            error = 1 / (1 + math.exp(-margin)) - label
            gradient["bias"] += error
            for s, v in features:
                gradient[s] += error * v
        known = {s: weight(s) for s in gradient}
        for s, g in gradient.items():
            step = (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / quality.ALPHA
            z[s] += g - step * known[s]
            n[s] += g * g
    return {s: weight(s) for s in list(z)}


@pytest.mark.parametrize("models", [1, 3])
def test_learning_equals_a_plain_version(models):
    sample = texts(60)
    doc, slot, value = quality.features(sample)
    pick = random.Random(1)
    label = np.array([pick.randrange(max(2, models)) for _ in sample])
    target = (label[:, None] == np.arange(models)) if models > 1 else label[:, None]
    model = quality.FollowTheLeader(models)
    batches = [np.arange(b, min(b + 8, 60)) for b in range(0, 60, 8)] * 2
    for mine in batches:
        at = np.concatenate([np.flatnonzero(doc == d) for d in mine])
        own = np.searchsorted(mine, doc[at])
        model.learn(own, slot[at], value[doc[at]], target[mine].astype(float))
    for k in range(models):
        plain = plain_ftrl([
            [([(s, value[d]) for s in slot[doc == d]], float(target[d, k])) for d in mine] for mine in batches
        ])
        weights = model.weights()[:, k]
        assert weights[-1] == pytest.approx(plain.pop("bias"), abs=1e-12)
        assert np.count_nonzero(weights[:-1]) == sum(w != 0 for w in plain.values()) > 10
        assert all(weights[s] == pytest.approx(w, abs=1e-12) for s, w in plain.items())


def test_posteriors_equal_plain_dot_products(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=((1 << BITS) + 1, 3)).astype(np.float32)
    sample = [*texts(40), b""]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(sample)] + [(99, None)], "doc_id int, text string")
    found = {r["doc_id"]: (r["n_tokens"], r["posterior"]) for r in mixing.posteriors(docs.repartition(3), weights).collect()}
    for i, text in [*enumerate(sample), (99, b"")]:
        _, slot, value = quality.features([text])
        margin = [float(weights[-1, k]) + sum(float(weights[s, k]) * value[0] for s in slot) for k in range(3)]
        odds = [1 / (1 + math.exp(-min(35, max(-35, m)))) for m in margin]
        assert found[i][0] == len(text.split())
        assert found[i][1] == pytest.approx([o / sum(odds) for o in odds], abs=1e-9)


def test_targets_out_of_reach_are_reported(spark):
    rows = [(10, [0.5, 0.5])] * 20
    df = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    steps, wanted, reached = mixing.fit_rates(df, [0.9, 0.1])
    assert wanted.tolist() == [180, 20] and reached[0] == pytest.approx(reached[1])
    told = []
    docs = spark.createDataFrame([(i, f"word{i} here") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, "a"), (1, "a")], "doc_id long, domain string")
    mixing.mix(docs, labels, {"a": 0.5, "b": 0.5, "c": 0.0}, report=told.append).count()
    assert [t["domain"] for t in told[0]] == ["a", "b", "c"] and told[0][2]["wanted"] == 0


def test_columns_that_are_kept(spark):
    docs = spark.createDataFrame([(i, f"word{i}", "x") for i in range(6)], "doc_id long, text string, other string")
    labels = spark.createDataFrame([(0, 1, "a"), (1, 0, "b")], "doc_id long, quality int, domain string")
    assert quality.score_quality(docs, labels, keep=["doc_id"]).columns == ["doc_id", "score", "predicted"]
    mixed = mixing.mix(docs, labels, {"a": 1.0, "b": 1.0}, keep=["other", "doc_id"])
    assert mixed.columns == ["other", "doc_id", "n_tokens", "posterior", "rate", "copies"] and mixed.count() == 6


def test_a_repeated_id_teaches_one_text(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(2, "other"), (2, "other"), (3, None), (None, "none"), (4, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    found = quality.training_rows(docs, labels, "doc_id", "text", "quality", 100).collect()
    assert sorted((r["text"][:5], r["label"]) for r in found) == [("other", 0.0), ("other", 1.0), ("text ", 1.0)]
    again = quality.training_rows(docs.repartition(7), labels, "doc_id", "text", "quality", 100).collect()
    assert sorted(found) == sorted(again)


# 9 and 10: long texts


@pytest.fixture(scope="module")
def encoding():
    return tokens.encoder(tokens.default_path())[0]


def test_long_white_space(encoding, monkeypatch):
    pick = random.Random(2)
    monkeypatch.setattr(tokens, "_LONG_WHITE", tokens.re.compile(tokens._LONG_WHITE.pattern.replace("2000,", "3,")))
    for _ in range(3000):
        text = "".join(pick.choice([" ", "  ", "\n", "\t ", "a", "b1", "!", "é", "'s", "\xa0", "　"]) for _ in range(pick.randrange(30)))
        assert tokens.encode_whole(encoding, text) == encoding.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n " * 600_000 + "b", "word " * 200_000, "x" * 1_000_000, "!" * 300_000])
def test_very_long_texts_are_counted(spark, encoding, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = tokens.section_counts(docs).agg(F.sum("n_tokens"), F.sum("n_bytes")).first()
    assert row[0] == len(tokens.encode_whole(encoding, text)) and row[1] == len(text)


def spans_of(encoding, text):
    data = text.encode()
    out, at = [], 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        out.append((at, at + size))
        at += size
    assert at == len(data)
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_of_given_spans_and_fields(spark, encoding, rule):
    text = "Žluťoučký kůň pěl\ndábelské ódy über die Straße, and so on."
    given = [(2, 9), (9, 9), (12, 30), (25, 40), (50, 1000), None, (3, None)]
    docs = spark.createDataFrame(
        [(1, text, [None if s is None else {"begin": s[0], "end": s[1]} for s in given], "head", None, "tail é"),
         (2, None, None, None, "", "x"), (3, "", [{"begin": 0, "end": 5}], "", "", "")],
        "doc_id long, text string, sections array<struct<begin:int,end:int>>, a string, b string, c string",
    )
    found = [tuple(r) for r in tokens.section_counts(docs, spans="sections", rule=rule).orderBy("doc_id", "begin_byte", "section").collect()]
    mine = [r for r in found if r[0] == 1]
    assert sum(r[4] for r in mine) == len(encoding.encode_ordinary(text)) and sum(r[7] for r in mine) == len(text)
    edges = {0: (2, 9), 1: (9, 9), 2: (12, 30), 3: (30, 40), 4: (50, len(text))}
    byte = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for number, (begin, end) in edges.items():
        row = next(r for r in mine if r[1] == number)
        assert row[2:4] == (byte[begin], byte[end] - byte[begin]) and row[6:8] == (begin, end - begin)
        inside = 0
        for b, e in spans_of(encoding, text):
            if rule == "start":
                inside += byte[begin] <= b < byte[end]
            elif rule == "end":
                inside += byte[begin] <= e - 1 < byte[end]
        assert rule == "most" or row[4] == inside
    assert [r[1:5] for r in found if r[0] == 2] == [(-1, 0, 0, 0)]
    parts = [tuple(r) for r in tokens.section_counts(docs, fields=["a", "b", "c"], rule=rule).orderBy("doc_id", "section").collect()]
    assert [(r[0], r[1], r[3]) for r in parts] == [
        (1, 0, 5), (1, 1, 1), (1, 2, 7), (2, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 1), (3, 1, 1), (3, 2, 0)
    ]
    assert sum(r[4] for r in parts if r[0] == 1) == len(encoding.encode_ordinary("head\n\ntail é"))


@pytest.mark.parametrize("length", [2_001, 50_000, 200_000])
def test_long_words_equal_the_library(length):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    pick = random.Random(length)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "aéß"):
        word = "".join(pick.choice(letters) for _ in range(length))
        text = f"some {word} and {word[:1500]} 1"
        ids, _ = bpe.codec(bpe.default_path()).encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_base64_is_encoded_whole(spark):
    blob = base64.b64encode(random.Random(1).randbytes(300_000)).decode()
    docs = spark.createDataFrame([(1, blob), (2, blob[:5])], "doc_id long, text string")
    assert {r["doc_id"] for r in bpe.digests(docs).filter("n_tokens > 0").collect()} == {1, 2}


def test_characters_as_the_library_knows_them():
    """Every character, alone and beside others, where Unicode tables of several versions differ."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    own = bpe.codec(bpe.default_path())
    disputed = sorted(bpe._tables().written)
    assert disputed
    pick = random.Random(3)
    texts = [f"a{c}b {c}{c} 1{c}" for c in disputed[:3000]]
    texts += [f"x{chr(c)}y {chr(c)}2" for c in range(0x100, 0x3000, 3)]
    texts += ["".join(pick.choice([*pick.sample(disputed, 3), "a", "é", " ", "7", "!", "Σ", "ß", "İ"]) for _ in range(20)) for _ in range(2000)]
    ids, ends = own.encode(texts)
    begin = 0
    for text, end, wanted in zip(texts, ends.tolist(), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[begin:end].tolist() == wanted.ids, repr(text)
        begin = end
