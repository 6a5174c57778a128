"""Toxicity, hard negatives and spelling variants against plain versions, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import hardneg, spelling, toxicity
from ledgerweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def table(spark, rows, schema, name=None):
    df = spark.createDataFrame(rows, schema)
    return df.repartition(3)


# 11: toxicity

BAD = ["scoundrel", "nitwit", "blockhead", "pestilent"]


def sentences(pick, n):
    syllables = ["ba", "lo", "ti", "ren", "mus", "ga", "vel", "ok", "ish", "ur"]
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randrange(1, 4)))
    return [[word() for _ in range(pick.randrange(4, 12))] for _ in range(n)]


def text_of(parts):
    return " ".join(" ".join(p).capitalize() + "." for p in parts)


def labelled(n=600, seed=5):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        parts = sentences(pick, pick.randrange(2, 8))
        toxic = int(i % 4 == 0)
        if toxic:
            part = pick.choice(parts)
            part.insert(pick.randrange(len(part)), pick.choice(BAD))
        out.append((i, text_of(parts), toxic))
    return out


def disguised(word, how):
    middle = len(word) // 2
    return {
        "spaced": " ".join(word),
        "dotted": ".".join(word),
        "inserted": word[:middle] + "x" + word[middle:],
        "hyphen": word[:middle] + "-" + word[middle:],
        "capitals": word.upper(),
        "accent": word.replace("o", "ö").replace("i", "í"),
    }[how]


@pytest.fixture(scope="module")
def model():
    rows = labelled()
    return toxicity.learn([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))


@pytest.mark.parametrize("how", ["spaced", "dotted", "inserted", "hyphen", "capitals", "accent"])
def test_disguised_insults_are_found(model, how):
    pick = random.Random(9)
    # a character in the middle of a short word leaves too little of it
    for word in [w for w in BAD if how not in ("inserted", "hyphen") or len(w) > 8]:
        parts = sentences(pick, 5)
        clean = text_of(parts)
        parts[2].insert(2, disguised(word, how))
        low, high = model.scores([clean.encode(), text_of(parts).encode()])
        assert low < 0.5 <= high, (word, how)


def test_windows_left_out_change_nothing(model, monkeypatch):
    """Similarities with and without the bound that leaves windows out."""
    texts = [t.encode() for _, t, _ in labelled(80, seed=2)]
    some = model.landmarks.similarities(texts)
    monkeypatch.setattr(toxicity.Landmarks, "_near", lambda self, s: np.ones(len(s), dtype=bool))
    every = model.landmarks.similarities(texts)
    assert len(some[0]) and all(np.allclose(a, b) for a, b in zip(some, every, strict=True))


def plain_kernel(s, z):
    """Sum over common subsequences of four symbols with at most one left out between two."""
    def parts(x):
        out = defaultdict(float)
        for i in range(len(x)):
            for a, b, c in toxicity.STEPS:
                at = [i, i + a, i + a + b, i + a + b + c]
                if at[-1] < len(x):
                    skipped = set(range(i, at[-1] + 1)) - set(at)
                    cost = math.prod(0.9 if x[k] == 0 else 0.5 for k in skipped)
                    out[tuple(x[k] for k in at)] += cost
        return out

    p, q = parts(s), parts(z)
    return sum(v * q[k] for k, v in p.items() if k in q)


def test_similarity_equals_the_plain_kernel():
    z = toxicity.symbols([b"nitwit"])[:-3]
    own = toxicity.Landmarks([z])
    assert own.own[0] == pytest.approx(plain_kernel(z.tolist(), z.tolist()))
    for content in ("a nitwit here", "n i t w i t", "nitxwit", "bonitwat"):
        s = toxicity.symbols([content.encode()]).tolist()[:-2]
        width = 2 * len(z)
        # subsequences that begin in a window, wherever they end
        best = max(
            sum(
                plain_kernel(s[i : i + 7], z.tolist()) - plain_kernel(s[i + 1 : i + 7], z.tolist())
                for i in range(begin, min(begin + width, len(s)))
            )
            for begin in range(len(s))
        ) / own.own[0]
        found = own.similarities([content.encode()])[2]
        want = min(best, 1.0) ** toxicity.POWER if best >= toxicity.FLOOR else 0.0
        assert (found.max() if found.size else 0.0) == pytest.approx(want, abs=1e-5), content


def test_symbols():
    s = toxicity.symbols(["Ab, cé! D\nx".encode(), b"", "żA".encode()]).tolist()
    e, last, o = toxicity.END, toxicity.LAST, toxicity.OTHER
    assert s == [0, 1, 2, 0, 3, 5, 0, e, 0, 4, 0, e, 0, 24, 0, last, 0, last, 0, o, 1, 0, last, 0]


def test_toxicity_on_held_out_rows(spark):
    scored = QUERIES["op11_toxicity"](spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id"
    )
    rows = scored.filter("held_out").select("score", "toxic", "predicted").collect()
    bad = [r["score"] for r in rows if r["toxic"] == 1]
    good = [r["score"] for r in rows if r["toxic"] == 0]
    assert bad and sum(b > g for b in bad for g in good) > 0.9 * len(bad) * len(good)
    assert sum(r["predicted"] == 0 for r in rows if r["toxic"] == 0) > 0.95 * len(good)


def test_toxicity_odd_rows(spark):
    rows = [(i, t, "x", 0.5) for i, t, _ in labelled(120)]
    odd = [(None, None, "x", 1.0), (1000, "", None, 1.0), (1001, None, None, None), (1000, "nitwit " * 30_000, "y", 2.0),
           (0, "again here", "z", 1.0), (0, "again here", "z", 1.0), (1002, "\x00 ퟿ 中文", "z", 0.0)]
    docs = table(spark, rows + odd, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in labelled(120)] + [(None, 1), (5, None), (999_999, 1)], "doc_id long, toxic int"
    )
    found = toxicity.score_toxicity(docs, labels)
    assert found.columns == ["doc_id", "text", "label", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    assert len({(r["text"], r["score"]) for r in got}) == len({r["text"] for r in got})
    assert next(r["predicted"] for r in got if (r["text"] or "").startswith("nitwit ")) == 1
    lowest = min(r["score"] for r in got)
    assert all(r["score"] == pytest.approx(lowest) for r in got if not r["text"])
    none = toxicity.score_toxicity(docs, labels.filter("false"))
    assert none.filter("score > 1e-6 or predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.filter("false"), labels).count() == 0


# 12: hard negatives


def plain_hard_negatives(rows, is_anchor):
    good = set()
    for ident, vector, label in rows:
        if ident is None or vector is None or label is None or len(vector) != 8:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.add((ident, label, tuple(math.floor(256 * x) for x in vector)))
    out = []
    for anchor in (r for r in good if is_anchor(r[0])):
        score = lambda r, a=anchor: sum(x * y for x, y in zip(a[2], r[2], strict=True))
        others = sorted({(-score(r), r[0], r[1]) for r in good if r[0] != anchor[0]})
        positives = [r for r in others if r[2] == anchor[1]][:5]
        for p, positive, _ in positives:
            fit = [r for r in others if r[2] != anchor[1] and 30 * -p <= 100 * -r[0] <= 90 * -p]
            for rank, (s, negative, _) in enumerate(fit[:10], start=1):
                out.append((anchor[0], positive, rank, negative, -p, -s))
    return sorted(out)


def vectors(seed=3, n=700):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 8))
    rows = []
    for i in range(n):
        label = int(rng.integers(4))
        v = centers[label] + rng.normal(size=8) * 0.8
        if i % 3 == 0:
            v = np.round(centers[0] * 2) / 2  # ties: a third of all rows are one vector
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


def test_hard_negatives_equal_a_plain_version(spark, monkeypatch):
    rows = vectors()
    v = rows[4][1]
    rows += [
        (None, v, 1), (800, None, 1), (900, v, None), (1000, [None, *v[1:]], 1), (1100, [math.nan, *v[1:]], 1),
        (1200, [math.inf, *v[1:]], 1), (1300, v[:5], 1), (1400, [], 1), (1500, [0.0] * 8, 2),
        rows[50], rows[50], (100, v, 3), (50, [x + 1e-9 for x in rows[50][1]], rows[50][2]),
    ]
    df = table(spark, [(*r, "x", 0) for r in rows],
               "vec_id long, embedding array<double>, label int, score string, row int")
    want = plain_hard_negatives(rows, lambda i: i % 50 == 0)
    assert len(want) > 100
    for row_block, anchor_block in ((8192, 1024), (90, 4)):
        monkeypatch.setattr(hardneg, "ROW_BLOCK", row_block)
        monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", anchor_block)
        found = hardneg.hard_negatives(df, F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, found.collect())) == want
    assert hardneg.hard_negatives(df, F.lit(False)).count() == 0
    assert hardneg.hard_negatives(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    for d in (1, 3, 64):
        x = rng.integers(-3000, 3000, size=(200, d)).astype(np.int32)
        for segments in hardneg.LEVELS:
            mean, deviation = hardneg.summaries(x, segments)
            exact = x.astype(float) @ x.T.astype(float)
            middle, reach = mean @ mean.T, deviation @ deviation.T
            assert (exact <= middle + reach + 1e-6 * np.abs(exact) + 1e-3).all()
            assert (exact >= middle - reach - 1e-6 * np.abs(exact) - 1e-3).all()


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="32 bits"):
        hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()


# 13: spelling variants


def plain_words(rows, slips=31, least=7):
    counts = Counter()
    for ident, content in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", content or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if slips and h % slips == 0:
                place = h % len(run)
                run = run[:place] + run[place + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def edits(word, letters):
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i + 1 :]
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]


def plain_variants(counts, ratio=10):
    letters = sorted({c for w in counts for c in w})
    near, form = {}, {}
    for w in counts:
        near[w] = {e for e in edits(w, letters) if e in counts and e != w}
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def misspelt(seed=6):
    pick = random.Random(seed)
    base = ["wonderful", "beautifull", "aaaaaaaa", "strassenüber", "éléphant", "committee", "abcabcabc", "zzzzzzzÿ"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(pick.randrange(30)):
            word = pick.choice(base)
            for _ in range(pick.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at = pick.randrange(len(word))
                word = pick.choice([word[:at] + word[at + 1 :], word[:at] + pick.choice("abezü") + word[at:],
                                    word[:at] + pick.choice("abezü") + word[at + 1 :]])
            words.append(word.upper() if pick.random() < 0.1 else word)
        rows.append((i % 390, pick.choice([" ", ", ", "1", "\n"]).join(words)))
    long = "".join(pick.choice("abc") for _ in range(5000))
    return [*rows, (None, None), (None, "committee committee"), (7, ""), (8, long), (9, long), (9, long),
            (10, long[:2500] + "d" + long[2500:]), (11, long[:2500] + "d" + long[2500:]),
            (12, "łcommitteeł ×÷×÷×÷×÷")] * 2


@pytest.mark.parametrize("slips", [None, 31, 3])
def test_word_counts(spark, slips):
    rows = misspelt()
    df = table(spark, [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    found = spelling.word_counts(df, slips=slips)
    assert {r["word"]: r["n"] for r in found.collect()} == plain_words(rows, slips)


def test_spelling_variants_equal_a_plain_version(spark):
    rows = misspelt()
    df = table(spark, [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    found = spelling.spelling_variants(df, slips=31)
    want = plain_variants(plain_words(rows))
    got = sorted((tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == want and any(w[1] for w in want) and sum(w[4] > 1 for w in want) > 50
    assert spelling.spelling_variants(df.filter("false")).count() == 0
    assert spelling.spelling_variants(df.filter("text is null")).count() == 0


def test_forms_follow_to_the_last(spark):
    counts = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("ccccccc", 10), ("cccccccd", 100),
              ("ccccccce", 100), (None, 5), ("", 9), ("noother", None), ("single", 3), ("single", 4)]
    df = spark.createDataFrame([(w, n, "x") for w, n in counts], "word string, n int, root string")
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert found == {
        "aaaaaaa": ("aaaaaab", "aaaabbb", 1, 1, 10), "aaaaaab": ("aaaaabb", "aaaabbb", 10, 2, 100),
        "aaaaabb": ("aaaabbb", "aaaabbb", 100, 2, 1000), "aaaabbb": (None, "aaaabbb", 1000, 1, None),
        "ccccccc": ("cccccccd", "cccccccd", 10, 2, 100), "cccccccd": (None, "cccccccd", 100, 2, None),
        "ccccccce": (None, "ccccccce", 100, 2, None), "single": (None, "single", 7, 0, None),
    }


def test_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_words([tuple(r) for r in docs]))
    found = QUERIES["op13_spelling_variants"](spark, SMALL)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want and want


def test_partitions_share_branches():
    """Numbers of a trie cut in partitions are those of the whole trie, but for gaps."""
    pick = random.Random(1)
    words = sorted({"".join(pick.choice("ab") for _ in range(pick.randrange(1, 9))) for _ in range(200)})
    for cuts in ([200], [1, 2, 90], [3, 4, 5, 6, 150]):
        parts = [p for p in np.split(np.array(words), [c for c in cuts if c < len(words)]) if len(p)]
        rows, local = [], []
        for k, part in enumerate(parts):
            before, path, free = "", [], 0
            for w in part.tolist():
                common = spelling.shared(before, w)
                path = path[:common] + list(range(free, free + len(w) - common))
                free += len(w) - common
                before = w
                local.append((k, w, path))
            rows.append((k, part[0], part[-1], path))
        joined = spelling._joined_up(rows)
        nodes = {}
        for k, w, path in local:
            base, known = joined[k]
            for i, x in enumerate(path):
                node = known[x] if x < len(known) else base + x
                assert nodes.setdefault(w[: i + 1], node) == node
        assert len(set(nodes.values())) == len(nodes)
