"""Documents whose word n-grams overlap: an exact Jaccard join by universe partition.

Two sets r and s are similar when 100 * |r & s| >= percent * |r | s|. They then differ in at
most H elements, H in proportion to |r| + |s|. The universe is cut into m segments by hash:

* Size bands four times as wide as their start have one m each. A set sends signatures of its
  own band, and of the next one where its partners may lie in it; pairs over two bands meet in
  the higher band's scheme.
* Sets that differ in at most H elements have at least m - H equal segments. Each set leaves
  out its cheapest-to-lose segments, those with the fewest elements (then the lowest number),
  and keeps H + 1 + spare, by its own H. The order is one of content, so what two sets leave
  out of their equal segments is a common beginning, and spare + 1 signatures at least meet.
* Once it is known how many sets have a signature, each set drops its ``spare`` most frequent
  ones in the same way; one that shares no more than that has no partner. This is the
  allocation by cost: words that everybody has fill the segments that go.
* In the lowest band (at most TINY elements, so H <= 2) there are two segments: the first is
  indexed with its one-deletion neighbourhood, which bears one difference, the second as it
  is. They cannot both differ by more than that. An empty segment tells nothing and is not
  sent; deletions from the other one stand for it.

Sets that share a signature are compared exactly. Equal sets count once. Comparing follows the
components and not all pairs: each set is first compared with the best connected set among
those it meets, and sets that are then in one component need no further comparison. Sets that
still meet sets of other components are compared in cells of bounded size, by an index of their
elements; what leaves a cell are links between components, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.llm import deal
from ledgerweave.llm.text import Words, mix, rolling, texts_of, whole_runs
from ledgerweave.operators.graph import components
from ledgerweave.session import in_buckets, shuffle_width, written

WIDTH = 5
PERCENT = 80
TINY = 12
SALT_ROWS = 5_000
BLOCK_SETS = 3_000
BLOCK_ELEMENTS = 3_000_000
SHARD_BYTES = 32_000_000

_U = np.uint64


class Sets:
    """The distinct n-grams of some texts: ``token`` sorted within ``doc``, ``size`` per text."""

    def __init__(self, texts: list[bytes], width: int, seed: int):
        words = Words(texts, fold=True)
        h = words.hashes(seed)
        inside = whole_runs(words.doc, width)
        token, doc = rolling(h, width, seed)[inside], words.doc[: len(inside)][inside]
        n_words = np.diff(words.first)
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            own = [
                rolling(h[words.first[d] : words.first[d + 1]], int(n_words[d]), seed + 1000)[0]
                for d in short
            ]
            token, doc = np.append(token, np.array(own, dtype=_U)), np.append(doc, short)
        order = np.argsort(token)
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
        token, doc = token[order], doc[order]
        new = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))[: len(token)]
        self.token, self.doc = token[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.first = np.append(0, np.cumsum(self.size))

    def key(self, seed: int) -> np.ndarray:
        """A number for each set, of its elements alone."""
        total = np.zeros(len(self.size), dtype=_U)
        np.add.at(total, self.doc, mix(self.token, seed))
        return mix(total ^ mix(self.size.astype(_U), seed)).view(np.int64)


def band_of(size: np.ndarray) -> np.ndarray:
    """0 up to TINY elements, then 1 up to 4 * TINY, 2 up to 16 * TINY and so on."""
    band = np.zeros(len(size), dtype=np.int64)
    top = TINY
    while (size > top).any():
        band[size > top] += 1
        top *= 4
    return band


def top_of(band: np.ndarray) -> np.ndarray:
    return TINY * 4**band


def _most_apart(size: np.ndarray, partner: np.ndarray, percent: int) -> np.ndarray:
    """Elements in which similar sets of at most these sizes can differ."""
    return (size + partner) * (100 - percent) // (100 + percent)


def _largest_partner(size: np.ndarray, percent: int) -> np.ndarray:
    return size * 100 // percent


def spare_of(scheme: np.ndarray) -> np.ndarray:
    """Signatures sent beyond the needed ones; the same for all sets of a scheme."""
    return np.where(scheme > 0, 1 + top_of(scheme) // 64, 0)


def _segments(sets: Sets, docs: np.ndarray, scheme: np.ndarray, keep: np.ndarray, percent: int):
    """Signatures of the ``docs`` whose scheme is over 0: doc, signature."""
    top = top_of(scheme)
    m = 2 + _most_apart(top, top, percent) + top // 9 + top // 32
    base = np.append(0, np.cumsum(m))
    count = sets.size[docs]
    place = np.repeat(np.arange(len(docs)), count)
    item = np.repeat(sets.first[docs] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    token = sets.token[item]
    spread = mix(token, 11)
    segment = ((spread >> _U(32)) * m[place].astype(_U) >> _U(32)).astype(np.int64) + base[place]
    content = np.zeros(base[-1], dtype=_U)
    np.add.at(content, segment, mix(token, 12))
    held = np.bincount(segment, minlength=base[-1])
    owner = np.repeat(np.arange(len(docs)), m)
    order = np.argsort(-np.minimum(held, 30_000).astype(np.int16), kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    rank = np.arange(len(order)) - base[owner[order]]
    chosen = order[rank < keep[owner[order]]]
    number = chosen - base[owner[chosen]]
    signature = mix(content[chosen] ^ mix(number.astype(_U), 13)) ^ mix(
        scheme[owner[chosen]].astype(_U), 14
    )
    return owner[chosen], signature


def _without(value: np.ndarray, most: int) -> np.ndarray:
    """The sums of ``value`` with up to ``most`` (at most 2) numbers left out."""
    total = value.sum(dtype=_U)
    sums = [np.array([total]), total - value] if most else [np.array([total])]
    if most > 1:
        one, two = np.triu_indices(len(value), 1)
        sums.append(total - value[one] - value[two])
    return np.concatenate(sums)


def _tiny(sets: Sets, docs: np.ndarray, allowed: np.ndarray):
    """Signatures in the lowest band: one segment with its deletions, one as it is.

    Nothing left of a segment is what many sets of all kinds have in common. Such a signature
    gives way to the other segment with up to ``allowed`` elements deleted: the differences
    are all there, but for one if the first segment of only one of the sets has an element.
    """
    owners, signatures = [], []
    for i, d in enumerate(docs):
        token = sets.token[sets.first[d] : sets.first[d + 1]]
        part = (mix(token, 21) & _U(1)).astype(bool)
        value = mix(token, 22)
        near, rest = value[part], value[~part]
        own = []
        if len(near):
            own.append(mix(_without(near, 1 if len(near) > 1 else 0), 23))
        if len(near) < 2:
            own.append(mix(_without(rest, int(allowed[i]) - len(near)), 26))
        if len(rest):
            own.append(mix(_without(rest, 0), 24))
        else:
            own.append(mix(_without(near, int(allowed[i])), 25))
        signatures.append(np.unique(np.concatenate(own)))
        owners.append(np.full(len(signatures[-1]), i))
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    return np.concatenate(owners), np.concatenate(signatures)


def signatures(sets: Sets, docs: np.ndarray, percent: int):
    """doc, signature (its lowest bit is that of the scheme), for all schemes of ``docs``.

    Sets that may not differ at all from similar ones have none, as equal sets are one.
    """
    size = sets.size[docs]
    band = band_of(size)
    partner = _largest_partner(size, percent)
    out_doc, out_signature = [], []
    for step in (0, 1):  # the scheme of the own band, and of the next where partners reach it
        mine = np.flatnonzero((partner > top_of(band)) | (step == 0))
        scheme = band[mine] + step
        reach = np.minimum(partner[mine], top_of(scheme))
        allowed = _most_apart(size[mine], reach, percent)
        mine, scheme, allowed = (x[allowed > 0] for x in (mine, scheme, allowed))
        wide = scheme > 0
        keep = allowed + 1 + spare_of(scheme)
        owner, signature = _segments(sets, docs[mine[wide]], scheme[wide], keep[wide], percent)
        parity = (scheme[wide] & 1).astype(_U)[owner]
        out_doc.append(mine[wide][owner])
        out_signature.append(signature & ~_U(1) | parity)
        owner, signature = _tiny(sets, docs[mine[~wide]], allowed[~wide])
        out_doc.append(mine[~wide][owner])
        out_signature.append(signature & ~_U(1))
    doc, signature = np.concatenate(out_doc), np.concatenate(out_signature)
    order = np.argsort(doc, kind="stable")
    return docs[doc[order]], signature[order]


def _shard(signature: np.ndarray, shards: int) -> np.ndarray:
    return (((signature >> _U(40)) * _U(shards)) >> _U(24)).astype(np.int64)


def _send(batches: Iterable[pa.RecordBatch], width: int, percent: int, seed: int, shards: int):
    for _, texts in texts_of(batches, "text"):
        sets = Sets(texts, width, seed)
        key = sets.key(seed)
        _, docs = np.unique(key, return_index=True)
        docs = np.sort(docs[sets.size[docs] > 0])
        doc, signature = signatures(sets, docs, percent)
        if len(doc):
            heads = {"s": key, "n": sets.size.astype(np.int32)}
            yield deal.dealt(_shard(signature, shards), doc, heads, {"signature": signature})


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures that more than one set has, with each such set."""
    got = deal.gathered(
        batches, {"count": "<i4", "s": "<i8", "n": "<i4", "signature": "<u8"}
    )
    doc = np.repeat(np.arange(len(got["count"])), got["count"])
    order = np.lexsort((got["s"][doc], got["signature"]))
    signature, doc = got["signature"][order], doc[order]
    s = got["s"][doc]
    new_signature = np.append(True, signature[1:] != signature[:-1])[: len(s)]
    new = new_signature | np.append(True, s[1:] != s[:-1])[: len(s)]
    group = np.cumsum(new_signature) - 1
    sets = np.bincount(group, weights=new).astype(np.int64)
    some = np.flatnonzero(new & (sets[group] > 1))
    n = got["n"][doc[some]].astype(np.int64)
    own = band_of(n)
    scheme = own + ((own & 1) != (signature[some] & _U(1)).astype(np.int64))
    for begin in range(0, len(some), 100_000):
        at = slice(begin, begin + 100_000)
        yield pa.RecordBatch.from_pydict(
            {
                "s": pa.array(s[some[at]]),
                "n": pa.array(n[at].astype(np.int32)),
                "scheme": pa.array(scheme[at].astype(np.int8)),
                "spare": pa.array(spare_of(scheme[at]).astype(np.int32)),
                "signature": pa.array(signature[some[at]].view(np.int64)),
                "sets": pa.array(sets[group[some[at]]]),
            }
        )


def _describe(batches, width: int, seed: int, names: list[str]):
    for batch, texts in texts_of(batches, "__text"):
        sets = Sets(texts, width, seed)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1],
                pa.array(sets.size, pa.int64()),
                pa.array(sets.key(seed)),
                pa.array(sets.key(seed + 77)),
            ],
            names=names,
        )


def _packed(batches, width: int, seed: int):
    """Set key and compressed text, each set once in a chunk."""
    writer = zstandard.ZstdCompressor(level=3)
    for _, texts in texts_of(batches, "text"):
        sets = Sets(texts, width, seed)
        key = sets.key(seed)
        _, docs = np.unique(key, return_index=True)
        docs = docs[sets.size[docs] > 0]
        yield pa.RecordBatch.from_pydict(
            {"s": pa.array(key[docs]), "z": pa.array([writer.compress(texts[d]) for d in docs])}
        )


def _tokens(batches, width: int, seed: int):
    """The sorted elements of each set, 48 bits each."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            sets = Sets(deal.unpacked(part), width, seed)
            short = (sets.token >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            rows = [
                short[sets.first[i] : sets.first[i + 1]].tobytes() for i in range(part.num_rows)
            ]
            yield pa.RecordBatch.from_pydict(
                {"s": part.column("s"), "tokens": pa.array(rows, pa.binary())}
            )


def _elements(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return wide.view(_U).ravel()


def _verify(batches, percent: int):
    for batch in batches:
        ok, last, right = [], None, None
        partners, ours, theirs = (batch.column(c) for c in ("b", "a_tokens", "b_tokens"))
        for i, b in enumerate(partners.to_pylist()):
            if b != last:
                last, right = b, _elements(theirs[i].as_py())
            left = _elements(ours[i].as_py())
            both = np.concatenate((left, right))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(100 * common >= percent * (len(left) + len(right) - common))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Comparer:
    """Exact comparison of pairs of sets; the elements of each set are kept in a bucketed table."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, width: int, percent: int, seed: int):
        spark = docs.sparkSession
        self.width, self.percent = shuffle_width(spark), percent
        tokens = (
            docs.mapInArrow(partial(_packed, width=width, seed=seed), "s long, z binary")
            .join(wanted, "s", "left_semi")
            .repartition(self.width, "s")
            .groupBy("s")
            .agg(F.first("z").alias("z"))
            .mapInArrow(partial(_tokens, width=width, seed=seed), "s long, tokens binary")
            .repartition(self.width, "s")
        )
        self.tokens, _ = in_buckets(tokens, ["s"], "sets", compression="none")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar, written. Many sets may share one b."""
        pairs, _ = written(pairs, "pairs")
        partners = pairs.groupBy("b").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("salts")
        )
        right = (
            self.tokens.withColumnsRenamed({"s": "b", "tokens": "b_tokens"})
            .join(partners, "b")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        )
        left = (
            pairs.join(partners, "b")
            .withColumn("salt", F.pmod(F.hash("a"), "salts"))
            .join(self.tokens.withColumnsRenamed({"s": "a", "tokens": "a_tokens"}), "a")
        )
        both = left.join(right.drop("salts"), ["b", "salt"])
        found = both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(
            partial(_verify, percent=self.percent), "a long, b long"
        )
        return written(found, "links")[0]


def _fits(percent: int, a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _cell_links(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between sets of different labels in one cell, one for each set and other label.

    Common elements are counted by an index from element to sets, so the cost is that of the
    elements that sets have in common, and sets without any cost nothing.
    """
    tokens = [_elements(t) for t in cell["tokens"]]
    sizes = np.array([len(t) for t in tokens])
    numbers = cell["s"].to_numpy()
    labels, label = np.unique(cell["label"].to_numpy(), return_inverse=True)
    left = cell["block"].to_numpy() == cell["i"].to_numpy()
    right = cell["block"].to_numpy() == cell["j"].to_numpy()
    indexed = np.flatnonzero(right)
    flat = np.concatenate([tokens[y] for y in indexed])
    owner = np.repeat(indexed, sizes[indexed])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found: list[tuple[int, int]] = []
    for x in np.flatnonzero(left):
        begins = np.searchsorted(flat, tokens[x])
        count = np.searchsorted(flat, tokens[x], side="right") - begins
        at = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(count.sum())
        if len(at) < len(cell):
            met, common = np.unique(owner[at], return_counts=True)
        else:
            common = np.bincount(owner[at], minlength=len(cell))
            met = np.flatnonzero(common)
            common = common[met]
        near = 100 * common >= percent * (sizes[x] + sizes[met] - common)
        near = met[near & (label[met] != label[x])]
        _, first = np.unique(label[near], return_index=True)
        found.extend((numbers[x], numbers[y]) for y in near[first])
    return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")


def _families(places: DataFrame) -> DataFrame:
    """``s, label, n, family``: sets that meet others outside their component, with all that they
    are joined to by such meetings."""
    mixed = (
        places.groupBy("signature")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("s").alias("least"))
        .filter("low <> high")
        .select("signature", "least")
    )
    opened, _ = written(places.join(mixed, "signature").select("s", "label", "n", "least"), "open")
    edges = opened.select(F.col("s").alias("src"), F.col("least").alias("dst"))
    families = components(edges).withColumnsRenamed({"node": "s", "component": "family"})
    return opened.select("s", "label", "n").distinct().join(families, "s")


def _cells(families: DataFrame) -> DataFrame:
    """Each set in the cells of its family's grid: ``cell, i, j, block, s, label``.

    A family is dealt into blocks of about BLOCK_SETS sets or BLOCK_ELEMENTS elements, whichever
    are more blocks, and a cell holds two blocks; small families share cells. Comparing more than has to be does no harm.
    """
    families, _ = written(families, "families")
    filled = F.greatest(
        F.count(F.lit(1)) / F.lit(BLOCK_SETS), F.sum("n") / F.lit(BLOCK_ELEMENTS)
    )
    sizes = families.groupBy("family").agg(filled.alias("filled"))
    sized = families.join(sizes, "family")
    blocks = F.ceil(F.col("filled")).cast("int")
    shared = F.lit(math.ceil(families.agg(filled).first()[0] or 0))
    place = F.when(blocks > 1, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), shared))
    dealt = sized.select(
        "s", "label", place.alias("place"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("s"), blocks).cast("int").alias("block"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).select(
        "s", "label", "place", "blocks", "block",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )


def _set_links(docs: DataFrame, width: int, percent: int, seed: int, n_bytes: int) -> DataFrame:
    """Links (src, dst) between different sets that join the same sets as all links do."""
    spark = docs.sparkSession
    shards = deal.shard_count(n_bytes, spark, SHARD_BYTES)
    met = (
        docs.mapInArrow(
            partial(_send, width=width, percent=percent, seed=seed, shards=shards),
            deal.dealt_schema("s", "n", "signature"),
        )
        .repartitionById(shards, "shard")  # one shard a task
        .mapInArrow(_meet, "s long, n int, scheme byte, spare int, signature long, sets long")
    )
    rank = F.row_number().over(
        Window.partitionBy("s", "scheme").orderBy(F.desc("sets"), "signature")
    )
    shared, _ = written(
        met.withColumn("rank", rank)
        .filter("rank > spare")
        .select("s", "n", "signature", "sets"),
        "shared",
    )
    weights, _ = written(
        shared.groupBy("s").agg(F.sum("sets").alias("weight"), F.first("n").alias("n")), "weights"
    )
    comparer = _Comparer(docs, weights.select("s"), width, percent, seed)
    members, _ = written(shared.select("s", "signature").join(weights, "s"), "members")
    # first each set with the best connected set that it meets most often
    hubs = members.groupBy("signature").agg(F.max(F.struct("weight", "n", "s")).alias("hub"))
    best = (
        members.join(hubs, "signature")
        .filter(F.col("s") != F.col("hub.s"))
        .filter(_fits(percent, "n", "hub.n"))
        .groupBy(F.col("s").alias("a"), F.col("hub.s").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.max("hub.weight").alias("weight"))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("shared", "weight", "b")).alias("b"))
    )
    links = comparer.links(best).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    # then what still meets sets of other components, in cells
    joined = components(links).withColumnsRenamed({"node": "s", "component": "label"})
    places = members.select("s", "signature", "n").join(joined, "s", "left")
    families = _families(places.withColumn("label", F.coalesce("label", "s")))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        return _cell_links(cell, percent)

    rest = (
        _cells(families)
        .join(comparer.tokens, "s")
        .groupBy("place", "blocks", "i", "j")
        .applyInPandas(compare, "src long, dst long")
    )
    return links.unionByName(written(rest, "links")[0])


def grouped_rows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """``id, h1, h2, n_shingles, label`` for each row of ``docs``, written.

    ``h1, h2`` are 128 bits of the text (null as an empty one) and ``label`` is that of the
    row's group, as near_duplicates links rows. A label follows from the text and never from
    the id, so null and repeated ids mix no groups. Rows without a set (n_shingles 0) share a
    label that says nothing.
    """
    if _most_apart(TINY, TINY, percent) > 2:
        raise ValueError("the scheme of the lowest band needs a higher percentage")
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    named = docs.select(
        F.col(f"`{id_column}`").alias("id"), *text_hashes(text), F.col(f"`{text}`").alias("__text")
    )
    kind = named.schema[0].dataType.simpleString()
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    seed = 0
    names = ["id", "h1", "h2", "n_shingles", "s", "proof"]
    while True:
        rows, _ = written(
            named.mapInArrow(
                partial(_describe, width=width, seed=seed, names=names),
                f"id {kind}, h1 long, h2 long, n_shingles long, s long, proof long",
            ),
            "set-keys",
        )
        clash = (
            rows.groupBy("s")
            .agg(F.min("proof").alias("low"), F.max("proof").alias("high"))
            .filter("low <> high")
        )
        if clash.isEmpty():  # else two different sets have one key: take other keys
            break
        seed += 1
    links = _set_links(texts, width, percent, seed, n_bytes)
    joined = components(links)
    labelled = rows.join(joined, rows["s"] == joined["node"], "left").select(
        "id", "h1", "h2", "n_shingles", F.coalesce("component", "s").alias("label")
    )
    return written(labelled, "labelled")[0]


def text_hashes(text: str) -> list[Column]:
    """128 bits of a text column as two numbers, ``h1, h2``; null counts as empty."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.xxhash64(content).alias("h1"), F.xxhash64(F.lit("second"), content).alias("h2")]


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """``id_column, n_shingles, component_id`` for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A row's set holds its distinct
    runs of ``width`` words, or its whole sequence if it has fewer. Rows link when
    100 * |both| >= percent * |either|; ``component_id`` is the smallest id reached by links,
    the row's own included.

    Null and empty texts and those of white space have no set: n_shingles 0, no links, their
    own id. Equal sets link, so copies and repeated rows share a component. A null id is
    passed over in the minimum; a component of null ids only has a null component_id.
    Other columns are not read. An empty table gives no rows.
    """
    labelled = grouped_rows(docs, id_column, text, width, percent)
    least = labelled.filter("n_shingles > 0").groupBy("label").agg(F.min("id").alias("least"))
    return labelled.join(least, "label", "left").select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )
