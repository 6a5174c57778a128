"""Tree digest against hashlib; graph operators against union-find and a queue."""

import hashlib
import random
from collections import deque

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerweave.operators import digest, graph


def expected_root(texts):
    level = [hashlib.sha256(text.encode()).digest() for text in texts]
    while len(level) > 1:
        if len(level) % 2:
            level.append(level[-1])
        level = [
            hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)
        ]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 100, 257])
@pytest.mark.parametrize("levels", [2, 10])
def test_tree_digest(spark, n, levels):
    df = spark.range(n).repartition(3)
    found = digest.tree_digest(df, ["id"], digest.row_text(["id"]), levels, 10)
    assert rows(found) == [(n, expected_root([f"{len(str(i))}:{i}" for i in range(n)]))]


def test_tree_digest_ignores_partitioning(spark):
    df = spark.range(500).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id") * 3))
    text = digest.row_text(["id", "v"])
    roots = {
        rows(digest.tree_digest(df.repartition(n, F.rand(1)), ["id"], text, 3, size))[0]
        for n, size in [(1, 10), (7, 10), (4, 1_000_000)]
    }
    sized = lambda v: f"{len(str(v))}:{v}"
    texts = [sized(i) + ("~" if i % 7 == 0 else sized(i * 3)) for i in range(500)]
    assert roots == {(500, expected_root(texts))}


def test_tree_digest_of_nothing(spark):
    with pytest.raises(ValueError):
        digest.tree_digest(spark.range(0), ["id"], digest.row_text(["id"]))


def union_find(edges, nodes):
    parent = {node: node for node in nodes}

    def top(node):
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return sorted((node, top(node)) for node in nodes)


def graphs():
    pick = random.Random(5)
    sparse = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)]
    shuffled = list(range(200))
    pick.shuffle(shuffled)
    path = list(zip(shuffled, shuffled[1:]))
    hub = [(150, n) for n in range(300)]
    return {"sparse": sparse, "path": path, "hub": hub, "loop": [(4, 4), (1, 2)]}


@pytest.mark.parametrize("name", list(graphs()))
def test_components(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    nodes = {node for edge in edges for node in edge}
    assert rows(graph.components(df)) == union_find(edges, nodes)
    more = nodes | {1000, 1001}
    listed = spark.createDataFrame([(n,) for n in more], "node bigint")
    assert rows(graph.components(df, listed)) == union_find(edges, more)


def distances(edges, start, hops):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    found, queue = {start: 0}, deque([start])
    while queue:
        node = queue.popleft()
        if found[node] < hops:
            for other in after.get(node, []):
                if other not in found:
                    found[other] = found[node] + 1
                    queue.append(other)
    return sorted(found.items())


@pytest.mark.parametrize("hops", [0, 1, 2, 9])
def test_reachable(spark, hops):
    pick = random.Random(8)
    edges = [(pick.randrange(80), pick.randrange(80)) for _ in range(130)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    start = spark.createDataFrame([(edges[0][0],)], "node bigint")
    expected = distances(edges, edges[0][0], hops)
    assert rows(graph.reachable(df, start, hops)) == expected


def test_reachable_without_broadcast(spark, no_broadcast):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src bigint, dst bigint")
    start = spark.createDataFrame([(1,)], "node bigint")
    assert rows(graph.reachable(df, start, 9)) == [(1, 0), (2, 1), (3, 2)]
