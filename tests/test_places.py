"""Binary shards in space and time, pairs, currencies, records: against plain versions."""

import datetime as dt
import hashlib
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerweave.functions import records
from ledgerweave.functions.columns import base_units
from ledgerweave.operators import currency, pairs, shards, temporal

START = dt.datetime(2024, 1, 1)


def bits_of(ident):
    return bin(int(hashlib.sha256(str(ident).encode()).hexdigest(), 16))[2:].zfill(256)


def nested_prefixes(seed, n, deepest=60):
    pick = random.Random(seed)
    out = set()
    for _ in range(n):
        out.add(bits_of(pick.randrange(400))[: pick.randrange(1, deepest + 1)])
    return sorted(out)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_most_specific_equals_containment(spark, size):
    prefixes = nested_prefixes(2, 150) + ["0000", "1111", "111", "0" * 60]
    accounts = spark.createDataFrame([(i, "x") for i in range(400)] + [(None, "n"), (7, "y")], "id int, shard string")
    table = spark.createDataFrame([(p,) for p in [*prefixes, None, prefixes[0]]], "p string")
    found = shards.assign_most_specific(accounts, table, "id", "p", min_slice_rows=size)
    want = []
    for i in [*range(400), 7, None]:
        here = [p for p in prefixes if i is not None and bits_of(i).startswith(p)]
        want.append((i, max(here, key=len, default=None), len(here)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[2] > 1 for w in want) > 20 and sum(w[2] == 0 for w in want) > 10


def test_given_digests_and_the_empty_prefix(spark):
    full = ["0" * 64, "f" * 64, "7f" + "f" * 62, "80" + "0" * 62, "short", None, "F" * 64]
    accounts = spark.createDataFrame([(x,) for x in full], "id string")
    table = spark.createDataFrame([("",), ("1",), ("0" * 256,), ("1" * 256,)], "p string")
    found = {r["id"]: (r["shard"], r["n_covering"]) for r in shards.assign_most_specific(accounts, table, "id", "p", hashed=False).collect()}
    assert found == {
        "0" * 64: ("0" * 256, 2), "f" * 64: ("1" * 256, 3), "7f" + "f" * 62: ("", 1), "80" + "0" * 62: ("1", 2),
        "short": (None, 0), None: (None, 0), "F" * 64: (None, 0),
    }
    with pytest.raises(Exception, match="no binary prefix"):
        shards.assign_most_specific(accounts, spark.createDataFrame([("01x",)], "p string"), "id", "p").collect()
    none = shards.assign_most_specific(accounts, table.filter("false"), "id", "p", hashed=False)
    assert none.filter("shard is not null or n_covering <> 0").count() == 0 and none.count() == len(full)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_segments_report_gaps_and_overlaps(spark, size):
    prefixes = ["00", "001", "0010", "1", "11"]
    table = spark.createDataFrame([(p,) for p in prefixes], "p string")
    found = sorted(map(tuple, shards.shard_segments(table, "p", size).collect()))
    f = "f" * 62
    z = "0" * 62
    assert found == [
        ("00" + z, "1f" + f, "00", 1), ("20" + z, "2f" + f, "0010", 3), ("30" + z, "3f" + f, "001", 2),
        ("40" + z, "7f" + f, None, 0), ("80" + z, "bf" + f, "1", 1), ("c0" + z, "ff" + f, "11", 2),
    ]
    assert rows(shards.shard_segments(table.filter("false"), "p")) == [("00" + z, "ff" + f, None, 0)]


def day(n):
    return START + dt.timedelta(days=n)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_splits_and_merges_equal_a_theta_join(spark, size):
    versions = [("", 0, 10), ("0", 10, 20), ("1", 10, 30), ("00", 20, 40), ("01", 20, 30), ("010", 30, 35),
                ("011", 30, 35), ("01", 35, None), ("10", 30, None), ("110", 30, 33), ("111", 30, None), ("00", 45, None)]
    table = spark.createDataFrame(
        [(p, day(a), None if b is None else day(b)) for p, a, b in versions] + [(None, day(1), None), ("0", None, None)],
        "p string, a timestamp_ntz, b timestamp_ntz",
    )
    pick = random.Random(4)
    probes = [(n, pick.randrange(60), day(pick.randrange(-3, 50))) for n in range(600)]
    probes += [(1000, None, day(3)), (1001, 4, None)] + [(2000 + n, 5, day(n % 50)) for n in range(300)]
    df = spark.createDataFrame(probes, "n int, id int, t timestamp_ntz")
    found = shards.assign_shard_at(df, table, "id", "t", "p", "a", "b", min_slice_rows=size)
    want = []
    for n, i, t in probes:
        here = [
            (p, day(a)) for p, a, b in versions
            if i is not None and t is not None and bits_of(i).startswith(p) and day(a) <= t and (b is None or t < day(b))
        ]
        assert len(here) <= 1
        want.append((n, *(here[0] if here else (None, None))))
    assert sorted(map(tuple, found.select("n", "shard", "shard_since").collect())) == sorted(want)
    assert len({w[1] for w in want}) > 9


@pytest.mark.parametrize("size", [40, 1_000_000])
@pytest.mark.parametrize("most", [None, 1, 3])
def test_pairs_agree_with_follow_ups(spark, size, most):
    pick = random.Random(3)
    data = [
        (n, None if pick.random() < 0.3 else f"k{pick.randrange(6)}",
         None if pick.random() < 0.05 else day(pick.randrange(120))) for n in range(500)
    ]
    df = spark.createDataFrame(data, "id int, k string, t timestamp_ntz")
    found = sorted(map(tuple, pairs.follow_up_pairs(df, "k", "t", "id", 4, most, size).collect()), key=repr)
    want = []
    for i, k, t in data:
        later = sorted((u, j) for j, l, u in data if t and u and l == k and t < u <= t + dt.timedelta(days=4))
        want += [(k, i, len(later), r, j, u) for r, (u, j) in enumerate(later[:most], start=1)]
    assert found == sorted(want, key=repr) and len(want) > 400
    firsts = {(r["id"], r["n_follow_ups"], r["first_id"]) for r in temporal.follow_ups(df, "k", "t", "id", 4).collect()}
    assert {(r[1], r[2], r[4]) for r in found if r[3] == 1} == firsts


def test_currencies_of_any_size(spark):
    pick = random.Random(1)
    data, want = [], defaultdict(lambda: [0, 0])
    for _ in range(300):
        key = pick.choice(["a", "b", None])
        amounts = {c: pick.choice([1, -1]) * pick.randrange(10 ** pick.randrange(1, 39)) for c in pick.sample(range(5), 3)}
        amounts[9] = None
        data.append((key, amounts))
        for c, x in amounts.items():
            if x is not None:
                want[key, c][0] += 1
                want[key, c][1] += x
    data += [("a", None), ("z", None), ("a", {}), ("big", {1: 10**38 - 1}), ("big", {1: 10**38 - 1}), ("low", {1: -1}), ("low", {1: 1})]
    want["big", 1], want["low", 1] = [2, 2 * (10**38 - 1)], [2, 0]
    df = spark.createDataFrame([(k, {c: None if x is None else str(x) for c, x in m.items()} if m is not None else None) for k, m in data],
                               "k string, m map<int,string>")
    df = df.withColumn("m", F.transform_values("m", lambda _, x: x.cast("decimal(38,0)")))
    found = {(r["k"], r["currency"]): [r["n"], int(r["total"])] for r in currency.currency_totals(df, ["k"], "m").collect()}
    assert found == dict(want)
    maps = {r["k"]: {c: int(x) for c, x in r["totals"].items()} for r in currency.currency_maps(df, ["k"], "m").collect()}
    assert maps["big"] == {1: 2 * (10**38 - 1)} and set(maps) == {"a", "b", None, "big", "low"}


def test_units_of_38_digits(spark):
    values = ["99999999999999999999999999999.999999999", "-99999999999999999999999999999.999999999", "0.000000001",
              "-0.5", "0", "-1.000000001", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r[0] for r in df.select(base_units(F.col("v").cast("decimal(38,9)"), 9)).collect()]
    assert [None if x is None else int(x) for x in found] == [
        None if v is None else int((v if "." in v else v + ".").replace(".", "") + "0" * (9 - len(v.partition(".")[2]))) for v in values
    ]
    assert df.filter("v = '0'").select(base_units("v", 18), base_units("v", 0)).first()[:] == (0, 0)


def test_records_of_any_length(spark):
    def record(kind, body):
        return bytes([kind]) + len(body).to_bytes(4, "big") + body

    whole = record(3, b"abc") + record(255, b"") + record(0, b"x" * 70_000)
    data = [(1, whole), (2, b""), (3, None), (4, whole[:-1]), (5, b"\x01\x00"), (None, record(1, b"n")), (1, record(9, b"z")),
            (6, b"\x01\xff\xff\xff\xffabc")]
    df = spark.createDataFrame(data, "k int, data binary").repartition(3)
    found = sorted(((r["k"], r["place"], r["kind"], bytes(r["body"])) for r in records.record_rows(df, "k", "data").collect()), key=repr)
    cut = whole[len(record(3, b"abc") + record(255, b"")) : -1]
    assert found == sorted([
        (1, 0, 3, b"abc"), (1, 1, 255, b""), (1, 2, 0, b"x" * 70_000), (4, 0, 3, b"abc"), (4, 1, 255, b""), (4, 2, None, cut),
        (5, 0, None, b"\x01\x00"), (None, 0, 1, b"n"), (1, 0, 9, b"z"), (6, 0, None, b"\x01\xff\xff\xff\xffabc"),
    ], key=repr)
    assert records.record_rows(df.filter("false"), "k", "data").count() == 0
