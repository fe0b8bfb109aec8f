import heapq
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tapewise.llm import common, mixing
from tapewise.llm.common import connected_components, rank_in_groups
from tapewise.llm.mixing import pfair_mix
from tapewise.llm.queries import OTHER_WEIGHT, TARGET_WEIGHTS, op1_pfair_mix, op3_stratified_shards
from tapewise.llm.sharding import stratified_shards

DATA = "/root/testdata/sf0.001"


def docs(spark, counts, extra=()):
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame([*rows, *extra], "doc_id long, source string")


def fluid(counts, weights, v):
    return sum(min(Fraction(n), weights[s] * v) for s, n in counts.items())


@pytest.mark.parametrize("counts", [{"a": 30, "b": 9, "c": 4}, {"a": 1}, {"a": 5, "b": 50}])
def test_mix_keeps_within_one_block_of_the_fluid_share(spark, counts):
    weights = {s: w for s, w in {"a": 5, "b": 3, "c": 2}.items() if s in counts}
    got = pfair_mix(docs(spark, counts), weights).collect()
    assert sorted(r.slot for r in got) == list(range(sum(counts.values())))
    by_slot = sorted(got, key=lambda r: r.slot)
    done = Counter()
    for r in by_slot:
        assert r.release <= r.slot < r.deadline
        assert r.block == done[r.source]  # a source's blocks come in their order
        assert r.release == fluid(counts, weights, Fraction(r.block, weights[r.source])) // 1
        done[r.source] += 1
        # fluid shares at this time: find v by bisection on exact fractions
        lo, hi = Fraction(0), Fraction(100)
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if fluid(counts, weights, mid) < r.slot + 1 else (lo, mid)
        for s, n in counts.items():
            assert abs(done[s] - min(Fraction(n), weights[s] * hi)) < 1 + Fraction(1, 1000)


def edf(counts, weights):
    """Slots by (source, block): sources of equal weight take turns, the one with most rows first; lanes in order of weight."""
    jobs, lanes = [], {}
    for s in sorted(counts, key=lambda s: (-counts[s], s)):
        lanes.setdefault(weights[s], []).append(s)
    for w, sources in lanes.items():
        for k in range(counts[sources[0]]):
            left = [s for s in sources if counts[s] > k]
            for i, s in enumerate(left):
                a, b = (fluid(counts, weights, Fraction(k * len(left) + i + e, w * len(left))) for e in (0, 1))
                jobs.append((a // 1, -(-b // 1), w, k, i, s))
    jobs.sort()
    ready, at, slots = [], 0, {}
    for t in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        _, _, k, _, s = heapq.heappop(ready)
        slots[s, k] = t
    return slots


@pytest.mark.parametrize("counts", [{"a": 12, "b": 7, "c": 3}, {"a": 40, "b": 9, "c": 9, "d": 2, "e": 31, "f": 1}])
def test_mix_is_earliest_deadline_first(spark, counts):
    weights = {"a": 4, "b": 2, "c": 1, "d": 2, "e": 4, "f": 2}
    got = {(r.source, r.block): r.slot for r in pfair_mix(docs(spark, counts), weights).collect()}
    assert got == edf(counts, weights)


@pytest.mark.parametrize("sent", [0, 200_000])
def test_mix_of_many_sources(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "SENT_ROWS", sent)
    counts = {f"s{k:04}": 1 + k % 3 for k in range(520)} | {"big": 900, "s0000": 30}
    weights = dict.fromkeys(counts, 4) | {"big": 20}
    got = pfair_mix(docs(spark, counts), {"big": 20}, 4).collect()
    assert {(r.source, r.block): r.slot for r in got} == edf(counts, weights) and all(r.release <= r.slot < r.deadline for r in got)


def test_mix_query_equals_brute_force(spark):
    data = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()
    counts = Counter(r.source or "" for r in data)
    got = op1_pfair_mix(spark, DATA).collect()
    weights = {s: TARGET_WEIGHTS.get(s, OTHER_WEIGHT) for s in counts}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in data)
    assert {(r.source or "", r.block): r.slot for r in got} == edf(counts, weights)


def test_mix_edge_cases(spark):
    df = docs(spark, {"a": 3}, [(None, "a"), (7, None), (7, None)]).selectExpr("*", "'x' AS slot", "1 AS _other", "2 AS _hash", "3 AS _source", "4 AS w", "5 AS `a.b`")
    got = pfair_mix(df, {"a": 2}).collect()
    assert len(got) == 6 and sorted(r.slot for r in got) == list(range(6)) and all((r["_other"], r["_hash"], r["_source"], r.w, r["a.b"]) == (1, 2, 3, 4, 5) for r in got)
    assert pfair_mix(df.limit(0), {"a": 2}).count() == 0
    with pytest.raises(ValueError):
        pfair_mix(df, {"a": 0})


def test_shards_differ_by_one_row_and_match_the_mixture(spark):
    df = docs(spark, {"a": 500, "b": 90, "c": 10}, [(None, None), (3, "a"), (3, "a")]).selectExpr("*", "9 AS shard")
    got = stratified_shards(df, 6).collect()
    assert len(got) == 603
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        assert abs(sum(r.source == "a" for r in got if r.shard == s) - 502 / 6) <= 2
        assert abs(sum(r.source == "b" for r in got if r.shard == s) - 15) <= 2
    assert stratified_shards(df.limit(0), 6).count() == 0
    assert Counter(r.shard for r in stratified_shards(df.limit(2), 6).collect()) == {0: 1, 3: 1}


def test_ranks_do_not_depend_on_buckets(spark):
    df = spark.range(300).selectExpr("id % 3 AS g", "id * 7919 % 1000 AS v")
    one = rank_in_groups(df, ["g"], F.expr("0"), [F.col("v")], "r", "n", 1)
    many = rank_in_groups(df, ["g"], F.expr("v div 100"), [F.col("v")], "r", "n", 10)
    assert sorted(map(tuple, one.select("g", "v", "r", "n").collect())) == sorted(map(tuple, many.select("g", "v", "r", "n").collect()))


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 9), (9, 3), (7, 7), (None, 1)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {k for k, v in got.items() if v == 1} == {1, 2, 3, 4, 5, 9}
    assert got[11] == 10 and got[139] == 100 and got[230] == 200 and 7 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    order = random.Random(1).sample(range(400), 400)
    edges = [(order[k], order[k + 1]) for k in range(399)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert got.count() == 400 and got.select("component").distinct().collect() == [(0,)]


def test_spread_joins_equal_plain_ones(spark):
    many = spark.range(2000).selectExpr("id AS v", "IF(id < 1500, 0, id % 7) AS k").cache()
    one = spark.range(5).selectExpr("id AS k", "id * 10 AS x")
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(common.dealt(many, ["k"], "v", "d", 100).join(common.copied(one, many, ["k"], "d", 100), ["k", "d"]).drop("d")) == rows(many.join(one, "k"))
    assert sorted(map(str, common.looked_up(many, one, ["k"], "v").select("v", "k", "x").collect())) == sorted(map(str, many.join(one, "k", "left").select("v", "k", "x").collect()))
    totals = common.with_totals(many, ["k"], "v", {"n": (F.count("*"), F.sum), "lo": (F.min("v"), F.min)})
    assert rows(totals) == rows(many.join(many.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo")), "k"))


def test_shard_query(spark):
    data = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op3_stratified_shards(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(data) and len(got) == len(data)
    for r in got:
        text = (data[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
    # brute force: sort by fractional rank, cut equally
    ranks = Counter()
    sizes = Counter(data[r.doc_id].source for r in got)
    hashed = {r.doc_id: r.h for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", common.seeded_hash(17, "doc_id").alias("h")).collect()}
    order = []
    for k in sorted(data, key=lambda k: (hashed[k], k)):
        s = data[k].source
        order.append(((2 * ranks[s] + 1) / (2 * sizes[s]), hashed[k], k))
        ranks[s] += 1
    places, n = {}, len(order)
    for at, (_, _, k) in enumerate(sorted(order)):
        shard = at * 24 // n
        places[k] = (shard, at - -(-shard * n // 24))
    assert {r.doc_id: (r.shard, r.slot) for r in got} == places
