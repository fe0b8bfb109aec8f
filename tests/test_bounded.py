"""Plans that must stay bounded: firsts of a group, shards that meet without a shuffle."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapewise.operators import checks, concepts, registry, reviews
from tapewise.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_firsts_of_a_group_are_cut_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") * 7919 % 5003).cast("double").alias("v"), F.lit("pending").alias("status"))
    for out in (checks.extremes(df, "g", 5, "v", "id"), concepts.sampled(df, ["id"], ["g"], 50), reviews.review_queue(df.withColumnRenamed("v", "probability"), "g", 20)):
        text = out._jdf.queryExecution().toString()
        physical = text[text.index("== Physical Plan ==") :]
        assert physical.count("WindowGroupLimit") >= 2 and "Partial" in physical and "Final" in physical


def test_extremes_equal_sorting(spark):
    draw = random.Random(1)
    rows = [(g, k, float(draw.randint(0, 40))) for g in ("a", "b") for k in range(60)] + [("c", 0, 1.0), ("c", 1, 1.0)]
    got = {}
    for r in checks.extremes(spark.createDataFrame(rows, "g string, entry_no long, pnl double"), "g").collect():
        got.setdefault(r.g, {})[r.place] = r.entry_no
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        up, down = sorted(own, key=lambda r: (-r[2], r[1]))[:5], sorted(own, key=lambda r: (r[2], r[1]))[:5]
        assert got[g] == {k + 1: r[1] for k, r in enumerate(up)} | {-k - 1: r[1] for k, r in enumerate(down)}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(900).select(F.col("id"), (F.col("id") % 3).alias("g"))
    one, two = (sorted(concepts.sampled(x, ["id"], ["g"], 40, 5).collect()) for x in (df, df.repartition(7)))
    assert one == two and len(one) == 120 and one != sorted(concepts.sampled(df, ["id"], ["g"], 40, 6).collect())


def test_bucketed_shards_meet_without_a_shuffle(spark, tmp_path):
    start = datetime(2024, 1, 1)
    bars = spark.createDataFrame([(s, start + timedelta(minutes=k), float(k)) for s in ("a", "b") for k in range(300)], "symbol string, ts timestamp, close double")
    files.write_signal_buckets(bars.withColumn("up", F.col("close") % 3 == 0), str(tmp_path), "up", tuple(bars.columns), 4)
    files.write_signal_buckets(bars.where("close < 250").withColumn("twice", F.col("close") * 2).withColumn("up", F.lit(False)), str(tmp_path), "twice", tuple(bars.columns), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = files.read_signal_buckets(spark, str(tmp_path), ["up", "twice"], 4)
        assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
        other = spark.newSession()
        again = files.read_signal_buckets(other, str(tmp_path), ["up", "twice"], 4)
        assert "Exchange" not in plan(again)
        rows = both.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert both.columns == ["symbol", "ts", "up", "twice"] and len(rows) == 600
    assert sum(r.up for r in rows) == 200 and sum(r.twice is None for r in rows) == 100 and all(r.twice == 2 * (r.ts - start).seconds // 60 for r in rows if r.twice is not None)


def test_overfitting_equals_ranking_every_half(spark):
    draw = random.Random(5)
    series = [(t, b, float(draw.randint(-3, 3))) for t in range(12) for b in range(8) for _ in range(2) if draw.random() < 0.9]
    sums = {(t, b): 0.0 for t in range(12) for b in range(8)}
    for t, b, v in series:
        sums[t, b] += v
    below = []
    for half in range(256):
        if half.bit_count() == 4:
            inside, outside = ({t: sum(sums[t, b] for b in range(8) if (half >> b & 1) == bit) for t in range(12)} for bit in (1, 0))
            best = min(range(12), key=lambda t: (-inside[t], t))
            below.append(sum(outside[t] < outside[best] for t in range(12)) / 11 < 0.5)
    got = registry.overfitting(spark.createDataFrame(series, "trial int, block int, pnl double"))
    assert tuple(got.first()) == (70, round(sum(below) / 70, 6)) and "Window" not in plan(got)
    one = registry.overfitting(spark.createDataFrame([(1, 0, 1.0)], "trial int, block int, pnl double")).first()
    assert tuple(one) == (70, 1.0)
