"""Patterns, checks and reviews on small inputs with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.operators import checks, patterns, reviews, signals
from tapewise.sources.bars import keyed

START = dt.datetime(2024, 1, 1)


def bars_of(spark, rows, minutes=60):
    """Bars of symbol A from (open, high, low, close)."""
    data = [("A", START + dt.timedelta(minutes=minutes * i), *map(float, r), 10) for i, r in enumerate(rows)]
    return keyed(spark.createDataFrame(data, "symbol string, ts timestamp, open double, high double, low double, close double, volume long"))


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    close = 1000 + np.cumsum(rng.normal(0, 5, n))
    opened = np.concatenate([[1000], close[:-1]])
    return [(o, max(o, c) + 2, min(o, c) - 2, c) for o, c in zip(opened, close, strict=True)]


def test_alignment_uses_closed_bars_of_the_higher_frame_only(spark):
    higher = [(100, 102, 98, 101), (101, 110, 100, 109), (109, 120, 106, 118), (118, 121, 115, 120), (120, 122, 116, 119)]
    bars = bars_of(spark, [(105, 106, 103, 104)] * 20)
    out = patterns.frame_alignment(bars, bars_of(spark, higher, 240).select("symbol", "ts", "open", "high", "low", "close", "volume"), 4 * 3600)
    rows = {r.bar_no: r for r in out.collect()}
    assert len(rows) == 20 and not any(rows[i].mtf_active for i in range(12))  # the gap 102..106 is known when its third bar has closed
    assert rows[12].mtf_direction == 1 and rows[12].mtf_depth == pytest.approx(0.5) and rows[12].mtf_passes
    assert all(0 <= r.mtf_depth <= 1 and r.mtf_strength >= 0 and (r.mtf_active or not r.mtf_passes) for r in rows.values())


def test_gap_levels(spark):
    flat = lambda o, c: [(o, max(o, c), min(o, c), c)] * 24
    day = lambda x: [(x, x, x, x)] * 24
    rows = [*flat(20000, 20000), *day(20010), *day(20020)]
    rows[-1] = (20010, 20018, 20007.5, 20015)
    out = {r.bar_no: r for r in patterns.gap_level_bounce(bars_of(spark, rows)).collect()}
    assert out[30].bounce_level is None and not out[30].bounce_bull  # one gap makes no level
    assert out[71].bounce_level == 20010 and out[71].bounce_bull and not out[71].bounce_bear


def test_order_blocks_take_bodies(spark):
    rows = [(100, 103, 98, 101), (101, 104, 99, 100), (102, 105, 96, 98), (97, 98, 95, 97), (99, 101, 97, 100), (100, 102, 98, 101)]
    bars = bars_of(spark, rows).withColumn("lo", F.lit(95.0)).withColumn("hi", F.lit(500.0))
    out = {r.bar_no: r for r in patterns.order_blocks(bars, "lo", "hi").collect()}
    assert [k for k, r in out.items() if r.ob_bull] == [4] and (out[5].ob_high, out[5].ob_low, out[5].ob_mid) == (102, 98, 100)
    far = patterns.order_blocks(bars.withColumn("lo", F.lit(80.0)), "lo", "hi")
    assert far.where("ob_bull or ob_bear").isEmpty()


def test_rescaled_range_of_noise_and_trend():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=4096)
    assert 0.4 < patterns.rescaled_range(noise, 512) < 0.7
    assert patterns.rescaled_range(np.diff(noise), 512) < 0.3 and patterns.rescaled_range(np.zeros(600), 128) is None


def test_range_hurst_windows(spark):
    got = patterns.range_hurst(bars_of(spark, walk(700)), 256, 200).collect()
    assert sorted(r.window for r in got) == [0, 1, 2] and all(r.dimension == pytest.approx(2 - r.hurst) for r in got)


def test_gate_is_not_constant(spark):
    rows = walk(100) + [(1000 + 5 * i, 1006 + 5 * i, 999 + 5 * i, 1005 + 5 * i) for i in range(60)]
    got = {r.regime_gate for r in patterns.regime_gate(bars_of(spark, rows)).collect()}
    assert got == {True, False}


def test_noise_is_the_same_in_every_run_and_keeps_bars_whole(spark):
    bars = bars_of(spark, walk(200))
    a, b = (checks.with_noise(bars.repartition(n), 0.002) for n in (1, 3))
    assert a.exceptAll(b).isEmpty()
    assert a.where("high < greatest(open, close) or low > least(open, close)").isEmpty()
    moved = a.select("bar_no", F.col("close").alias("x")).join(bars, "bar_no").agg(F.stddev(F.col("x") / F.col("close"))).first()[0]
    assert 0.001 < moved < 0.003
    got = checks.noise_check(bars, lambda d: signals.displacement(d, 0.5), "disp_bull", (0.0, 0.05)).collect()
    assert {r.noise: r.label for r in got}[0.0] == "stable" and all(0 <= r.kept <= 1 for r in got)


def test_largest_of_many_blocks(spark):
    rng = np.random.default_rng(2)
    runs = [(i, "good + x" if i % 4 == 0 else f"t{i % 7} + x") for i in range(600)]
    target = [(i, float(rng.normal()) + (1.0 if i % 4 == 0 else 0.0)) for i in range(600)]
    out = {r.token: r for r in reviews.shuffle_test(spark.createDataFrame(runs, "run_id long, idea string"), spark.createDataFrame(target, "run_id long, value double"), 99).collect()}
    assert out["good"].p <= 0.02 and out["x"].p > 0.1 and all(out[f"t{k}"].p > 0.1 for k in range(7))
    assert reviews.shuffle_test(spark.createDataFrame(runs[:8], "run_id long, idea string"), spark.createDataFrame(target, "run_id long, value double"), 9).agg(F.min("p")).first()[0] == 1


def test_verdicts(spark):
    rows = [(0.01, 1.0, 0.2, "EDGE"), (0.01, 1.0, 0.0, "UNCLEAR"), (0.5, 1.0, 0.2, "NOISE"), (0.01, -1.0, 0.2, "NOISE"), (0.1, 1.0, 0.2, "UNCLEAR")]
    d = spark.createDataFrame(rows, "p double, d double, c double, want string")
    assert d.where(reviews.verdict(F.col("p"), F.col("d"), F.col("c")) != F.col("want")).isEmpty()


def test_diverse_choice_equals_greedy_rounds(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{i % 2}", i, [f"w{j}" for j in sorted(rng.choice(6, size=3, replace=False))], float(round(rng.uniform(), 3))) for i in range(40)]
    got = reviews.diverse(spark.createDataFrame(rows, "g string, id long, tokens array<string>, p double"), "g", 5).collect()
    for g in ("g0", "g1"):
        left, chosen = {r[1]: r for r in rows if r[0] == g}, []
        for _ in range(5):
            near = lambda a: max((len(set(a[2]) & set(c[2])) / math.sqrt(len(a[2]) * len(c[2])) for c in chosen), default=0.0)  # noqa: E731, B023
            best = max(left.values(), key=lambda r: (round(0.7 * r[3] - 0.3 * near(r), 12), -r[1]))
            chosen.append(left.pop(best[1]))
        assert [r.id for r in sorted(got, key=lambda r: r.place) if r.g == g] == [c[1] for c in chosen]


def test_diverse_choice_sees_all_candidates(spark):
    rows = [("g", i, ["a", "b"], 0.9 - i / 10_000) for i in range(150)] + [("g", 500, ["c"], 0.6), ("g", 501, ["d"], 0.55), (None, 7, ["a"], 0.5), (None, 8, None, None)]
    got = reviews.diverse(spark.createDataFrame(rows, "g string, id long, tokens array<string>, p double"), "g", 4).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place) if r.g == "g"] == [0, 500, 501, 1]
    assert [(r.place, r.id) for r in sorted(got, key=lambda r: r.place) if r.g is None] == [(1, 7), (2, 8)]


def test_empty_inputs(spark):
    none = bars_of(spark, walk(5)).where("false")
    assert patterns.regime_gate(none).isEmpty() and patterns.range_hurst(none).isEmpty() and checks.entry_statistics(none.withColumn("f", F.lit(True)), {"f": 1}).isEmpty()
    assert checks.sliding_splits(none, 10, 5).isEmpty() and patterns.proximity_flags(none).isEmpty()
