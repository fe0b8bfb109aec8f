"""Exact recursions, distributions and trades that exclude each other, against sequential versions."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.functions.statistics import incomplete_beta, log_gamma, student_p
from tapewise.operators import frames, outcomes, registry, signals, studies
from tapewise.sources.bars import keyed

START = datetime(2024, 1, 1)


def bars_of(spark, series, chunk):
    rows = [(s, START + timedelta(minutes=k), float(v), float(v) + 1, float(v) - 1, float(v), 1) for s, values in series.items() for k, v in enumerate(values)]
    return keyed(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long"), chunk)


@pytest.mark.parametrize("chunk,fade", [(50_000, 0.99), (130, 0.99), (130, 0.5), (7, 0.9), (1, 0.3)])
def test_recursion_equals_sequential(spark, chunk, fade):
    rng = np.random.default_rng(4)
    series = {"a": rng.normal(size=700) * 10, "b": rng.normal(size=130), "c": [5.0]}
    bars = bars_of(spark, series, chunk).withColumn("v", F.when(F.col("bar_no") % 11 != 3, F.col("close")))
    got = {(r.symbol, r.bar_no): (r.y, r.z) for r in frames.recursion(bars, {"y": "v", "z": "open"}, fade).collect()}
    assert len(got) == 831
    for s, values in series.items():
        y = z = 0.0
        for k, v in enumerate(values):
            y, z = fade * y + (0.0 if k % 11 == 3 else v), fade * z + v
            assert got[s, k] == (pytest.approx(y, abs=1e-9), pytest.approx(z, abs=1e-9))


def test_recursion_refuses_other_fades(spark):
    with pytest.raises(ValueError):
        frames.recursion(bars_of(spark, {"a": [1.0]}, 10), {"y": "close"}, 1.0)


def test_ema_and_excitation_equal_sequential(spark):
    rng = np.random.default_rng(5)
    close = 100 + np.cumsum(rng.normal(size=900))
    bars = bars_of(spark, {"a": close}, 200)
    got = {r.bar_no: r for r in studies.ema_trend(bars, 50).collect()}
    ema = close[0]
    for k, c in enumerate(close):
        ema = ema if k == 0 else ema * (1 - 2 / 51) + c * 2 / 51
        assert got[k].ema == pytest.approx(ema, abs=1e-9) and got[k].above_ema == (c > got[k].ema)
    moved = bars.withColumn("open", F.col("close") - F.when(F.col("bar_no") % 3 == 0, 0.9).otherwise(-0.6))
    seen = {r.bar_no: r for r in signals.hawkes_decay(moved).collect()}
    up = down = 0.0
    for k in range(900):
        body = 0.9 / 2 if k % 3 == 0 else -0.6 / 2
        up, down = up * 0.5**0.2 + (body if body >= 0.25 else 0), down * 0.5**0.2 + (-body if body <= -0.25 else 0)
        assert (seen[k].hawkes_bull_excitation, seen[k].hawkes_bear_excitation) == (pytest.approx(up, abs=1e-9), pytest.approx(down, abs=1e-9))


def brute_p(t, df):
    """Two-sided p by Gauss-Legendre over the angle."""
    x, w = np.polynomial.legendre.leggauss(2000)
    low, high = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    angle = (high - low) / 2 * x + (high + low) / 2
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * c * (high - low) / 2 * float(np.sum(w * np.cos(angle) ** (df - 1)))


def test_student_p(spark):
    cases = [(t, df) for t in (0.0, 1e-6, 0.3, 1.0, -1.7, 2.5, 6.0, 40.0) for df in (1.0, 2.0, 2.7, 10.0, 55.5, 1000.0, 30_000.0)]
    got = {(r.t, r.df): r.p for r in spark.createDataFrame(cases, "t double, df double").withColumn("p", student_p(F.col("t"), F.col("df"))).collect()}
    for t, df in cases:
        assert got[t, df] == pytest.approx(brute_p(t, df), abs=1e-8)
    assert got[2.5, 2.0] == pytest.approx(1 - 2.5 / math.sqrt(2 + 2.5**2), abs=1e-10) and got[1.0, 1.0] == pytest.approx(0.5, abs=1e-10)
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (float("nan"), 3.0), (float("inf"), 3.0), (1.0, 0.0)], "t double, df double")
    assert [r.p for r in odd.select(student_p(F.col("t"), F.col("df")).alias("p")).collect()] == [1.0] * 5


def test_gamma_and_beta(spark):
    z = [0.1, 0.5, 1.0, 3.7, 50.0, 4000.0]
    got = [r.g for r in spark.createDataFrame([(v,) for v in z], "z double").select(log_gamma(F.col("z")).alias("g")).collect()]
    assert got == [pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12) for v in z]
    row = spark.range(1).select(*[incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(x)).alias(f"b{i}") for i, x in enumerate((0.0, 0.25, 0.9, 1.0))]).first()
    exact = lambda x: 6 * x**2 - 8 * x**3 + 3 * x**4
    assert list(row) == [pytest.approx(exact(x), abs=1e-12) for x in (0.0, 0.25, 0.9, 1.0)]


def test_welch_of_large_means_and_of_none(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=60)
    runs = spark.createDataFrame([(k, "A + B" if k % 3 else "B" if k % 2 else "C") for k in range(60)], "run_id long, idea string")
    table = lambda add: {r.token: r for r in registry.welch(runs, spark.createDataFrame([(k, float(v + add)) for k, v in enumerate(values)], "run_id long, value double")).collect()}
    plain, lifted = table(0.0), table(1e7)
    a, b = values[[k for k in range(60) if k % 3]], values[::3]
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t, df = (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    assert plain["A"].t == pytest.approx(t, abs=1e-4) and plain["A"].df == pytest.approx(df, abs=0.01) and plain["A"].p == pytest.approx(brute_p(t, df), abs=1e-6)
    assert all(lifted[k].t == pytest.approx(plain[k].t, abs=2e-4) for k in plain)
    same = registry.welch(runs, spark.createDataFrame([(k, 1.0) for k in range(60)], "run_id long, value double")).collect()
    assert same and all(r.t is None and r.p == 1.0 for r in same)


def one_by_one(rows):
    """The trades of one series in order: of those at one bar the last, then each that begins after the one before has ended."""
    last = {}
    for row in rows:
        last[row[0]] = row
    kept, till = [], -1
    for entry in sorted(last):
        if entry > till:
            kept.append(last[entry])
            till = 1 << 62 if last[entry][1] is None else max(last[entry][1], entry)
    return kept


@pytest.mark.parametrize("stretch", [5, 64, 50_000])
def test_dense_trades(spark, monkeypatch, stretch):
    monkeypatch.setattr(outcomes, "TRADE_STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    dense = [(e, int(e + rng.integers(1, 40)), k) for k, e in enumerate(sorted(rng.integers(0, 600, 900).tolist()))]
    every = [(e, e + 3, 1000 + e) for e in range(500)]  # each overlaps the next: no bar without an open trade
    odd = [(5, 2, 1), (6, 6, 2), (7, None, 3), (9, 10, 4), (7, 8, 0)]
    series = {"dense": dense, "every": every, "odd": odd, "one": [(3, 4, 0)]}
    df = spark.createDataFrame([(s, *r) for s, rows in series.items() for r in rows], "symbol string, entry_no long, exit_no long, at long").repartition(5)
    got = {}
    for r in outcomes.without_overlap(df, arrival="at").collect():
        got.setdefault(r.symbol, []).append((r.entry_no, r.exit_no, r.at))
    want = {s: one_by_one(sorted(rows, key=lambda r: r[2])) for s, rows in series.items()}
    assert {s: sorted(rows) for s, rows in got.items()} == want
    assert df.limit(0).transform(lambda d: outcomes.without_overlap(d, arrival="at")).count() == 0


def test_same_bar_does_not_look_at_the_exit(spark):
    rows = [("s", 1, 5, 1, 10.0, 1.0), ("s", 1, 9, -1, 10.0, 2.0), ("s", 6, 7, 1, 10.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, entry_no long, exit_no long, direction int, entry double, pnl double")
    assert sorted(r.pnl for r in outcomes.without_overlap(df).collect()) == [1.0, 3.0]
    late = df.withColumn("arrival", F.when(F.col("pnl") == 2.0, 9).otherwise(1))
    assert sorted(r.pnl for r in outcomes.without_overlap(late, arrival="arrival").collect()) == [2.0]
