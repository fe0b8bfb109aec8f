"""Operators on hand-built and random bars: no look-ahead, independence of the chunk length, rules against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.operators import frames, joins, levels, outcomes, registry, signals, zones
from tapewise.sources import bars as source

START = datetime(2024, 3, 4)


def walk(n, seed=1, symbol="s", start=0):
    rng, rows, price = random.Random(seed), [], 1000.0
    for k in range(n):
        o, c = price, price + rng.uniform(-6, 6)
        rows.append((symbol, START + timedelta(hours=start + k), o, max(o, c) + rng.uniform(0, 4), min(o, c) - rng.uniform(0, 4), c, rng.randint(1, 50)))
        price = c
    return rows


def frame(spark, rows, chunk=source.CHUNK):
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long")
    return source.keyed(df, chunk)


SIGNALS = {
    "fvg": lambda b: signals.fair_value_gap(b), "aged": lambda b: signals.fair_value_gap(b, max_age=5), "bos": signals.break_of_structure, "disp": signals.displacement,
    "entry": lambda b: signals.displacement_entry(b, volume_n=10), "range": signals.dealing_range, "adx": signals.adx, "ker": signals.efficiency_ratio,
    "states": signals.states, "masks": signals.regime_masks, "levels": signals.previous_levels, "inside": signals.inside_day, "ou": signals.ou_half_life,
    "flow": signals.order_flow, "hawkes": signals.hawkes_decay, "opening": signals.opening_range, "hurst": lambda b: signals.hurst(b, 40, (2, 6)),
}


def values(df, upto=None):
    skip = {"chunk", "chunk_len"}
    cols = sorted(c for c in df.columns if c not in skip)
    rows = df.where(F.col("bar_no") < upto).select(cols).collect() if upto else df.select(cols).collect()
    return sorted((tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", SIGNALS)
def test_signals_neither_look_ahead_nor_depend_on_chunks(spark, name):
    rows = walk(140) + walk(60, 2, "t", 7)
    whole = SIGNALS[name](frame(spark, rows))
    got = values(whole)
    assert len(got) == 200
    assert values(SIGNALS[name](frame(spark, rows, 37))) == got
    short = SIGNALS[name](frame(spark, [r for r in rows if r[1] < START + timedelta(hours=96)]))
    if name not in ("levels", "inside"):  # their periods are whole calendar days here
        assert values(short.where("symbol = 's'"), 90) == values(whole.where("symbol = 's'"), 90)


def test_gap_zones_follow_the_rule(spark):
    rows = walk(300, 5)
    got = {r.bar_no: r for r in signals.fair_value_gap(frame(spark, rows, 50)).collect()}
    zone = None
    for k, (_, _, _, high, low, _, _) in enumerate(rows):
        filled = zone is not None and low <= zone[0]
        if filled:
            zone = None
        new = k >= 2 and low - rows[k - 2][3] > 0
        if new:
            zone = (rows[k - 2][3], low)
        r = got[k]
        assert (r.fvg_bull, r.fvg_bull_active, r.fvg_bull_filled) == (new, zone is not None, filled)
        assert (r.fvg_bull_low, r.fvg_bull_high) == (zone or (None, None))


def test_running_values_across_chunks(spark):
    b = frame(spark, walk(50), 7).withColumn("v", F.when(F.col("bar_no") % 9 == 4, F.col("bar_no"))).withColumn("one", F.lit(1))
    got = {r.bar_no: (r.before, r.now, r.n) for r in frames.running_sum(frames.carried(frames.carried(b, {"now": "v"}), {"before": "v"}, including=False), "one", "n").collect()}
    for k in range(50):
        seen = [x for x in range(k + 1) if x % 9 == 4]
        assert got[k] == (([x for x in seen if x < k] or [None])[-1], (seen or [None])[-1], k + 1)


def test_zone_episode_outcomes(spark):
    # a bull gap between 10 and 12 is born at bar 2, touched at 4, broken at 6; price is back two bars later
    shape = [(9, 10, 8), (10, 13, 9.5), (13, 14, 12), (14, 15, 13), (13, 14, 11), (12, 13, 11), (10, 12, 9), (9, 9.5, 8.5), (9, 11, 9), (9, 10, 9)]
    rows = [("s", START + timedelta(hours=k), c, h, lo, c, 1) for k, (c, h, lo) in enumerate(shape)]
    bars = signals.fair_value_gap(frame(spark, [(*r[:2], *map(float, r[2:6]), 1) for r in rows]))
    z = zones.zone_bars(bars).where("side = 'bull'")
    e = zones.episodes(z).first()
    assert (e.entry, e.far, e.born_no, e.touch_no, e.fill_no, e.deepest) == (12, 10, 2, 4, 6, 9)
    r = zones.returns(z, bars).first()
    assert (r.back_after, r.excursion) == (2, 1.5)


def test_moving_stops_against_a_loop(spark):
    rows = walk(200, 9)
    rng = random.Random(4)
    events = []
    for k in range(5, 150, 3):
        d = rng.choice([1, -1])
        events.append(("s", k, d, rows[k][2], rows[k][2] - d * 6.0, rows[k][2] + d * 15.0))
    ev = spark.createDataFrame(events, "symbol string, bar_no long, direction int, entry double, stop double, target double")
    got = {(r.bar_no, r.direction): r for r in outcomes.moving_stop_exit(ev, frame(spark, rows, 64), 60, trail=5.0, activation=7.0, break_even=1.0).collect()}
    for _, k, d, entry, stop, target in events:
        best, now, want = entry * d, stop * d, ("timeout", None)
        for i in range(1, 61):
            if k + i >= len(rows):
                break
            _, _, o, h, lo, _, _ = rows[k + i]
            hi, down = (h, lo) if d > 0 else (-lo, -h)
            if best - entry * d >= entry * d - stop * d:
                now = max(now, entry * d)
            if best - entry * d >= 7:
                now = max(now, best - 5)
            if down <= now and hi >= target * d:
                want = ("target" if abs(target * d - o * d) < abs(now - o * d) else "stop", i)
            elif down <= now:
                want = ("stop", i)
            elif hi >= target * d:
                want = ("target", i)
            if want[1]:
                break
            best = max(best, hi)
        r = got[k, d]
        assert (r.outcome, r.exit_step) == want


def test_trades_do_not_overlap(spark):
    t = spark.createDataFrame([("s", 1, 5, 1.0), ("s", 5, 6, 2.0), ("s", 6, 9, 3.0), ("s", 10, 11, 4.0), ("t", 2, 3, 5.0)], "symbol string, entry_no long, exit_no long, pnl double")
    kept = outcomes.without_overlap(t)
    assert sorted(r.pnl for r in kept.collect()) == [1.0, 3.0, 4.0, 5.0]


def test_asof_in_both_directions(spark):
    at = lambda h: START + timedelta(hours=h)
    left = spark.createDataFrame([("s", at(h), h) for h in (0, 5, 800, 2000)], "symbol string, ts timestamp, h long")
    right = spark.createDataFrame([("s", at(h), float(h)) for h in (1, 5, 700, 1500)], "symbol string, ts timestamp, v double")
    back = {r.h: r.v for r in joins.asof(left, right, ["v"]).collect()}
    ahead = {r.h: r.v for r in joins.asof(left, right, ["v"], forward=True).collect()}
    assert back == {0: None, 5: 5.0, 800: 700.0, 2000: 1500.0} and ahead == {0: 1.0, 5: 5.0, 800: 1500.0, 2000: None}


def test_fuzzy_duplicates_lose_no_pair(spark):
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(12)]
    sets = {k: sorted(set(rng.choices(vocabulary, k=rng.randint(2, 8)))) for k in range(60)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in sets.items()], "id long, t string")
    got = {tuple(r) for r in joins.fuzzy_duplicates(df, "id", F.split("t", " ")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and abs(len(sets[a]) - len(sets[b])) <= 2 and len(set(sets[a]) & set(sets[b])) >= 0.8 * min(len(sets[a]), len(sets[b]))}
    assert got == want


def test_level_touch_sides(spark):
    rows = [("s", START + timedelta(hours=k), 1.0, h, lo, c, 1) for k, (h, lo, c) in enumerate([(12.0, 11.0, 11.5), (11.5, 9.5, 10.5), (10.4, 9.0, 9.5)])]
    b = frame(spark, rows).withColumn("line", F.lit(10.0))
    r = levels.touches(b, ["line"]).collect()
    assert [(x.bar_no, x.side, x.bounced, x.wick) for x in r] == [(1, "above", True, 0.5)]


def test_tiers_and_overfitting(spark):
    w = spark.createDataFrame([(1, 2.5, 30), (1, 2.1, 20), (2, float("inf"), 5), (2, 1.6, 50), (3, None, None), (4, 2.5, 40)], "run_id long, pf double, num_trades int").withColumn("pbo", F.when(F.col("run_id") == 4, 0.7))
    got = {r.run_id: (r.tier, r.robust) for r in registry.tiers(w, "pbo").collect()}
    assert got == {1: ("A", True), 2: ("B", True), 3: ("C", False), 4: ("B", True)}
    good = [(t, b, float(t)) for t in range(4) for b in range(8)]
    assert registry.overfitting(spark.createDataFrame(good, "trial int, block int, pnl double")).first().pbo == 0.0


def test_readers(spark, tmp_path):
    spark.createDataFrame(walk(30), "Symbol string, TS timestamp, Open double, High double, Low double, Close double, Volume long").write.parquet(str(tmp_path / "p"))
    b = source.read_bars(spark, str(tmp_path / "p"), "2024-03-04 05:00:00", "2024-03-04 10:00:00")
    assert b.columns[:2] == ["symbol", "ts"] and b.count() == 5
    b.write.option("header", True).csv(str(tmp_path / "c"))
    assert source.read_bars_csv(spark, str(tmp_path / "c"), 2).count() == 2
    with pytest.raises(ValueError):
        source.fold_case(spark.range(1))


def test_events_with_nulls_and_equal_events(spark):
    b = frame(spark, walk(40), 64)
    at = b.where("bar_no = 5").first()
    rows = [(at.symbol, 5, 1, at.close, at.close - 1e6, at.close - 1.0, note) for note in (None, "x", "x")]
    ev = spark.createDataFrame(rows, "symbol string, bar_no long, direction int, entry double, stop double, target double, note string")
    got = outcomes.first_barrier(ev, b, 20).collect()
    assert len(got) == 3 and {(r.outcome, r.exit_step) for r in got} == {("target", 1)}
    assert len(outcomes.moving_stop_exit(ev, b, 20, trail=5.0).collect()) == 3


def test_overlaps_and_drawdowns_over_stretches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("s", int(e), int(e + rng.integers(0, 6)), float(rng.normal())) for e in rng.choice(400, 150, replace=False)]
    df = spark.createDataFrame(rows, "symbol string, entry_no long, exit_no long, pnl double")
    kept, till = [], -1
    for _, entry, end, pnl in sorted(rows):
        if entry > till:
            kept.append((entry, end, pnl))
            till = end
    total = np.cumsum([r[2] for r in kept])
    fall = float(np.max(np.maximum(np.maximum.accumulate(total), 0) - total))
    for stretch in (7, 50_000):
        monkeypatch.setattr(outcomes, "TRADE_STRETCH", stretch)
        got = outcomes.without_overlap(df)
        assert sorted((r.entry_no, r.exit_no, r.pnl) for r in got.collect()) == kept
        assert abs(outcomes.max_drawdown(got, "symbol").first().max_drawdown - fall) < 1e-5
        assert np.allclose([r.total for r in outcomes.running_points(got, "symbol").orderBy("entry_no").collect()], total)


def test_flow_and_reversion_fire_as_they_should(spark):
    up = [("u", START + timedelta(hours=k), 100.0 + k, 101.2 + k, 99.8 + k, 101.0 + k, 10) for k in range(30)]
    down = [("u", START + timedelta(hours=30 + k), 130.0 - k, 130.2 - k, 128.8 - k, 129.0 - k, 10) for k in range(3)]
    doji = [("d", START + timedelta(hours=k), 100.0, 101.0, 99.0, 100.1, 10) for k in range(30)]
    h = {(r.symbol, r.bar_no): r for r in signals.hawkes_decay(frame(spark, up + down + doji)).collect()}
    assert all(h["u", k].hawkes_bull_passes for k in range(15, 30)) and h["u", 32].hawkes_decay_bull and not h["u", 32].hawkes_bull_passes
    assert max(h["d", k].hawkes_bull_excitation for k in range(30)) < 0.1
    o = {(r.symbol, r.bar_no): r for r in signals.order_flow(frame(spark, up)).collect()}
    assert all(o["u", k].ofi_signal == 1 and o["u", k].ofi_bull_passes for k in range(14, 30)) and o["u", 13].ofi_slow is None and o["u", 13].ofi_signal == 0
    rng = np.random.default_rng(1)
    x, ou, walked = 0.0, [], np.cumsum(rng.normal(size=300)) + 100
    for _ in range(300):
        x += -0.5 * x + 0.3 * rng.normal()
        ou.append(100 + x)
    bars = [(s, START + timedelta(hours=k), float(c), float(c) + 0.1, float(c) - 0.1, float(c), 10) for s, series in (("ou", ou), ("rw", walked)) for k, c in enumerate(series)]
    got = signals.ou_half_life(frame(spark, bars)).toPandas()
    late = got[got.bar_no >= 120]
    assert late[late.symbol == "ou"].ou_is_stationary.mean() > 0.7 and late[late.symbol == "rw"].ou_is_stationary.mean() < 0.3
    assert got[got.bar_no < 59].ou_half_life.isna().all()
    assert (got[got.ou_bull_passes].close < got[got.ou_bull_passes].ou_mean_level).all() and got.ou_bull_passes.any() and got.ou_bear_passes.any()
