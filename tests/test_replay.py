"""Entries, moving exits and zone touches against bar-by-bar versions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.operators import outcomes, signals, zones
from tapewise.sources.bars import keyed, resample

START = datetime(2024, 1, 1)


def walk(spark, n, seed, chunk=50_000, step=1.0):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(size=n) * step)
    open_ = np.concatenate(([100.0], close[:-1])) + rng.normal(size=n) * 0.3
    high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
    rows = [("s", START + timedelta(minutes=k), *map(float, r), 1) for k, r in enumerate(zip(open_, high, low, close))]
    return keyed(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long"), chunk)


def replay(bars, trade, n, trail, activation, even, after_even, stops, targets):
    """One trade, bar by bar: check the exit, then move stop and target."""
    entry_no, d, entry, stop, target = trade
    distance, best, reached = abs(entry - stop), entry, False
    for step in range(1, n + 1):
        if entry_no + step >= len(bars):
            return "timeout", None, None
        b = bars[entry_no + step]
        at_stop = b.low <= stop if d > 0 else b.high >= stop
        at_target = b.high >= target if d > 0 else b.low <= target
        if at_stop or at_target:
            won = at_target and (not at_stop or abs(b.open - target) < abs(b.open - stop))
            return ("target", step, target) if won else ("stop", step, stop)
        best = max(best, b.high) if d > 0 else min(best, b.low)
        tighter = max if d > 0 else min
        if even is not None and d * (best - entry) >= even * distance:
            reached, stop = True, tighter(stop, entry)
        if trail is not None and d * (best - entry) >= activation and (reached or not after_even):
            stop = tighter(stop, best - d * trail)
        if stops and b[stops[d < 0]]:
            stop = tighter(stop, b[stops[d < 0]])
        if targets and b[targets[d < 0]]:
            target = b[targets[d < 0]]
    return "timeout", None, None


@pytest.mark.parametrize("options", [
    {"trail": 2.0, "activation": 3.0}, {"break_even": 1.0}, {"break_even": 0.8, "trail": 1.5, "activation": 0.5, "after_break_even": True}, {"stops": ("lo5", "hi5")},
    {"targets": ("up", "down")}, {"stops": ("lo5", "hi5"), "targets": ("up", "down"), "break_even": 1.2},
])
def test_moving_exits_equal_a_replay(spark, options):
    bars = walk(spark, 260, 3)
    bars = bars.withColumn("lo5", F.when(F.col("bar_no") % 4 == 1, F.col("low") - 1.5).when(F.col("bar_no") % 4 == 2, F.lit(0.0))).withColumn("hi5", F.when(F.col("bar_no") % 4 == 1, F.col("high") + 1.5))
    bars = bars.withColumn("up", F.when(F.col("bar_no") % 5 == 0, F.col("high") + 2.0)).withColumn("down", F.when(F.col("bar_no") % 5 == 0, F.col("low") - 2.0)).withColumn("sig", F.col("bar_no") % 7 == 0)
    events = outcomes.entries(bars, "sig", 1, points=2.5, target_mult=2.0)
    rows = bars.orderBy("bar_no").collect()
    got = {(r.bar_no, r.direction): (r.outcome, r.exit_step, r.exit_price) for r in outcomes.moving_stop_exit(events, bars, 30, **options).collect()}
    assert len(got) == 2 * len([r for r in rows if r.sig and r.bar_no < 259])
    for e in events.collect():
        want = replay(rows, (e.bar_no, e.direction, e.entry, e.stop, e.target), 30, options.get("trail"), options.get("activation", 0.0), options.get("break_even"), options.get("after_break_even", False), options.get("stops"), options.get("targets"))
        outcome, step, price = got[e.bar_no, e.direction]
        assert (outcome, step) == want[:2] and (price is None if want[2] is None else price == pytest.approx(want[2])), e


@pytest.mark.parametrize("clamp,atr_at", [(True, "entry"), (False, "signal")])
def test_entry_options(spark, clamp, atr_at):
    bars = signals.atr(walk(spark, 120, 4, chunk=50)).withColumn("sig", F.col("bar_no").isin(0, 5, 60, 117, 119)).withColumn("top", F.when(F.col("bar_no") == 60, F.col("high"))).withColumn("bottom", F.when(F.col("bar_no") == 60, F.col("low")))
    rows = bars.orderBy("bar_no").collect()
    got = {(r.bar_no, r.direction): r for r in outcomes.entries(bars, "sig", 3, zone=("top", "bottom"), buffer=2.0, session=F.col("bar_no") != 5, clamp=clamp, atr_at=atr_at).collect()}
    want = {}
    for no in (0, 60, 117, 119):
        at = min(no + 3, 119) if clamp else no + 3
        atr = rows[at if atr_at == "entry" else no].atr if at < 120 else None
        for d in (1, -1):
            if at < 120 and atr and atr > 0:
                stop = rows[at].open - d * atr * 1.5 if no != 60 else (rows[60].low - 2 if d > 0 else rows[60].high + 2)
                want[at, d] = (rows[at].open, stop, rows[at].open + d * abs(rows[at].open - stop) * 2)
    assert set(got) == set(want) and all((r.entry, r.stop, r.target) == pytest.approx(want[k]) for k, r in got.items())
    one = outcomes.entries(bars, "sig", 0, points=4.0, direction=-1).collect()
    assert [(r.bar_no, r.direction) for r in sorted(one, key=lambda r: r.bar_no)] == [(1, -1), (6, -1), (61, -1), (118, -1)] and all(r.stop == pytest.approx(r.entry + 4) for r in one)


def first_touches(rows):
    """(side, zone_high, zone_low, bar) of the first bar of each zone's life that holds its middle, bar by bar."""
    out = []
    for side in ("bull", "bear"):
        seen = None
        for r in rows:
            zone = r[f"fvg_{side}_id"]
            if r[f"fvg_{side}"]:
                seen = None
                continue
            high, low = r[f"fvg_{side}_high"], r[f"fvg_{side}_low"]
            if high is not None and seen != zone and r.low <= (high + low) / 2 <= r.high:
                seen = zone
                out.append((side, high, low, r))
    return out


def test_zone_touches_of_both_sides(spark):
    bars = signals.fair_value_gap(walk(spark, 1500, 5, chunk=400, step=2.0))
    rows = bars.orderBy("bar_no").collect()
    touches = first_touches(rows)
    assert {t[0] for t in touches} == {"bull", "bear"}
    want: dict = {}
    for side, high, low, r in touches:
        other = "bear" if side == "bull" else "bull"
        oh, ol = r[f"fvg_{other}_high"], r[f"fvg_{other}_low"]
        over = int(oh is not None and not (high < ol or oh < low))
        held = r.close < (high + low) / 2 if side == "bull" else r.close > (high + low) / 2
        n = want.setdefault((side, over), [0, 0, 0])
        n[0] += 1
        n[1 if held else 2] += 1
    assert {(r.side, r.overlap): [r.touches, r.bounce, r.through] for r in zones.overlap_outcomes(bars).collect()} == want


@pytest.mark.parametrize("nesting", ["contained", "overlap"])
def test_nested_zones(spark, nesting):
    bars = signals.fair_value_gap(walk(spark, 1500, 6, step=2.0)).where("bar_no % 11 <> 4")  # touches may fall between two bars
    higher = signals.fair_value_gap(keyed(resample(walk(spark, 1500, 6, step=2.0), "5 minutes")))
    lower = bars.orderBy("bar_no").collect()
    want: dict = {}
    for side, high, low, r in first_touches(higher.orderBy("bar_no").collect()):
        at = next((b for b in lower if b.ts >= r.ts), None)
        top, bottom = (at[f"fvg_{side}_high"], at[f"fvg_{side}_low"]) if at else (None, None)
        inside = top is not None and (low <= bottom and top <= high if nesting == "contained" else not (high < bottom or top < low))
        want[side, int(inside)] = want.get((side, int(inside)), 0) + 1
    assert {(r.side, r.nested): r.touches for r in zones.nested_zones(bars, higher, nesting=nesting).collect()} == want and len(want) >= 2
