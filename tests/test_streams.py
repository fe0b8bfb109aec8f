"""Stateful streams against batch results when bars arrive in any order, and a calendar that is a stream."""

import random
from datetime import datetime, timedelta


from tapewise.operators import joins, signals
from tapewise.sources.bars import keyed
from tapewise.streaming import bars as streams

START = datetime(2024, 1, 1)


def arriving(spark, df, tmp_path, parts):
    """A stream of the rows in the order of ``parts``, lists of row numbers, one file each."""
    rows = df.collect()
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def shuffled(n, reach, size, seed):
    """Row numbers, each at most ``reach`` places late, in parts."""
    draw = random.Random(seed)
    order = sorted(range(n), key=lambda i: i + draw.random() * reach)
    return [order[i : i + size] for i in range(0, n, size)]


def test_zones_of_bars_in_any_order(spark, tmp_path):
    draw, close, rows = random.Random(3), 100.0, []
    for k in range(240):
        close += draw.gauss(0, 2)
        rows.append(("s", START + timedelta(hours=k), close, close + draw.random(), close - draw.random(), close, 1))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long").orderBy("ts")
    stream = arriving(spark, bars, tmp_path, shuffled(240, 12, 30, 1))
    got = {r.ts: (r.new, r.active, r.filled, r.zone_low, r.zone_high) for r in streams.drain(streams.gap_zone_stream(stream), store=streams.ROCKS).collect()}
    batch = {r.ts: (r.fvg_bull, r.fvg_bull_active, r.fvg_bull_filled, r.fvg_bull_low, r.fvg_bull_high) for r in signals.fair_value_gap(keyed(bars)).collect()}
    assert len(got) >= 210 and all(batch[ts] == seen for ts, seen in got.items()) and max(got) == rows[len(got) - 1][1]
    assert any(seen[2] for seen in got.values())


def test_chains_of_bars_in_any_order(spark, tmp_path):
    draw = random.Random(5)
    rows = [(s, START + timedelta(hours=k), draw.choice("CDN")) for k in range(120) for s in ("a", "b")]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, state string").orderBy("ts", "symbol")
    lifts = spark.createDataFrame([(s, len(c), "→".join(c), float(v)) for s in ("a", "b") for c, v in (("C", 1.5), ("D", 0.5), ("CD", 2.5), ("CDN", 3.5))], "symbol string, length int, chain string, lift double")
    stream = arriving(spark, bars, tmp_path, shuffled(240, 20, 60, 2))
    got = {(r.symbol, r.ts): (r.state, r.lift, r.grade) for r in streams.drain(streams.watch_chains(stream, lifts), store=streams.ROCKS).collect()}
    known = {(r.symbol, r.chain): r.lift for r in lifts.collect()}
    for s in ("a", "b"):
        states = [r[2] for r in rows if r[0] == s]
        for k, state in enumerate(states):
            if (s, START + timedelta(hours=k)) in got:
                lift = next((known[s, c] for n in (3, 2, 1) if k >= n and (s, c := "→".join(states[k - n : k])) in known), None)
                grade = "D" if lift is None or lift < 1 else "C" if lift < 2 else "B" if lift < 3 else "A"
                assert got[s, START + timedelta(hours=k)] == (state, lift, grade)
    assert len(got) >= 180


def test_silent_symbols_are_forgotten(spark, tmp_path):
    rows = [("a", START + timedelta(hours=k), 10.0 + k, 9.5 + k) for k in range(4)] + [("b", START + timedelta(hours=k), 10.0, 9.0) for k in range(0, 24 * 12)] + [("a", START + timedelta(days=11), 30.0, 29.0), ("b", START + timedelta(days=13), 10.0, 9.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, high double, low double")
    parts = [list(range(4 + 24 * k * 3, 4 + 24 * (k + 1) * 3)) for k in range(4)]
    stream = arriving(spark, bars, tmp_path, [list(range(4)), *parts, [len(rows) - 2, len(rows) - 1]])
    got = {(r.symbol, r.ts): r.new for r in streams.drain(streams.gap_zone_stream(stream, idle_days=3), store=streams.ROCKS).collect()}
    assert got["a", START + timedelta(hours=2)] is True and got["a", START + timedelta(days=11)] is False  # its first bar again: no gap to what was forgotten


def test_calendar_as_a_stream(spark, tmp_path):
    draw = random.Random(8)
    bars = spark.createDataFrame([("s", START + timedelta(minutes=7 * k)) for k in range(600)], "symbol string, ts timestamp").orderBy("ts")
    events = spark.createDataFrame([(START + timedelta(seconds=draw.randrange(600 * 420)),) for _ in range(60)] + [(START,)] * 2, "event_ts timestamp").orderBy("event_ts")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    left = arriving(spark, bars, tmp_path / "a", shuffled(600, 100, 150, 3))
    right = arriving(spark, events, tmp_path / "b", shuffled(62, 5, 31, 4))
    got = sorted(r.ts for r in streams.drain(streams.near_calendar_stream(left, right)).collect())
    assert got == sorted(r.ts for r in joins.near_events(bars, events).collect()) and len(got) > 20
    assert streams.near_calendar_stream(left, right).schema.names == ["symbol", "ts"]
