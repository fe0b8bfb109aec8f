from datetime import datetime

from tapewise.operators import concepts, ideas
from tapewise.sources import files


def test_signal_shards(spark, tmp_path):
    rows = [("a", datetime(2024, m, 1), True, 1.5, "x") for m in (1, 2)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, hit boolean, level double, note string")
    files.write_signals(bars, str(tmp_path), "one", ("symbol", "ts"))
    files.write_signals(bars.withColumnRenamed("level", "other"), str(tmp_path), "two", ("symbol", "ts"))
    files.write_signals(bars.where("ts < '2024-02-01'"), str(tmp_path), "one", ("symbol", "ts"))  # replaces January only
    got = files.read_signals(spark, str(tmp_path), ["one", "two"])
    assert got.count() == 2 and set(got.columns) == {"symbol", "ts", "hit", "level", "other"}
    assert files.read_signals(spark, str(tmp_path), ["one"], "2024-02").count() == 1


def test_calendar_trades_and_reports(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,time_et,impact,title\n2024-01-15,08:30,HIGH,a\n2024-07-15,08:30,high,b\n2024-07-15,08:30,LOW,c\nbad,xx,HIGH,d\n")
    got = sorted(r.event_ts for r in files.read_calendar(spark, str(tmp_path / "c.csv")).collect())
    assert got == [datetime(2024, 1, 15, 13, 30), datetime(2024, 7, 15, 12, 30)]
    t = spark.createDataFrame([("r1", "s", datetime(2024, 1, 1), datetime(2024, 1, 2), 1, 1.0, 2.0, 1.0)], files.TRADES)
    files.write_trades(t, str(tmp_path / "t"))
    assert files.read_trades(spark, str(tmp_path / "t")).count() == 1
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.md").write_text("# bos + fvg london\n\nTier: A\nOOS PF: 2.10\ntrades: 33\n")
    r = files.parse_reports(spark, str(tmp_path / "r")).first()
    assert (r.idea, r.tier, r.pf, r.num_trades) == ("bos + fvg london", "A", 2.1, 33)
    expected = spark.createDataFrame([("absent.parquet",)], "file string")
    assert files.file_counts(spark, str(tmp_path / "t"), expected).first().fine is False


def test_registry_files(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a + b", "A", 1), (2, "c", "B", 1)], "run_id long, idea string, tier string, created_at int")
    results = spark.createDataFrame([(1, 2, 1.0), (1, 1, 2.0)], "run_id long, rank int, pf double")
    files.export_registry(runs, results, str(tmp_path))
    back = {r.run_id: r for r in spark.read.json(f"{tmp_path}/json").collect()}
    assert [x["rank"] for x in back[1].results] == [1, 2]
    other = spark.createDataFrame([(7, " C ", "A", 3), (8, "c", "A", 2)], "run_id long, idea string, tier string, created_at int")
    more = spark.createDataFrame([(7, 1, 9.0), (8, 1, 5.0)], "run_id long, rank int, pf double")
    assert sorted(map(tuple, files.back_fill(results, runs, other, more).collect())) == [(1, 1, 2.0), (1, 2, 1.0), (2, 1, 9.0)]


def test_discovery_and_ideas(spark):
    df = spark.createDataFrame([(True, 1.0, 2.0, False, 1, 3.0)], "z_bull boolean, z_bull_high double, z_bull_low double, z_bull_filled boolean, n int, prev_day_high double")
    assert concepts.zone_prefixes(df) == ["z"] and concepts.level_columns(df) == ["prev_day_high"] and concepts.flag_columns(df) == ["z_bull", "z_bull_filled"]
    assert concepts.numeric_flags(df) == ["z_bull_high", "n"]
    t = spark.createDataFrame([("BOS + fvg London long, stop 12 pts, trailing",), ("x",), (None,)], "idea string")
    tagged = ideas.tag(t).collect()
    assert tagged[0].concepts == ["BOS", "FVG"] and tagged[0].roles == ["entry", "zone"] and tagged[1].concepts == []
    p = ideas.parse(t).first()
    assert (p.session, p.stop, p.direction, p.trail, p.exit_mode) == ("london", 12.0, 1, False, "fixed")
    assert [len(r.failures) for r in ideas.gate(t).collect()] == [0, 1, 1]
    sample = spark.range(100).selectExpr("id", "id % 3 AS g")
    assert concepts.sampled(sample, ["id"], ["g"], 5).count() == 15


def test_parsed_ideas(spark):
    texts = [
        "fvg standard first touch new york", "FVG std ob chaos long", "macro short bos", "macro short short", "liquidity sweep short", "3. fvg sl: 7.5 pts breakeven trail", "hrl/lrl s_ob htief",
        "tageshoch ob dp TOKYO exit next zone trail", "robot bosses", "session ob ft small", "manipulation + smc fvg, session level",
    ]
    got = {r.idea: r for r in ideas.parse(spark.createDataFrame([(t,) for t in texts], "idea string")).collect()}
    a = got[texts[0]]
    assert a.concepts == ["FVG", "FVG_STD_FT"] and (a.entry, a.zone, a.session, a.stop) == (["FVG_STD_FT"], ["FVG"], "ny", None)
    b = got[texts[1]]
    assert b.entry == ["FVG_STANDARD", "OB_CHAOS"] and b.concepts[-6:] == ["FVG_STD_FT", "FVG_STD_ST50", "FVG_STD_DP", "OB_CHAOS_FT", "OB_CHAOS_ST50", "OB_CHAOS_DP"] and (b.stop, b.direction) == (5.0, 1)
    assert got[texts[2]].direction == 0 and got[texts[2]].timing == ["MACRO_SHORT"] and got[texts[3]].direction == -1
    c = got[texts[4]]
    assert c.entry == ["SWEEP", "MANIP_BEAR"] and c.direction == -1 and c.concepts == ["SWEEP", "MANIP", "MANIP_BEAR"]
    d = got[texts[5]]
    assert (d.stop, d.exit_mode, d.trail) == (7.5, "breakeven_trail", True) and "FVG_STANDARD" in d.entry
    assert got[texts[6]].context == ["HRL_LRL"] and got[texts[6]].stop == 10.0
    e = got[texts[7]]
    assert e.concepts == ["OB", "OB_TAGH_DP", "EXIT_NEXT_ZONE"] or set(e.concepts) == {"OB", "OB_TAGH_DP", "EXIT_NEXT_ZONE"}
    assert (e.session, e.exit_mode) == ("asia", "next_zone") and got[texts[8]].concepts == []
    assert "S_OB_SESS_FT" in got[texts[9]].concepts and "OB_SESSION" not in got[texts[9]].concepts
    assert got[texts[10]].exit_mode == "session_level" and got[texts[10]].entry == ["MANIP"]
    assert len(ideas.CONCEPTS) == 87 and len({c for c, _, _ in ideas.CONCEPTS}) == 87


def test_failures_neighbours_and_hashes(spark):
    t = spark.createDataFrame([("gap fades",), ("Gap",), (" GAP FADE ",), ("other",), ("a gap fade b",), ("",), (None,), ("long winded title and more",)], "idea string")
    failed = spark.createDataFrame([("gap fade",), ("long winded title",), ("",)], "title string")
    assert {r.idea for r in ideas.known_failures(t, failed).collect()} == {"gap fades", "Gap", " GAP FADE ", "a gap fade b", "long winded title and more"}
    base = spark.createDataFrame([(1, ["a", "b"], "NY"), (2, ["c"], "ASIA")], "idea_id int, tokens array<string>, at string")
    words = spark.createDataFrame([("a",), ("z",)], "token string")
    got = sorted((r.idea_id, r.step, r.token, tuple(r.tokens), r.session) for r in ideas.neighbours(base, words, session="at").collect())
    assert got == sorted([
        (1, "remove", "a", ("b",), "NY"), (1, "remove", "b", ("a",), "NY"), (1, "add", "z", ("a", "b", "z"), "NY"), (1, "session", "LONDON", ("a", "b"), "LONDON"), (1, "session", "ASIA", ("a", "b"), "ASIA"),
        (2, "add", "a", ("a", "c"), "ASIA"), (2, "add", "z", ("c", "z"), "ASIA"), (2, "session", "LONDON", ("c",), "LONDON"), (2, "session", "NY", ("c",), "NY"),
    ])
    tried = spark.createDataFrame([(1, ["b"], 1.0), (1, ["a"], 2.0), (2, ["a", "c"], 0.1)], "idea_id int, tokens array<string>, score double")
    own = spark.createDataFrame([(1, 1.5), (2, 0.5)], "idea_id int, score double")
    assert [tuple(r) for r in ideas.best_neighbours(tried, own).collect()] == [(1, ["a"], 2.0)]
