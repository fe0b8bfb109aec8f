"""Cases in which queries once gave other rows than their SQL, or did less than their whole job."""

import datetime

from pyspark.ml.feature import CountVectorizer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import corpus_pipeline
from tapewise.functions.draws import POISSON, drawn, drawn_odd, drawn_poisson
from tapewise.operators import ideas, learner, registry, reviews, studies
from tapewise.plans.registered import QUERIES
from tapewise.sources import files
from tapewise.sources.store import stage
from tapewise.streaming import bars as streams


def test_runs_whose_short_hashes_are_equal_have_their_studies(spark, tmp_path):
    """The MD5s of 3447 and 102617 begin with the same eight digits."""
    spark.createDataFrame([(3447,), (102617,), (12,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["run_id"]: r["study_id"] for r in QUERIES["studies_of_runs"](spark, str(tmp_path)).collect()}
    assert found == {3447: 34471, 102617: None, 12: 120}


def test_distribution_of_no_trades_has_the_row_of_all(spark):
    trades = spark.createDataFrame([("ny", "low", 2.0, 4.0), ("ny", "high", -1.0, -2.0), ("asia", "low", 0.0, 0.0)], "session string, regime string, pnl double, pnl_usd double")
    assert [tuple(r) for r in studies.trade_distribution(trades.limit(0), "session", "regime").collect()] == [(None, None, 0, 0, None, None)]
    found = {(r.session, r.regime): (r.n, r.wins, r.points, r.usd) for r in studies.trade_distribution(trades, "session", "regime").collect()}
    assert found[None, None] == (3, 1, 1.0, 2.0) and found["ny", None] == (2, 1, 1.0, 2.0) and found["asia", "low"] == (1, 0, 0.0, 0.0) and len(found) == 6


def test_watch_tells_of_the_last_bars_too(spark):
    start = datetime.datetime(2024, 1, 1)
    bars = spark.createDataFrame([(s, start + datetime.timedelta(hours=k), f"{k % 3}") for s in ("a", "b") for k in range(50)], "symbol string, ts timestamp, state string")
    lifts = spark.createDataFrame([("a", 1, "0", 2.5)], "symbol string, length int, chain string, lift double")
    table = stage(streams.ended(bars), "bars")
    stream = spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    got = streams.drain(streams.watch_chains(stream, lifts), store=streams.ROCKS)
    assert sorted((r.symbol, r.ts, r.state) for r in got.collect()) == sorted(map(tuple, bars.collect()))
    assert got.where("lift = 2.5").count() == 17  # of a's bars, those after state 0


def test_packing_follows_the_mixture(spark):
    """Two sources take turns, or one comes after the other; the packed sequences show it."""
    rows = [(k, "some words " * (20 + k % 10), "xy"[k // 10 % 2], k) for k in range(3000)]

    def first_half(order):
        docs = spark.createDataFrame(sorted(rows, key=order), "doc_id long, text string, source string, n long").coalesce(1)
        packed = corpus_pipeline.pack(spark, stage(docs, "docs"), "").collect()
        half = (max(r.sequence_id for r in packed) + 1) / 2
        assert sorted(r.doc_id for r in packed) == list(range(3000))
        early = [r.source for r in packed if r.sequence_id < half]
        return early.count("x") / len(early)

    assert first_half(lambda r: (r[2], r[0])) > 0.8 and first_half(lambda r: (r[2] == "x", r[0])) < 0.2 and 0.4 < first_half(lambda r: r[0]) < 0.6


def test_packed_reports_make_few_files(spark, tmp_path):
    texts = spark.range(500).select(F.concat(F.lit("# idea "), F.col("id").cast("string"), F.lit("\n\n**Tier:** B\n- OOS PF: 1.25\n- Trades: 7\n")).alias("value"))
    files.pack_reports(texts.coalesce(2), f"{tmp_path}/r")
    assert len(list((tmp_path / "r").glob("part-*"))) <= 2
    got = files.parse_reports(spark, f"{tmp_path}/r", packed=True)
    assert {tuple(r) for r in got.collect()} == {(f"idea {k}", "B", 1.25, 7) for k in range(500)}


def test_exports_may_be_compressed(spark, tmp_path):
    runs = spark.createDataFrame([(1, "x", "A"), (2, "y", "B")], "run_id long, idea string, tier string")
    results = spark.createDataFrame([(1, 2, 0.5), (1, 1, 1.5)], "run_id long, rank int, pf double")
    files.export_registry(runs, results, str(tmp_path), "gzip")
    assert list((tmp_path / "json").glob("*.json.gz"))
    assert [r.results and r.results[0].pf for r in spark.read.json(f"{tmp_path}/json").orderBy("run_id").collect()] == [1.5, None]


def test_equal_texts_are_parsed_once(spark):
    texts = [(1, "fvg standard london sl 12 pts"), (2, None), (3, "fvg standard london sl 12 pts"), (4, "ob chaos long")]
    got = {r.k: r for r in ideas.parse(spark.createDataFrame(texts, "k long, idea string")).collect()}
    assert len(got) == 4 and got[1].concepts == got[3].concepts and got[1].stop == 12.0 and got[3].session == "london" and got[2].idea is None and got[4].direction == 1


def test_models_of_equal_rows_are_those_of_all_rows(spark):
    rows, names = registry.named_features(*_rows(spark))
    assert registry.alike(rows, "features").count() <= 15 and registry.alike(rows, "features").agg(F.sum("weight")).first()[0] == 240
    whole = GBTRegressor(maxIter=20, maxDepth=3, seed=1).fit(rows).featureImportances.toArray()
    assert max(abs(a - b) for a, b in zip(whole, registry.tree_importance(rows), strict=True)) < 1e-6
    weights = dict(zip(names, registry.lasso(rows, strengths=(0.001,)), strict=True))
    assert weights["a"] > 0.1 and weights["b"] < 0 and weights["c"] < 0 and abs(weights["d"]) < 0.05
    old = CountVectorizer(inputCol="words", outputCol="f", binary=True).fit(rows)
    assert sorted(old.vocabulary) == sorted(names)


def test_shares_of_equal_rows_are_weighed(spark):
    rows = registry.named_features(*_rows(spark))[0].select("run_id", F.transform("words", lambda w: w).alias("w"), "label")
    rows = stage(rows.select("run_id", F.array(*[F.array_contains("w", t).cast("double") for t in "abcd"]).alias("x"), "label"), "rows")
    nodes, weights, _ = learner.boosted(rows, trees=4)
    kinds = stage(rows.groupBy("x").agg(F.min("run_id").alias("run_id"), F.count("*").alias("weight")), "kinds")
    one = {r.token: r.weight for r in learner.mean_attribution(learner.attributions(nodes, weights, rows), "abcd", 240).collect()}
    two = {r.token: r.weight for r in learner.mean_attribution(learner.attributions(nodes, weights, kinds), "abcd", 240, kinds.select("run_id", "weight")).collect()}
    assert one["a"] > 0 and all(abs(one[t] - two[t]) < 2e-6 for t in "abcd")


def test_signs_are_drawn_once_for_a_run(spark):
    ids = spark.range(300).select(F.col("id").alias("run_id"))
    assert ids.where((drawn(3, "run_id", 17) % 2 == 1) != drawn_odd(3, "run_id", 17)).count() == 0
    plan = reviews.shuffle_test(*_rows(spark), 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # draws are summed by set of tokens before tokens are named


def test_choice_keeps_the_first_of_equal_tokens(spark):
    rows = [("g", k, ["a", "b"][: 1 + k % 2], (k * 37 % 101) / 101) for k in range(400)] + [("g", 3, ["a", "b"], 0.999), ("g", 500, ["a"], None)]
    got = [r.id for r in reviews.diverse(spark.createDataFrame(rows, "g string, id long, tokens array<string>, p double"), "g", 4).orderBy("place").collect()]
    chosen = []
    near = lambda t, u: len(set(t) & set(u)) / (len(t) * len(u)) ** 0.5
    for _ in range(4):
        left = [r for r in rows if r[1] not in [c[1] for c in chosen] and r[3] is not None]
        chosen.append(min(left, key=lambda r: (-(0.7 * r[3] - (1 - 0.7) * max([near(r[2], c[2]) for c in chosen], default=0)), r[1])))
    assert got == [c[1] for c in chosen] and got[0] == 3


def test_resamples_are_drawn_for_many_trades_at_once(spark):
    """Draws equal their MD5s whatever the length of an id; a trade is one row for 50 resamples, not one for each."""
    ids = [None, "", "é-1", "日本", *("x" * n for n in (3, 44, 50, 51, 52, 53, 54, 55, 60, 63, 64, 110, 116, 130, 200)), *(f"{k}-{k % 7}-{k * 31}" for k in range(900, 1100))]
    rows = [((None, "a", "b")[k % 3], t, None if k % 11 == 0 else (k * 37 % 100 - 49.5) / 10) for k, t in enumerate(ids)] + [("c", "only", None), ("d", "nan", float("nan")), ("e", "up", float("inf"))]
    trades = spark.createDataFrame(rows, "run string, trade_id string, pnl double").repartition(3)
    u = drawn(7, "trade_id", "k") % 1_000_000 / 1_000_000.0
    each = lambda n: trades.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("w", sum(((u >= c).cast("int") for c in POISSON), F.lit(0)))
    told = trades.select("run", "trade_id", F.posexplode(drawn_poisson(F.lit(95), 25, 7, "trade_id")).alias("k", "w")).select("run", "trade_id", (F.col("k") + 95).alias("k"), F.col("w").cast("int").alias("w"))
    want = each(120).where("k >= 95").select("run", "trade_id", "k", "w")
    assert told.count() == 25 * len(rows) and told.exceptAll(want).count() == 0
    for n in (1, 3, 50, 120):
        totals = each(n).groupBy("run", "k").agg(F.round(F.sum(F.col("w") * F.col("pnl")), 9).alias("t"))
        want = totals.groupBy("run").agg(F.round(F.avg((F.col("t") > 0).cast("int")), 6).alias("profitable"))
        assert set(map(tuple, registry.monte_carlo(trades, "run", n).collect())) == set(map(tuple, want.collect()))
    assert registry.monte_carlo(trades.limit(0), "run", 50).count() == 0
    plan = registry.monte_carlo(trades, "run", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "sequence(0, 49, 1" not in plan
