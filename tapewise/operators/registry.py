"""Analytics over the registry of strategy runs: ranking, tiers, overfitting checks, building blocks, models."""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn, drawn_poisson
from ..functions.statistics import student_p
from ..sources.store import stage

#: Profit factors at or above this one are artefacts of tiny losses and don't count.
ARTEFACT = 500.0
#: Most tokens that become features, the most frequent ones.
VOCABULARY = 1 << 18
#: Resamples whose totals are summed side by side, as columns.
RESAMPLES = 50
TIER_A, TIER_B, TIER_A_TRADES, MOST_PBO = 2.0, 1.5, 20, 0.5


def finite(pf: str = "pf") -> Column:
    """A profit factor that counts: finite and positive."""
    c = F.col(pf)
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def tiers(windows: DataFrame, pbo: str | None = None) -> DataFrame:
    """Per run of (run_id, pf, num_trades) windows: avg_pf over those that count, avg_trades over all, tier and robust.

    A: avg_pf >= 2 on 20 trades or more, unless the probability of overfitting is known to be 0.5 or more (values outside
    of 0..1 are unknown); B: avg_pf >= 1.5; else C. Robust: every window has trades and a profit factor above 1.
    """
    out = windows.groupBy("run_id").agg(
        F.round(F.avg(F.when(finite(), F.col("pf"))), 9).alias("_pf"), F.avg(F.coalesce("num_trades", F.lit(0))).alias("_n"), F.count("*").alias("windows"),
        F.bool_and((F.coalesce("num_trades", F.lit(0)) > 0) & (F.coalesce("pf", F.lit(0.0)) > 1)).alias("robust"), *([F.max(pbo).alias("_pbo")] if pbo else []),
    )
    known_bad = F.coalesce(F.col("_pbo").between(0, 1) & (F.col("_pbo") >= MOST_PBO), F.lit(False)) if pbo else F.lit(False)
    tier = F.when((F.col("_pf") >= TIER_A) & (F.col("_n") >= TIER_A_TRADES) & ~known_bad, "A").when(F.col("_pf") >= TIER_B, "B").otherwise("C")
    return out.select("run_id", "windows", F.bround("_pf", 4).alias("avg_pf"), F.bround("_n", 4).alias("avg_trades"), tier.alias("tier"), "robust")


def tier_counts(tiered: DataFrame) -> DataFrame:
    """Runs per tier, and the total under 'all'."""
    counts = tiered.rollup("tier").agg(F.count("*").alias("runs"), F.count_if("robust").alias("robust"))
    return counts.select(F.coalesce("tier", F.lit("all")).alias("tier"), "runs", "robust")


def scored(results: DataFrame) -> DataFrame:
    """score = pf * (1 + max(0, win rate - 0.58)) - drawdown / 100 + min(1, trades / 100) / 10, and warnings as an array."""
    drawdown = F.coalesce("drawdown", F.lit(0.0)) if "drawdown" in results.columns else F.lit(0.0)
    score = F.col("pf") * (1 + F.greatest(F.lit(0.0), F.col("winrate") - 0.58)) - drawdown / 100 + F.least(F.lit(1.0), F.col("num_trades") / 100) * 0.1
    warn = F.array_compact(F.array(F.when(F.col("num_trades") < 30, "few trades"), F.when(F.col("pf") > 3, "profit factor too good"), F.when(F.col("winrate") > 0.65, "win rate too good")))
    return results.withColumn("score", score).withColumn("warnings", warn)


def ranked(results: DataFrame, least_trades: int = 20, top: int = 1) -> DataFrame:
    """The ``top`` results of each run by score among those with enough trades; among all if none has."""
    run = Window.partitionBy("run_id")
    enough = (F.col("num_trades") >= least_trades).cast("int")
    out = results.withColumn("_any", F.max(enough).over(run)).where((F.col("_any") == 0) | (enough == 1))
    return out.withColumn("place", F.row_number().over(run.orderBy(F.col("score").desc(), "rank"))).where(F.col("place") <= top).drop("_any")


def runs_with_best(runs: DataFrame, results: DataFrame) -> DataFrame:
    """All runs, with the profit factor of their best result; runs without one come last in any order by ``sort_pf``."""
    best = results.groupBy("run_id").agg(F.max("pf").alias("best_pf"), F.count("*").alias("results"))
    return runs.join(best, "run_id", "left").withColumn("sort_pf", F.coalesce("best_pf", F.lit(-1.0)))


def rolling_windows(bars: DataFrame, n: int = 3, ratio: float = 0.75) -> DataFrame:
    """Bars with the rolling windows that they belong to: window, phase (is or oos).

    Per symbol of N bars, the in-sample part has int(N * ratio) bars, the out-of-sample part int(N * (1 - ratio) / n), and
    window i starts i out-of-sample parts in. Windows past the end, or with an empty part, are left out.
    """
    size = bars.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_n"))
    size = size.withColumn("_is", F.floor(F.col("_n") * ratio)).withColumn("_oos", F.floor(F.col("_n") * (1 - ratio) / n)).where("_is > 0 and _oos > 0")
    windows = size.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_from", F.col("window") * F.col("_oos"))
    windows = windows.where("_from + _is + _oos <= _n")
    met = bars.join(windows, "symbol").where("bar_no >= _from and bar_no < _from + _is + _oos")
    return met.withColumn("phase", F.when(F.col("bar_no") < F.col("_from") + F.col("_is"), "is").otherwise("oos")).drop("_n", "_is", "_oos", "_from")


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of parameter values, numbered; the axes are short lists."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.withColumn("config_id", F.xxhash64(*axes))


def best_config(performance: DataFrame, by: list[str], least_trades: int = 5) -> DataFrame:
    """Best row of each group by pf * (1 + win rate) - drawdown / 100; 0 for fewer than ``least_trades`` trades."""
    value = F.coalesce("pf", F.lit(0.0)) * (1 + F.col("win_rate")) - F.coalesce("max_drawdown", F.lit(0.0)) / 100
    p = performance.withColumn("objective", F.when(F.col("trades") >= least_trades, value).otherwise(0.0))
    order = Window.partitionBy(*by).orderBy(F.col("objective").desc(), "config_id")
    return p.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def parameter_importance(results: DataFrame, parameters: list[str], by: str = "run_id") -> DataFrame:
    """Share of the variance of pf between the values of each parameter, averaged over the groups ``by``; none counts as 0."""
    long = results.select(by, "pf", F.expr(f"stack({len(parameters)}, {', '.join(f'{p!r}, cast(`{p}` AS string)' for p in parameters)}) AS (parameter, value)"))
    cells = long.groupBy(by, "parameter", "value").agg(F.count("*").alias("n"), F.sum("pf").alias("s"), F.sum(F.col("pf") * F.col("pf")).alias("q"))
    cells = cells.groupBy(by, "parameter").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    mean2 = F.col("S") * F.col("S") / F.col("N")
    share = F.coalesce(F.when(F.col("Q") - mean2 > 1e-9, (F.col("B") - mean2) / (F.col("Q") - mean2)), F.lit(0.0))
    return cells.groupBy("parameter").agg(F.count("*").alias("groups"), F.round(F.avg(share), 6).alias("importance"))


def sensitivity(results: DataFrame, parameters: list[str], buckets: int = 5) -> DataFrame:
    """Per parameter: mean pf in equal-width buckets of its range, and the stability 1 / (deviation of the means + 0.001)."""
    r = results.where(F.col("pf") < ARTEFACT)
    long = r.select("pf", F.expr(f"stack({len(parameters)}, {', '.join(f'{p!r}, cast(`{p}` AS double)' for p in parameters)}) AS (parameter, value)")).where("value is not null")
    span = long.groupBy("parameter").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    place = F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))
    b = long.join(F.broadcast(span), "parameter").where("_hi > _lo").groupBy("parameter", place.alias("bucket")).agg(F.count("*").alias("n"), F.avg("pf").alias("_m"))
    dev = F.stddev_pop("_m").over(Window.partitionBy("parameter"))
    return b.select("parameter", "bucket", "n", F.round("_m", 6).alias("mean_pf"), F.round(1 / (dev + 0.001), 4).alias("stability"))


def tokens(runs: DataFrame, idea: str = "idea", separator: str = r"\s*\+\s*") -> DataFrame:
    """(run_id, token) of the distinct building blocks that ideas name, joined by +."""
    return runs.select("run_id", F.explode(F.array_distinct(F.filter(F.split(F.trim(idea), separator), lambda t: t != ""))).alias("token"))


def token_set(idea: str = "idea", separator: str = r"\s*\+\s*") -> Column:
    """The distinct building blocks that an idea names, in order; empty if none."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.split(F.trim(idea), separator), lambda t: t != ""))), F.array().cast("array<string>"))


def block_effect(runs: DataFrame, target: DataFrame, least: int = 3) -> DataFrame:
    """Per token: runs with and without it and their mean target (run_id, value); 'without' is the rest of the totals."""
    t = tokens(runs).join(target, "run_id")
    total = target.join(runs.select("run_id"), "run_id").agg(F.count("*").alias("_n"), F.sum("value").alias("_s"))
    per = t.groupBy("token").agg(F.count("*").alias("with_n"), F.sum("value").alias("_w"))
    per = per.crossJoin(F.broadcast(total))  # one row of totals
    per = per.withColumn("without_n", F.col("_n") - F.col("with_n")).withColumn("with_mean", F.col("_w") / F.col("with_n")).withColumn("without_mean", F.try_divide(F.col("_s") - F.col("_w"), F.col("without_n")))
    out = per.withColumn("delta", F.col("with_mean") - F.col("without_mean")).where(F.col("with_n") >= least)
    return out.select("token", "with_n", "without_n", *[F.round(c, 6).alias(c) for c in ("with_mean", "without_mean", "delta")])


def welch(runs: DataFrame, target: DataFrame, least: int = 3) -> DataFrame:
    """Welch's t, its degrees of freedom and its two-sided p for each token, from the moments of the runs with and without it.

    Sums of squares are taken about the means. Without any variance t and df are null and p is 1.
    """
    moments = lambda p: (F.count("*").alias(f"{p}n"), F.avg("value").alias(f"{p}m"), (F.var_pop("value") * F.count("*")).alias(f"{p}q"))
    per = tokens(runs).join(target, "run_id").groupBy("token").agg(*moments("a"))
    per = per.crossJoin(F.broadcast(target.join(runs.select("run_id"), "run_id").agg(*moments("t"))))  # one row of totals
    per = per.withColumn("bn", F.col("tn") - F.col("an")).where(f"an >= {least} and bn >= {least}")
    per = per.withColumn("bm", F.col("am") + (F.col("tm") - F.col("am")) * F.col("tn") / F.col("bn"))
    apart = F.pow(F.col("am") - F.col("bm"), 2) * F.col("an") * F.col("bn") / F.col("tn")
    per = per.withColumn("bq", F.greatest(F.col("tq") - F.col("aq") - apart, F.lit(0.0)))
    var = lambda p: F.col(f"{p}q") / (F.col(f"{p}n") - 1) / F.col(f"{p}n")
    per = per.withColumn("_va", var("a")).withColumn("_vb", var("b")).withColumn("_v", F.col("_va") + F.col("_vb"))
    per = per.withColumn("_t", F.try_divide(F.col("am") - F.col("bm"), F.sqrt("_v")))
    per = per.withColumn("_df", F.try_divide(F.col("_v") * F.col("_v"), F.col("_va") * F.col("_va") / (F.col("an") - 1) + F.col("_vb") * F.col("_vb") / (F.col("bn") - 1)))
    return per.select("token", F.col("an").alias("with_n"), F.round("_t", 4).alias("t"), F.round("_df", 2).alias("df"), F.round(student_p(F.col("_t"), F.col("_df")), 6).alias("p"))


def pair_synergy(runs: DataFrame, target: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of tokens in common runs: mean target together, and the interaction with the means of each alone."""
    t = tokens(runs).join(target, "run_id")
    single = t.groupBy("token").agg(F.avg("value").alias("m"))
    a, b = t.select("run_id", F.col("token").alias("a"), "value"), t.select("run_id", F.col("token").alias("b"))
    both = a.join(b, "run_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("value").alias("_m")).where(F.col("n") >= least)
    overall = target.join(runs.select("run_id"), "run_id").agg(F.avg("value").alias("_all"))
    both = both.join(single.select(F.col("token").alias("a"), F.col("m").alias("_a")), "a").join(single.select(F.col("token").alias("b"), F.col("m").alias("_b")), "b").crossJoin(F.broadcast(overall))
    return both.select("a", "b", "n", F.round("_m", 6).alias("mean"), F.round(F.col("_m") - F.col("_a") - F.col("_b") + F.col("_all"), 6).alias("interaction"))


def mutual_information(runs: DataFrame, target: DataFrame, bins: int = 4) -> DataFrame:
    """Mutual information (nats) of having a token with the quantile bin of the target."""
    q = target.join(runs.select("run_id"), "run_id").agg(F.percentile("value", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_q"))
    binned = target.join(runs.select("run_id"), "run_id").crossJoin(F.broadcast(q)).withColumn("bin", F.size(F.filter("_q", lambda x: x < F.col("value")))).drop("_q")
    total = binned.groupBy("bin").agg(F.count("*").alias("nb"))
    n = Window.partitionBy()
    total = total.withColumn("N", F.sum("nb").over(n))  # one row for each bin
    has = tokens(runs).join(binned, "run_id").groupBy("token", "bin").agg(F.count("*").alias("k"))
    cells = has.select("token").distinct().crossJoin(F.broadcast(total)).join(has, ["token", "bin"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    cells = cells.withColumn("nt", F.sum("k").over(Window.partitionBy("token")))
    term = lambda k, t: F.when(k > 0, k / F.col("N") * F.ln(k * F.col("N") / (t * F.col("nb")))).otherwise(0.0)
    yes, no = term(F.col("k"), F.col("nt")), term(F.col("nb") - F.col("k"), F.col("N") - F.col("nt"))
    return cells.groupBy("token").agg(F.round(F.sum(yes + no), 6).alias("mi"))


def pf_trend(runs: DataFrame, pf: str = "avg_pf") -> DataFrame:
    """Per idea (trimmed, lower case): first and last profit factor in time, delta, trend and whether an edge decayed."""
    r = runs.where(F.col(pf) < ARTEFACT).withColumn("idea", F.lower(F.trim("idea")))
    order = F.struct("created_at", "run_id")
    out = r.groupBy("idea").agg(F.count("*").alias("runs"), F.min_by(pf, order).alias("first"), F.max_by(pf, order).alias("last"))
    d = F.col("last") - F.col("first")
    out = out.withColumn("delta", F.round(d, 6)).withColumn("trend", F.when(d > 0.1, "up").when(d < -0.1, "down").otherwise("flat"))
    return out.withColumn("decayed", (F.col("first") >= 2.0) & (F.col("last") < 1.5))


def holdout_class(runs: DataFrame) -> DataFrame:
    """class and degradation of runs with avg_oos_pf, holdout_pf and holdout_trades."""
    loss = 1 - F.try_divide("holdout_pf", "avg_oos_pf")
    kind = (
        F.when(F.coalesce("holdout_trades", F.lit(0)) < 10, "not validated").when(F.col("holdout_pf") >= 0.8 * F.col("avg_oos_pf"), "real edge")
        .when(F.col("holdout_pf") >= 1, "partial").when(loss > 0.5, "curve-fitted").otherwise("regime shift")
    )
    return runs.withColumn("degradation", F.round(loss, 6)).withColumn("class", kind)


def monte_carlo(trades: DataFrame, by: str, resamples: int = 200, seed: int = 7) -> DataFrame:
    """Share of resamples (with replacement) of a group's trades whose total is positive; draws come from hashes, so runs agree.

    A Poisson(1) weight stands for how often a resample draws a trade, so each trade is weighted on its own.
    A trade is one row with its weights in RESAMPLES resamples, not a row for each of them.
    """
    times = min(resamples, RESAMPLES)
    every = trades.select(by, "pnl", "trade_id", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(times))).alias("_first"))
    every = every.withColumn("_w", drawn_poisson(F.col("_first"), times, seed, "trade_id"))
    sums = [F.round(F.sum(F.col("_w")[k].cast("int") * F.col("pnl")), 9) for k in range(times)]
    totals = every.groupBy(by, "_first").agg(F.array(*sums).alias("_sums")).select(by, "_first", F.posexplode("_sums").alias("_k", "_t"))
    return totals.where(F.col("_first") + F.col("_k") < resamples).groupBy(by).agg(F.round(F.avg((F.col("_t") > 0).cast("int")), 6).alias("profitable"))


def overfitting(series: DataFrame, splits: int = 8) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    ``series``: (trial, block, pnl) with blocks 0..splits-1. For each half of the blocks the trial that is best there is ranked
    on the other half; the result is the share of halves where it ranks below the median. Of trials that tie the smallest is the best.
    Trials meet only in partial aggregates by half.
    """
    of_block = [F.round(F.coalesce(F.sum(F.when(F.col("block") == b, F.col("pnl"))), F.lit(0.0)), 9) for b in range(splits)]
    halves = [h for h in range(1 << splits) if h.bit_count() == splits // 2]
    split = series.groupBy("trial").agg(F.array(*of_block).alias("sums")).select("trial", "sums", F.explode(F.array(*map(F.lit, halves))).alias("half"))
    side = lambda bit: F.expr(f"round(aggregate(transform(sums, (s, i) -> IF(getbit(half, i) = {bit}, s, 0.0D)), 0.0D, (a, s) -> a + s), 9)")
    split = split.select("half", "trial", side(1).alias("inside"), side(0).alias("outside"))
    best = split.groupBy("half").agg(F.min_by("outside", F.struct(-F.col("inside"), "trial")).alias("chosen"))  # a row a half, whatever the trials
    rank = F.count(F.when(F.col("outside") < F.col("chosen"), 1)) / F.greatest(F.count("*") - 1, F.lit(1))
    ranks = split.join(F.broadcast(best), "half").groupBy("half").agg(rank.alias("rank"))
    return ranks.agg(F.count("*").alias("halves"), F.round(F.avg((F.col("rank") < 0.5).cast("int")), 6).alias("pbo"))


def feature_rows(runs: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of ``named_features``."""
    return named_features(runs, target)[0]


def named_features(runs: DataFrame, target: DataFrame) -> tuple[DataFrame, list[str]]:
    """run_id, tokens as a sparse 0/1 vector over their vocabulary, and the target as label (not finite: 0); and that vocabulary."""
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("words"))))
    rows = runs.select("run_id", token_set().alias("words")).groupBy("run_id").agg(words.alias("words")).where(F.size("words") > 0).join(target, "run_id")
    value = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value"))
    rows = stage(rows.withColumn("label", value), "features")
    counts = rows.groupBy("words").count().select(F.explode("words").alias("token"), "count").groupBy("token").agg(F.sum("count").alias("n"))
    vocabulary = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]
    if not vocabulary:
        raise ValueError("no run with a target names a token")
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features").setBinary(True)
    return model.transform(rows), vocabulary


def alike(rows: DataFrame, x: str, *by: str) -> DataFrame:
    """Rows of equal features ``x`` (and ``by``) as one, with their mean label, ``weight`` (how many) and ``within`` (squares of their labels about that mean).

    Squared errors of a model of ``x`` are those of the means, by weight, plus what lies within, which no model changes: a fit on these rows is one on all.
    """
    met = rows.groupBy(*by, x).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"), (F.var_pop("label") * F.count("*")).alias("within"))
    return stage(met, "alike")


def with_token(runs: DataFrame, fragment: str) -> DataFrame:
    """Runs whose idea holds the first word of ``fragment``, and the others ('with', 'without'): n, mean profit factors, shares of tier A and B and of robust runs.

    ``runs`` has idea, tier, robust, avg_pf and holdout_pf; runs without avg_pf are left out, missing holdouts don't count.
    """
    word = fragment.split()[0].upper()
    r = runs.where(F.col("avg_pf").isNotNull()).withColumn("runs", F.when(F.contains(F.upper(F.coalesce("idea", F.lit(""))), F.lit(word)), "with").otherwise("without"))
    part = lambda c: F.round(100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")), 2)
    return r.groupBy("runs").agg(
        F.count("*").alias("n"), F.round(F.avg("avg_pf"), 3).alias("avg_pf"), F.round(F.coalesce(F.avg("holdout_pf"), F.lit(0.0)), 3).alias("holdout_pf"),
        part(F.upper("tier") == "A").alias("tier_a"), part(F.upper("tier") == "B").alias("tier_b"), part(F.col("robust")).alias("robust"),
    )


def applied(best: DataFrame, performance: DataFrame, by: list[str]) -> DataFrame:
    """The configuration that was best in sample (``best``: by, config_id, objective) with what it did out of sample (``performance``)."""
    out = performance.select(*by, "config_id", F.col("trades").alias("oos_trades"), F.col("total").alias("oos_total"), F.col("pf").alias("oos_pf"))
    return best.join(out, [*by, "config_id"], "left").withColumn("oos_trades", F.coalesce("oos_trades", F.lit(0)))


def lasso(rows: DataFrame, strengths: tuple[float, ...] = (0.001, 0.01, 0.1), folds: int = 5, seed: int = 1) -> list[float]:
    """Coefficients of an L1 regression on standardised token features, its strength chosen by cross-validation; zeros are noise.

    Runs are dealt into ``folds`` by a hash of run_id; runs of a fold with equal features are fitted as one row of their weight.
    """
    met = alike(rows.withColumn("fold", (drawn(seed, "run_id") % folds).cast("int")), "features", "fold")
    a, w = F.posexplode(vector_to_array("features")).alias("at", "v"), F.col("weight")
    spread = met.select(a, "weight").groupBy("at").agg(F.sum(w).alias("n"), F.sum(w * F.col("v")).alias("s"), F.sum(w * F.col("v") * F.col("v")).alias("q")).orderBy("at").collect()
    deviations = [math.sqrt(max(r.q - r.s * r.s / r.n, 0.0) / max(r.n - 1, 1)) for r in spread]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([1 / d if d else 0.0 for d in deviations]), inputCol="features", outputCol="x").transform(met).cache()
    model = lambda data, s: LinearRegression(featuresCol="x", weightCol="weight", elasticNetParam=1.0, regParam=s).fit(data)
    present = [r.fold for r in scaled.select("fold").distinct().collect()]

    def error(strength: float) -> float:
        """Mean of the root mean squared errors of the folds."""
        found = []
        for f in present:
            tried = model(scaled.where(F.col("fold") != f), strength).transform(scaled.where(F.col("fold") == f))
            found.append(tried.agg(F.sqrt((F.sum(F.pow(F.col("prediction") - F.col("label"), 2) * w) + F.sum("within")) / F.sum(w))).first()[0])
        return sum(found) / len(found)

    best = min(strengths, key=error) if len(present) > 1 else strengths[0]
    out = model(scaled, best).coefficients.toArray().tolist()
    scaled.unpersist()
    return out


def tree_importance(rows: DataFrame, seed: int = 1) -> list[float]:
    """Feature importances of boosted regression trees: shares of the gain (``learner.attributions`` has each row's shares)."""
    return GBTRegressor(maxIter=20, maxDepth=3, seed=seed, weightCol="weight").fit(alike(rows, "features")).featureImportances.toArray().tolist()


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``current`` and ``new`` by key; a new value wins unless it is null."""
    a, b = current.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    names = [*current.columns, *[c for c in new.columns if c not in current.columns]]
    pick = [F.coalesce(*[F.col(f"{s}.{c}") for s, cols in (("b", new.columns), ("a", current.columns)) if c in cols]).alias(c) for c in names]
    return a.join(b, on, "full_outer").select(*pick)


def best_of_idea(ideas: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """Ideas (idea) with the best result (pf; ties by run and rank) of any run of the same text, blanks around it and case aside."""
    key = F.lower(F.trim("idea"))
    best = runs.select("run_id", key.alias("_i")).join(results.where(finite()), "run_id").groupBy("_i").agg(F.max_by(F.struct("run_id", "pf"), F.struct("pf", -F.col("run_id"))).alias("_x"))
    return ideas.withColumn("_i", key).join(best, "_i").select(*ideas.columns, "_x.run_id", "_x.pf")


def not_run(ideas: DataFrame, runs: DataFrame) -> DataFrame:
    """Ideas that no run has tried, blanks around the text and case aside."""
    key = F.lower(F.trim("idea"))
    return ideas.withColumn("_i", key).join(runs.select(key.alias("_i")), "_i", "left_anti").drop("_i")


def study_of(runs: DataFrame, studies: DataFrame, windows: int = 3) -> DataFrame:
    """Runs (run_id, idea_hash) with the study (name, study_id) of their first window that has one; null without any."""
    named = runs.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).withColumn("name", F.concat("idea_hash", F.lit("_w"), F.col("_w").cast("string")))
    found = named.join(studies.groupBy("name").agg(F.min("study_id").alias("study_id")), "name").groupBy("run_id").agg(F.min_by("study_id", "_w").alias("study_id"))
    return runs.join(found, "run_id", "left")


def idea_grid(entries: DataFrame, filters: DataFrame, sessions: DataFrame, most: int = 1_000_000) -> DataFrame:
    """All ideas 'entry + filter session' of three short lists (entry, filter, session), each text once; refuses more than ``most``."""
    sizes = [x.count() for x in (entries, filters, sessions)]
    if sizes[0] * sizes[1] * sizes[2] > most:
        raise ValueError(f"{sizes} combine to more than {most} ideas")
    every = entries.crossJoin(F.broadcast(filters)).crossJoin(F.broadcast(sessions))  # their product is checked above
    return every.select(F.concat("entry", F.lit(" + "), "filter", F.lit(" "), "session").alias("idea")).distinct()


def filled_metadata(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs whose missing session comes from the text (london, ny, asia, the first found) and whose missing robust flag comes from their windows."""
    low = F.lower(F.coalesce("idea", F.lit("")))
    session = F.when(F.contains(low, F.lit("london")), "london").when(F.contains(low, F.lit("ny")), "ny").when(F.contains(low, F.lit("asia")), "asia")
    robust = results.groupBy("run_id").agg(F.bool_and((F.coalesce("pf", F.lit(0.0)) > 1) & (F.coalesce("num_trades", F.lit(0)) > 0)).alias("_robust"))
    out = runs.join(robust, "run_id", "left")
    return out.withColumn("session", F.coalesce("session", session)).withColumn("robust", F.coalesce("robust", "_robust")).drop("_robust")


def group_profiles(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Per set of groups (token, grp) that an idea's blocks belong to ('Unknown' for others): runs, mean profit factor and win rate (missing: 0)."""
    named = tokens(runs).join(groups, "token", "left").withColumn("grp", F.coalesce("grp", F.lit("Unknown")))
    profile = named.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("grp")), " + ").alias("profile"))
    zero = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(c)
    return profile.join(runs.select("run_id", "pf", "winrate"), "run_id").groupBy("profile").agg(F.count("*").alias("runs"), zero("pf"), zero("winrate"))
