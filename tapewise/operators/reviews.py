"""Reviews of strategy runs: quality of building blocks, tests over many blocks, verdicts, diverse suggestions, live checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn_odd
from ..sources.store import stage
from .registry import finite, token_set, tokens


def block_quality(rates: DataFrame, runs: DataFrame, tiered: DataFrame) -> DataFrame:
    """Blocks (token, rate: how often they fire) with the number and mean profit factor of the runs of tier A or B that name them.

    ``status``: dead if a block never fires, unused if no such run names it, else active.
    """
    good = tiered.where(F.col("tier").isin("A", "B") & finite("avg_pf")).select("run_id", "avg_pf")
    of = tokens(runs).join(good, "run_id").groupBy("token").agg(F.count("*").alias("runs"), F.round(F.avg("avg_pf"), 6).alias("mean_pf"))
    out = rates.join(of, "token", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    return out.withColumn("status", F.when(F.col("rate") == 0, "dead").when(F.col("runs") == 0, "unused").otherwise("active"))


def shuffle_test(runs: DataFrame, target: DataFrame, resamples: int = 200, least: int = 20, seed: int = 3) -> DataFrame:
    """Per token: z of its mean target against all runs, and p of a value as large for *any* token (max statistic).

    Resamples give each run a weight of +1 or -1 by a hash of run and resample (so runs agree); a token's null z is the weighted
    sum of its centred targets over its spread, and the largest over all tokens of a resample is what a z is held against. Tokens with fewer than
    ``least`` runs have p = 1 and don't take part. A run's weights are drawn once, whatever the number of its tokens: everything is a sum per set of tokens
    first, one for each resample, and then per token.
    """
    rows = target.join(runs.select("run_id"), "run_id").where(F.col("value").isNotNull() & ~F.isnan("value"))
    total = rows.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_d"))
    named = runs.select("run_id", token_set().alias("tokens")).where(F.size("tokens") > 0)
    t = named.join(rows, "run_id").crossJoin(F.broadcast(total)).withColumn("_c", F.try_divide(F.col("value") - F.col("_m"), F.col("_d")))  # one row of totals
    signed = [F.sum(F.when(drawn_odd(seed, "run_id", k), -F.col("_c")).otherwise(F.col("_c"))).alias(f"_s{k}") for k in range(resamples)]
    sets = stage(t.groupBy("tokens").agg(F.count("*").alias("_n"), F.sum("_c").alias("_c"), *signed), "sets")
    of_token = sets.withColumn("token", F.explode("tokens")).groupBy("token").agg(F.sum("_n").alias("runs"), F.sum("_c").alias("_c"), *[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(resamples)])
    seen = of_token.select("token", "runs", (F.col("_c") / F.sqrt("runs")).alias("z"))
    null = of_token.where(F.col("runs") >= least).select("token", F.posexplode(F.array(*[F.col(f"_s{k}") / F.sqrt("runs") for k in range(resamples)])).alias("resample", "_z"))
    largest = null.groupBy("resample").agg(F.max("_z").alias("_top")).agg(F.collect_list("_top").alias("_tops"))  # one row, as long as there are resamples
    out = seen.crossJoin(F.broadcast(largest))
    beaten = F.size(F.filter("_tops", lambda x: x >= F.col("z")))
    p = F.when(F.col("runs") < least, 1.0).otherwise((beaten + 1) / (F.size("_tops") + 1))
    return out.select("token", "runs", F.round("z", 6).alias("z"), F.round(p, 6).alias("p"))


def verdict(p: Column, delta: Column, coefficient: Column) -> Column:
    """EDGE: p below 0.05, positive effect and a coefficient that the penalised regression kept; NOISE: p of 0.2 or more, or no effect; else UNCLEAR."""
    return F.when((p < 0.05) & (delta > 0) & (coefficient != 0), "EDGE").when((p >= 0.2) | (delta <= 0), "NOISE").otherwise("UNCLEAR")


def diverse(candidates: DataFrame, by: str, k: int = 5, weight: float = 0.7) -> DataFrame:
    """Up to ``k`` candidates (``by``, id, tokens, p) of each group by maximal marginal relevance, with ``place`` from 1.

    Each place goes to the largest weight * p - (1 - weight) * (largest cosine of the token sets with those chosen), the smaller
    id in a tie. Of candidates with the same tokens only the first ``k`` ids can be chosen, as they differ in p alone: those are found in one pass. Each place is one
    round over them: they meet the few chosen ones of their group, and the best is a partial aggregate.
    """
    kind = dict(candidates.dtypes)["id"]
    c = candidates.select(F.col(by).alias("_by"), "id", F.col("p").cast("double").alias("p"), F.array_distinct("tokens").alias("t"))
    value = F.struct(F.isnull(weight * F.col("p")).alias("none"), (~F.isnan("p")).alias("number"), (-(weight * F.col("p"))).alias("v"))  # as in a round
    c = c.groupBy("_by", "t", "id").agg(F.min_by("p", value).alias("p"), F.min(value).alias("_v"))
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy("_by", "t").orderBy("_v", "id"))).where(F.col("_k") <= k)
    c = stage(c.select("_by", "id", "p", "t"), "candidates")
    near = "coalesce(array_max(transform(_s, d -> coalesce(size(array_intersect(t, d.t)) / sqrt(double(size(t)) * size(d.t)), 0D))), 0D)"
    value = f"({weight} * p - {1 - weight!r} * {near})"
    pick = f"min(IF(exists(_s, d -> d.id <=> id), NULL, struct({value} IS NULL AS none, NOT isnan({value}) AS number, -{value} AS v, id, p, t))) AS _x"
    chosen = c.select("_by").distinct().withColumn("_s", F.expr(f"cast(array() AS array<struct<id: {kind}, p: double, t: array<string>>>)"))
    for _ in range(k):
        met = c.join(chosen.withColumnRenamed("_by", "_of"), F.col("_by").eqNullSafe(F.col("_of")))
        best = met.groupBy("_by").agg(F.expr(pick), F.first("_s").alias("_s"))
        chosen = stage(best.selectExpr("_by", "IF(_x IS NULL, _s, concat(_s, array(struct(_x.id AS id, _x.p AS p, _x.t AS t)))) AS _s"), "chosen")
    out = chosen.select(F.col("_by").alias(by), F.posexplode("_s").alias("_i", "x"))
    return out.select(by, (F.col("_i") + 1).alias("place"), "x.id", "x.p")


def review_queue(suggestions: DataFrame, by: str, top: int = 20) -> DataFrame:
    """Pending suggestions (id, probability, status) in the order of review, the ``top`` ones of each group."""
    order = Window.partitionBy(by).orderBy(F.col("probability").desc(), "id")
    return suggestions.where("status = 'pending'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions with the status of ``decisions`` (id, status) for pending ones; others keep theirs."""
    new = decisions.groupBy("id").agg(F.max("status").alias("_new"))
    changed = F.when((F.col("status") == "pending") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("status"))
    return suggestions.join(new, "id", "left").withColumn("status", changed).drop("_new")


def live_check(log: DataFrame, text: str, patterns: Mapping[str, str], runs: DataFrame, like: str, top: int = 3) -> DataFrame:
    """One row: lines of a log that match each pattern, and the ``top`` profit factors (``holdout_pf``) of the runs whose idea is like ``like``."""
    counts = log.agg(*[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in patterns.items()])
    best = runs.where(F.col("idea").ilike(like) & finite("holdout_pf")).orderBy(F.col("holdout_pf").desc(), "run_id").limit(top)
    return counts.crossJoin(best.agg(F.sort_array(F.collect_list(F.round("holdout_pf", 6)), asc=False).alias("best")))  # one row each


def locked(runs: DataFrame, status: DataFrame, states: tuple[str, ...] = ("broken", "locked")) -> DataFrame:
    """Runs that name a block whose status (token, status) is one of ``states``, with those blocks in order."""
    bad = status.where(F.col("status").isin(*states)).select("token").distinct()
    return tokens(runs).join(bad, "token").groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("blocks"))


def lockable(runs: DataFrame, tier: str) -> DataFrame:
    """Runs of one tier that no holdout has validated yet: those a holdout run may still be spent on."""
    return runs.where((F.upper("tier") == tier.upper()) & ~F.coalesce(F.col("holdout_validated").cast("boolean"), F.lit(False)))


def quality_failures(runs: DataFrame, least_pf: float, least_trades: int, most_loss: float) -> DataFrame:
    """``failures``: which of the limits a run misses, in and after the holdout: profit factors, trades, degradation (missing values fail)."""
    miss = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    checks = [
        miss(F.col("oos_pf") >= least_pf, "oos_pf"), miss(F.col("holdout_pf") >= least_pf, "holdout_pf"), miss(F.col("oos_trades") >= least_trades, "oos_trades"),
        miss(F.col("holdout_trades") >= least_trades, "holdout_trades"), miss(1 - F.try_divide("holdout_pf", "oos_pf") <= most_loss, "degradation"),
    ]
    return runs.withColumn("failures", F.array_compact(F.array(*checks)))
