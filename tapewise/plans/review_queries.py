"""Queries over the reviews of runs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import drawn_sql
from ..operators import learner, registry, reviews
from ..sources.bars import read_table
from ..sources.store import stage
from .registry import query
from .registry_queries import _EFFECT, _TARGET, _TIERS, _TOKENS, _target, results_table, runs_table


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each part type is returned stands for how often a block fires."""
    li, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    both = li.join(p, li.l_partkey == p.p_partkey)
    return both.groupBy(F.col("p_type").alias("token")).agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("rate"))


@query("""SELECT token, rate, coalesce(runs, 0) AS runs, mean_pf, CASE WHEN rate = 0 THEN 'dead' WHEN runs IS NULL THEN 'unused' ELSE 'active' END AS status
    FROM (SELECT p_type AS token, round(avg((l_returnflag = 'R')::INT), 6) AS rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) LEFT JOIN
        (SELECT token, count(*) AS runs, round(avg(avg_pf), 6) AS mean_pf FROM toks JOIN tiered USING (run_id) WHERE tier IN ('A', 'B') GROUP BY 1) USING (token)""", toks=_TOKENS, tiered=_TIERS)
def block_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.block_quality(_rates(spark, sf_dir), stage(runs_table(spark, sf_dir), "runs"), registry.tiers(results_table(spark, sf_dir)))


_SHUFFLED = {
    "toks": _TOKENS, "tgt": _TARGET,
    "centred": "SELECT token, run_id, (value - m) / nullif(d, 0) AS c FROM toks JOIN tgt USING (run_id), (SELECT avg(value) AS m, stddev_pop(value) AS d FROM tgt WHERE run_id IN (SELECT run_id FROM build_runs))",
    "zs": "SELECT token, count(*) AS runs, sum(c) / sqrt(count(*)) AS z FROM centred GROUP BY 1",
    "tops": f"""SELECT k, max(z) AS top FROM (SELECT token, k, sum((1 - 2 * ({drawn_sql('3', 'run_id', 'k')} % 2)) * c) / sqrt(count(*)) AS z FROM centred JOIN zs USING (token), (SELECT range AS k FROM range(50)) WHERE runs >= 20 GROUP BY 1, 2) GROUP BY 1""",
    "shuffled": "SELECT token, runs, z, CASE WHEN runs < 20 THEN 1.0 ELSE ((SELECT count(*) FROM tops WHERE top >= z) + 1) / ((SELECT count(*) FROM tops) + 1) END AS p FROM zs",
}


@query("SELECT token, runs, round(z, 6) AS z, round(p, 6) AS p FROM shuffled", **_SHUFFLED)
def block_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.shuffle_test(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"), 50)


@query("""SELECT token, p, delta, CASE WHEN p < 0.05 AND delta > 0 THEN 'EDGE' WHEN p >= 0.2 OR delta <= 0 THEN 'NOISE' ELSE 'UNCLEAR' END AS verdict FROM (
        SELECT token, round(p, 6) AS p, round(w - wo, 6) AS delta FROM shuffled JOIN effect USING (token) WHERE with_n >= 3)""", **_SHUFFLED, effect=_EFFECT)
def block_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, target = stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target")
    both = reviews.shuffle_test(runs, target, 50).join(registry.block_effect(runs, target), "token")
    return both.select("token", "p", "delta", reviews.verdict(F.col("p"), F.col("delta"), F.col("delta")).alias("verdict"))


@query("SELECT run_id, len(w) AS tokens, value AS label FROM (SELECT run_id, string_split(idea, ' + ') AS w FROM build_runs) JOIN tgt USING (run_id)", tgt=_TARGET)
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.feature_rows(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"))
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda t, x: t + x)
    return rows.select("run_id", ones.cast("long").alias("tokens"), "label")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a bounded score of their mean profit factor."""
    r = runs_table(spark, sf_dir).join(_target(spark, sf_dir), "run_id")
    return r.select("session", F.col("run_id").alias("id"), F.round(F.col("value") / 4, 6).alias("p"), F.split("idea", r" \+ ").alias("tokens"))


def _diverse_sql(k: int = 5, weight: float = 0.7) -> tuple[str, dict[str, str]]:
    """One expression for each place: the candidate of a session with the best value against those chosen before."""
    steps = {"cands": "SELECT session, run_id AS id, round(value / 4, 6) AS p, string_split(idea, ' + ') AS t FROM build_runs JOIN tgt USING (run_id)", "tgt": _TARGET}
    for place in range(1, k + 1):
        before = " UNION ALL ".join(f"SELECT session, id, t FROM pick{j}" for j in range(1, place)) or "SELECT NULL AS session, NULL::BIGINT AS id, NULL::VARCHAR[] AS t WHERE false"
        steps[f"had{place}"] = before
        near = f"coalesce((SELECT max(len(list_intersect(c.t, d.t)) / sqrt((len(c.t) * len(d.t))::DOUBLE)) FROM had{place} d WHERE d.session = c.session), 0)"
        steps[f"pick{place}"] = f"""SELECT session, id, p, t FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY v DESC, id) AS r FROM (
            SELECT c.*, ({weight} * c.p - {1 - weight!r}::DOUBLE * {near}) AS v FROM cands c WHERE NOT EXISTS (SELECT 1 FROM had{place} d WHERE d.session = c.session AND d.id = c.id))) WHERE r = 1"""
    return " UNION ALL ".join(f"SELECT session, {j} AS place, id, p FROM pick{j}" for j in range(1, k + 1)), steps


_DIVERSE, _PICKS = _diverse_sql()


@query(_DIVERSE, **_PICKS)
def diverse_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.diverse(_candidates(spark, sf_dir), "session")


@query("""SELECT segment, id, probability, place FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY probability DESC, id) AS place FROM (
        SELECT c_mktsegment AS segment, c_custkey AS id, c_acctbal::DOUBLE AS probability FROM customer WHERE c_nationkey >= 5 AND NOT (c_nationkey >= 10 AND c_acctbal < 0))) WHERE place <= 20""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal").cast("double")
    all_ = c.select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), balance.alias("probability"), F.when(F.col("c_nationkey") < 5, "done").otherwise("pending").alias("status"))
    decisions = c.where((F.col("c_nationkey") >= 10) & (balance < 0)).select(F.col("c_custkey").alias("id"), F.lit("rejected").alias("status"))
    return reviews.review_queue(reviews.decide(all_, decisions), "segment").select("segment", "id", "probability", F.col("place").cast("long").alias("place"))


@query("""SELECT w AS words, l AS numbers, array_to_string(list_transform(best, lambda x: format('{:.4f}', x)), ',') AS best FROM (SELECT count(*) FILTER (regexp_matches(text, '(?i)[a-z]{4}')) AS w, count(*) FILTER (regexp_matches(text, '[0-9]')) AS l FROM conversations),
    (SELECT list(value ORDER BY value DESC) AS best FROM (SELECT value FROM (""" + _TARGET + """) JOIN build_runs USING (run_id) WHERE idea ILIKE '%promo%' ORDER BY value DESC, run_id LIMIT 3))""")
def live_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_table(spark, sf_dir).join(_target(spark, sf_dir), "run_id").withColumnRenamed("value", "holdout_pf")
    out = reviews.live_check(read_table(spark, sf_dir, "conversations"), "text", {"words": "(?i)[a-z]{4}", "numbers": "[0-9]"}, runs, "%promo%")
    return out.withColumn("best", F.array_join(F.transform("best", lambda x: F.format_string("%.4f", x)), ","))


@query("SELECT run_id, string_agg(token, ',' ORDER BY token) AS blocks FROM toks WHERE token IN (SELECT token FROM toks JOIN target USING (run_id) GROUP BY 1 HAVING round(avg(value), 6) < (SELECT round(avg(value), 6) FROM target)) GROUP BY 1", toks=_TOKENS, target=_TARGET)
def locked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, target = stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target")
    effect = registry.tokens(runs).join(target, "run_id").groupBy("token").agg(F.round(F.avg("value"), 6).alias("m"))
    overall = target.agg(F.round(F.avg("value"), 6).alias("_all"))
    status = effect.crossJoin(F.broadcast(overall)).select("token", F.when(F.col("m") < F.col("_all"), "broken").otherwise("fine").alias("status"))  # one row of totals
    return reviews.locked(runs, status)


# what the registry teaches

#: Part types stand for the concepts of an idea.
_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, learner.Learner]:
    """Runs with ideas and tiers, and what is learned from them."""
    tiered = registry.tiers(results_table(spark, sf_dir)).select("run_id", "tier", "avg_pf", "avg_trades", F.lit(None).cast("double").alias("mc"))
    runs = stage(runs_table(spark, sf_dir).join(tiered, "run_id").withColumn("idea", F.concat_ws(" ", "idea", "session")), "runs")
    return runs, learner.fit(runs, F.col("tier").isin("A", "B"), _TYPES)


@query()
def edge_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas of the registry by band, with their mean probability, doubt and novelty."""
    runs, model = _learned(spark, sf_dir)
    found = learner.judged(model, runs.select("idea").distinct().withColumn("id", F.col("idea")), runs)
    return found.groupBy("band").agg(F.count("*").alias("ideas"), F.round(F.avg("prob"), 4).alias("prob"), F.round(F.avg("uncertainty"), 4).alias("uncertainty"), F.round(F.avg("novelty"), 4).alias("novelty"))


@query()
def edge_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the probabilities of runs, judged by what never saw them, lie from what became of them."""
    scores = learner.brier(_learned(spark, sf_dir)[1].scores)
    return scores.select("runs", *[F.round(c, 6).alias(c) for c in ("share", "brier", "brier_of_share")])


#: Common words of four languages stand for concepts, in conversations (the known ideas) and documents (the new ones).
_MARKERS = ("THE", "OF", "AND", "ER", "EN", "IN", "DE", "LA", "LES", "LE", "EAU", "RE", "ST", "ND", "AN", "ON")
_NOVELTY = {
    "markers": f"SELECT {list(_MARKERS)} AS m",
    "fresh": "SELECT doc_id, list_sort(list_filter(m, lambda c: list_contains(string_split_regex(upper(text), '[\\s+]+'), c))) AS s FROM documents, markers",
    "told": "SELECT DISTINCT list_sort(list_filter(m, lambda c: list_contains(string_split_regex(upper(text), '[\\s+]+'), c))) AS t FROM conversations, markers",
    "alike": """SELECT s, max(CASE WHEN len(s) = 0 AND len(t) = 0 THEN 1 WHEN len(s) = 0 OR len(t) = 0 THEN 0
        ELSE len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t)))::DOUBLE END) AS j FROM (SELECT DISTINCT s FROM fresh), told GROUP BY 1""",
}


@query("SELECT doc_id, len(s) AS concepts, round(1 - j, 4) AS novelty FROM fresh JOIN alike USING (s)", **_NOVELTY)
def idea_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = learner.described(read_table(spark, sf_dir, "documents").select("doc_id", "text"), _MARKERS, idea="text").drop("text")
    told = learner.described(read_table(spark, sf_dir, "conversations").select("text"), _MARKERS, idea="text").drop("text")
    return learner.novelty(fresh, told).select("doc_id", F.size("concepts").cast("long").alias("concepts"), "novelty")


_EXPLOIT, _EXPLOITED = _diverse_sql(7)
_EXPLOITED["cands"] = "SELECT * FROM every WHERE p >= 0.4"
_SUGGESTED = f"""WITH best AS ({_EXPLOIT}) SELECT session, 'exploit' AS kind, place, id, p FROM best
    UNION ALL SELECT session, 'explore', place, id, p FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY -ln(({drawn_sql('43', 'id')} + 0.5) / 4294967296.0), id) AS place
        FROM every WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.session = every.session AND b.id = every.id)) WHERE place <= 3"""


@query("SELECT * FROM suggested", **_EXPLOITED, suggested=_SUGGESTED, every="SELECT session, run_id AS id, round(value / 4, 6) AS p, string_split(idea, ' + ') AS t FROM build_runs JOIN tgt USING (run_id)")
def suggested_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner.suggestions(_candidates(spark, sf_dir), "session", 10)


@query()
def token_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute share of each part type in what boosted trees say of a run's profit factor."""
    rows, names = registry.named_features(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"))
    rows = rows.select("run_id", vector_to_array("features").alias("x"), "label")
    nodes, weights, _ = learner.boosted(rows)
    kinds = stage(rows.groupBy("x").agg(F.min("run_id").alias("run_id"), F.count("*").alias("weight")), "kinds")  # equal rows have equal shares
    return learner.mean_attribution(learner.attributions(nodes, weights, kinds), names, kinds.agg(F.sum("weight")).first()[0], kinds.select("run_id", "weight"))
