"""Queries over the registry of runs and over idea texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn_sql
from ..operators import ideas, joins, registry, signals
from ..sources.bars import keyed, keyed_event_bars, order_bars, read_table
from ..sources.store import stage
from .registry import query


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each order line."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = read_table(spark, sf_dir, "lineitem")
    number = lambda c: F.col(c).cast("double")
    return lines.select(
        F.col("l_orderkey").alias("run_id"), F.row_number().over(order).alias("rank"), (0.5 + number("l_quantity") / 20.0).alias("pf"), F.col("l_quantity").cast("int").alias("num_trades"),
        (0.3 + number("l_discount") * 4).alias("winrate"), number("l_tax").alias("param_tax"), number("l_discount").alias("param_discount"),
    )


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each order with lines; its idea names the part types."""
    o, li, p = (read_table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    types = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), " + ").alias("idea"))
    session = F.when(F.col("o_orderstatus") == "F", "LONDON").when(F.col("o_orderstatus") == "O", "NY").otherwise("ASIA")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), session.alias("session")).join(types, "run_id")


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean profit factor per run."""
    return results_table(spark, sf_dir).groupBy("run_id").agg(F.avg("pf").alias("value"))


_TIERS = """SELECT run_id, count(*) AS windows, round_even(avg(pf), 4) AS avg_pf, round_even(avg(num_trades), 4) AS avg_trades,
        CASE WHEN round(avg(pf), 9) >= 2 AND avg(num_trades) >= 20 THEN 'A' WHEN round(avg(pf), 9) >= 1.5 THEN 'B' ELSE 'C' END AS tier, bool_and(num_trades > 0 AND pf > 1) AS robust FROM results GROUP BY 1"""
_TARGET = "SELECT run_id, avg(pf) AS value FROM results GROUP BY 1"
_TOKENS = "SELECT DISTINCT run_id, unnest(string_split(idea, ' + ')) AS token FROM build_runs"


@query("SELECT run_id, windows, tier, robust FROM tiered", tiered=_TIERS)
def run_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tiers(results_table(spark, sf_dir)).select("run_id", "windows", "tier", "robust")


@query("SELECT coalesce(tier, 'all') AS tier, count(*) AS runs, count(*) FILTER (robust) AS robust FROM tiered GROUP BY ROLLUP (tier)", tiered=_TIERS)
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tier_counts(registry.tiers(results_table(spark, sf_dir)))


_SCORED = "SELECT *, pf * (1 + greatest(0, winrate - 0.58)) + least(1.0, num_trades / 100) * 0.1 AS score FROM results"


@query("""SELECT run_id, rank, round(score, 6) AS score, pf FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, rank) AS place FROM (
        SELECT *, max((num_trades >= 20)::INT) OVER (PARTITION BY run_id) AS enough FROM scored) WHERE enough = 0 OR num_trades >= 20) WHERE place = 1""", scored=_SCORED)
def best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.ranked(registry.scored(results_table(spark, sf_dir))).select("run_id", "rank", F.round("score", 6).alias("score"), "pf")


@query("SELECT o_orderkey AS run_id, best_pf, results, coalesce(best_pf, -1) AS sort_pf FROM orders LEFT JOIN (SELECT run_id, max(pf) AS best_pf, count(*) AS results FROM results GROUP BY 1) r ON run_id = o_orderkey")
def runs_with_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return registry.runs_with_best(runs, results_table(spark, sf_dir))


@query("""SELECT symbol, "window", phase, count(*) AS bars, round(sum(close), 4) AS closes FROM (
        SELECT b.symbol, w AS "window", CASE WHEN bar_no < w * oos + ins THEN 'is' ELSE 'oos' END AS phase, close FROM numbered b JOIN sized s USING (symbol), (SELECT unnest([0, 1, 2]) AS w)
        WHERE bar_no >= w * oos AND bar_no < w * oos + ins + oos AND w * oos + ins + oos <= n) GROUP BY 1, 2, 3""",
    numbered="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM days",
    sized="SELECT symbol, count(*) AS n, CAST(floor(count(*) * 0.75) AS BIGINT) AS ins, CAST(floor(count(*) * 0.25 / 3) AS BIGINT) AS oos FROM days GROUP BY 1")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stage(keyed(order_bars(spark, sf_dir)), "days")
    return registry.rolling_windows(bars).groupBy("symbol", "window", "phase").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("closes"))


@query("""SELECT parameter, count(*) AS groups, round(avg(CASE WHEN q - s * s / n > 1e-9 THEN (b - s * s / n) / (q - s * s / n) ELSE 0 END), 6) AS importance FROM (
        SELECT run_id, parameter, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM (
            SELECT run_id, parameter, value, count(*) AS n, sum(pf) AS s, sum(pf * pf) AS q FROM (UNPIVOT (SELECT run_id, pf, param_tax, param_discount FROM results) ON param_tax, param_discount INTO NAME parameter VALUE value) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def parameter_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.parameter_importance(results_table(spark, sf_dir), ["param_tax", "param_discount"])


@query("""SELECT parameter, bucket, n, round(m, 6) AS mean_pf, round(1 / (stddev_pop(m) OVER (PARTITION BY parameter) + 0.001), 4) AS stability FROM (
        SELECT parameter, CAST(least(floor((value - lo) / (hi - lo) * 5), 4) AS BIGINT) AS bucket, count(*) AS n, avg(pf) AS m FROM (
            SELECT *, min(value) OVER (PARTITION BY parameter) AS lo, max(value) OVER (PARTITION BY parameter) AS hi FROM (UNPIVOT (SELECT pf, param_tax, param_discount FROM results WHERE pf < 500) ON param_tax, param_discount INTO NAME parameter VALUE value))
        WHERE hi > lo GROUP BY 1, 2)""")
def parameter_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sensitivity(results_table(spark, sf_dir), ["param_tax", "param_discount"])


_EFFECT = """SELECT token, count(*) AS with_n, any_value(tn) - count(*) AS without_n, avg(value) AS w, (any_value(ts) - sum(value)) / nullif(any_value(tn) - count(*), 0) AS wo FROM toks JOIN tgt USING (run_id),
        (SELECT count(*) AS tn, sum(value) AS ts FROM tgt WHERE run_id IN (SELECT run_id FROM build_runs)) GROUP BY 1"""


@query("SELECT token, with_n, without_n, round(w, 6) AS with_mean, round(wo, 6) AS without_mean, round(w - wo, 6) AS delta FROM effect WHERE with_n >= 3", toks=_TOKENS, tgt=_TARGET, effect=_EFFECT)
def block_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.block_effect(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"))


#: p by integrating the density over t = sqrt(df) tan(angle) with Simpson's rule.
_WELCH = {
    "toks": _TOKENS, "tgt": _TARGET, "known": "SELECT * FROM tgt WHERE run_id IN (SELECT run_id FROM build_runs)",
    "sides": """SELECT token, count(*) FILTER (has) AS an, count(*) FILTER (NOT has) AS bn, avg(value) FILTER (has) AS am, avg(value) FILTER (NOT has) AS bm,
        var_samp(value) FILTER (has) / count(*) FILTER (has) AS va, var_samp(value) FILTER (NOT has) / count(*) FILTER (NOT has) AS vb
        FROM (SELECT n.token, k.value, t.run_id IS NOT NULL AS has FROM (SELECT DISTINCT token FROM toks) n CROSS JOIN known k LEFT JOIN toks t ON t.token = n.token AND t.run_id = k.run_id) GROUP BY 1""",
    "tested": """SELECT token, an, (am - bm) / sqrt(nullif(va + vb, 0)) AS t, (va + vb) * (va + vb) / nullif(va * va / (an - 1) + vb * vb / (bn - 1), 0) AS df FROM sides WHERE an >= 3 AND bn >= 3""",
    "angles": "SELECT *, atan(abs(t) / sqrt(df)) / 4000 AS w, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) AS c FROM tested",
}


@query("""SELECT token, an AS with_n, round(t, 4) AS t, round(df, 2) AS df,
        round(coalesce(1 - 2 * c * w / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * w), df - 1))), 1), 6) AS p FROM angles""", **_WELCH)
def block_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.welch(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"))


@query("""SELECT a, b, n, round(m, 6) AS mean, round(m - x.s - y.s + (SELECT avg(value) FROM tgt WHERE run_id IN (SELECT run_id FROM build_runs)), 6) AS interaction FROM (
        SELECT p.token AS a, q.token AS b, count(*) AS n, avg(p.value) AS m FROM tv p JOIN tv q ON p.run_id = q.run_id AND p.token < q.token GROUP BY 1, 2 HAVING count(*) >= 5)
        JOIN single x ON x.token = a JOIN single y ON y.token = b""", toks=_TOKENS, tgt=_TARGET, tv="SELECT * FROM toks JOIN tgt USING (run_id)", single="SELECT token, avg(value) AS s FROM tv GROUP BY 1")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.pair_synergy(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"))


@query("""SELECT token, round(sum(CASE WHEN k > 0 THEN k / n * ln(k * n / (nt * nb)) ELSE 0 END + CASE WHEN nb - k > 0 THEN (nb - k) / n * ln((nb - k) * n / ((n - nt) * nb)) ELSE 0 END), 6) AS mi FROM (
        SELECT t.token, b.bin, b.nb, b.n, coalesce(h.k, 0)::DOUBLE AS k, sum(coalesce(h.k, 0)::DOUBLE) OVER (PARTITION BY t.token) AS nt FROM (SELECT DISTINCT token FROM toks) t, bins b LEFT JOIN cells h ON h.token = t.token AND h.bin = b.bin) GROUP BY 1""",
    toks=_TOKENS, tgt=_TARGET, known="SELECT * FROM tgt WHERE run_id IN (SELECT run_id FROM build_runs)",
    binned="SELECT run_id, (value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT AS bin FROM known, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM known)",
    bins="SELECT bin, count(*)::DOUBLE AS nb, sum(count(*)) OVER ()::DOUBLE AS n FROM binned GROUP BY 1", cells="SELECT token, bin, count(*) AS k FROM toks JOIN binned USING (run_id) GROUP BY 1, 2")
def block_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.mutual_information(stage(runs_table(spark, sf_dir), "runs"), stage(_target(spark, sf_dir), "target"))


@query("""SELECT idea, runs, round(first, 6) AS first, round(last, 6) AS last, trend, first >= 2 AND last < 1.5 AS decayed FROM (
        SELECT *, CASE WHEN last - first > 0.1 THEN 'up' WHEN last - first < -0.1 THEN 'down' ELSE 'flat' END AS trend FROM (
            SELECT lower(trim(split_part(idea, ' + ', 1))) AS idea, count(*) AS runs, arg_min(value, {'c': created_at, 'r': run_id}) AS first, arg_max(value, {'c': created_at, 'r': run_id}) AS last
            FROM build_runs JOIN tgt USING (run_id) WHERE value < 500 GROUP BY 1))""", tgt=_TARGET)
def idea_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_table(spark, sf_dir).join(_target(spark, sf_dir), "run_id").withColumn("idea", F.split("idea", r" \+ ")[0])
    t = registry.pf_trend(runs, "value")
    return t.select("idea", "runs", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "trend", "decayed")


_HOLD = "SELECT run_id, avg(pf) FILTER (rank <= 2) AS oos, avg(pf) FILTER (rank > 2) AS hold, count(*) FILTER (rank > 2) * 5 AS n FROM results GROUP BY 1"


@query("""SELECT class, count(*) AS runs FROM (SELECT CASE WHEN n < 10 THEN 'not validated' WHEN hold >= 0.8 * oos THEN 'real edge' WHEN hold >= 1 THEN 'partial' WHEN 1 - hold / oos > 0.5 THEN 'curve-fitted' ELSE 'regime shift' END AS class FROM holds) GROUP BY 1""", holds=_HOLD)
def holdout_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_table(spark, sf_dir).groupBy("run_id").agg(
        F.avg(F.when(F.col("rank") <= 2, F.col("pf"))).alias("avg_oos_pf"), F.avg(F.when(F.col("rank") > 2, F.col("pf"))).alias("holdout_pf"), (F.count_if(F.col("rank") > 2) * 5).alias("holdout_trades")
    )
    return registry.holdout_class(r).groupBy("class").agg(F.count("*").alias("runs"))


@query(f"""SELECT run, round(avg((t > 0)::INT), 6) AS profitable FROM (SELECT run, k, round(sum(w * pnl), 9) AS t FROM (
        SELECT run, k, pnl, {" + ".join(f"(u >= {c})::INT" for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))} AS w FROM (
            SELECT l_returnflag AS run, k, l_discount - 0.05 AS pnl, {drawn_sql("7", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "k")} % 1000000 / 1000000.0::DOUBLE AS u
            FROM lineitem, (SELECT range AS k FROM range(50)))) GROUP BY 1, 2) GROUP BY 1""")
def resampled_profits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    trades = lines.select(F.col("l_returnflag").alias("run"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"), (F.col("l_discount").cast("double") - 0.05).alias("pnl"))
    return registry.monte_carlo(trades, "run", 50)


@query("""SELECT count(*) AS halves, round(avg((r < 0.5)::INT), 6) AS pbo FROM (SELECT half, percent_rank() OVER (PARTITION BY half ORDER BY outside) AS r, row_number() OVER (PARTITION BY half ORDER BY inside DESC, trial) AS k FROM (
        SELECT half, trial, round(sum(CASE WHEN (half >> b) & 1 = 1 THEN s ELSE 0 END), 9) AS inside, round(sum(CASE WHEN (half >> b) & 1 = 0 THEN s ELSE 0 END), 9) AS outside FROM (
            SELECT l_linenumber AS trial, CAST(l_orderkey % 8 AS INT) AS b, round(sum(l_discount - 0.05), 9) AS s FROM lineitem GROUP BY 1, 2), (SELECT range::INT AS half FROM range(256) WHERE bit_count(range::INT) = 4) GROUP BY 1, 2)) WHERE k = 1""")
def backtest_overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    series = lines.select(F.col("l_linenumber").alias("trial"), F.pmod(F.col("l_orderkey"), F.lit(8)).cast("int").alias("block"), (F.col("l_discount").cast("double") - 0.05).alias("pnl"))
    return registry.overfitting(series)


@query("""SELECT coalesce(b.k, a.k) AS k, coalesce(b.x, a.x) AS x, coalesce(b.y, a.y) AS y FROM
        (SELECT c_custkey AS k, c_acctbal::DOUBLE AS x, c_mktsegment AS y FROM customer WHERE c_acctbal > 1000) a
        FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN NULL ELSE 1.5::DOUBLE END AS x, c_nationkey::VARCHAR AS y FROM customer WHERE c_nationkey < 12) b ON a.k = b.k""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    a = c.where("c_acctbal > 1000").select(key.alias("k"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_mktsegment").alias("y"))
    b = c.where("c_nationkey < 12").select(key.alias("k"), F.when(F.col("c_nationkey") >= 5, 1.5).alias("x"), F.col("c_nationkey").cast("string").alias("y"))
    return registry.upsert(a, b, ["k"])


#: Function words of four languages stand in for concepts in the invented prose of ``documents``.
_WORDS = (("PHRASE", "entry", ("of the",)), ("EN", "zone", ("the",)), ("DE", "zone", ("der",)), ("FR", "context", ("les",)), ("ES", "timing", ("los",)))


@query("""SELECT doc_id, array_to_string(list_filter(['PHRASE', 'EN', 'DE', 'FR', 'ES'], lambda c: regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(' ||
        CASE c WHEN 'PHRASE' THEN 'of the' WHEN 'EN' THEN 'the' WHEN 'DE' THEN 'der' WHEN 'FR' THEN 'les' ELSE 'los' END || ')([^\\pL\\pN_]|$)')), ',') AS concepts FROM documents""")
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("idea"))
    return ideas.tag(docs, keywords=_WORDS).select("doc_id", F.array_join("concepts", ",").alias("concepts"))


@query("""SELECT role, len(f) AS failures, count(*) AS n FROM (SELECT role, list_filter([CASE WHEN len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) < 2 THEN 'a' END, CASE WHEN length(trim(text)) > 500 THEN 'b' END,
        CASE WHEN regexp_matches(text, '[;<>`$\\\\]') THEN 'c' END, CASE WHEN regexp_matches(trim(text), '^[0-9\\s.,+-]+$') THEN 'd' END], lambda x: x IS NOT NULL) AS f FROM conversations) GROUP BY 1, 2""")
def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("role", F.col("text").alias("idea"))
    return ideas.gate(turns).groupBy("role", F.size("failures").alias("failures")).agg(F.count("*").alias("n"))


@query("""SELECT a.idea AS a, b.idea AS b FROM ws a JOIN ws b ON a.idea < b.idea AND abs(len(a.w) - len(b.w)) <= 2 AND len(list_intersect(a.w, b.w)) >= 0.8 * least(len(a.w), len(b.w))""",
    ws="SELECT idea, list_distinct(list_filter(string_split_regex(lower(idea), '[^a-z0-9_]+'), lambda x: x <> '')) AS w FROM (SELECT DISTINCT idea FROM build_runs)")
def idea_look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideas.look_alikes(stage(runs_table(spark, sf_dir).select("idea").distinct(), "ideas"), "idea")


@query("""SELECT t.symbol, t.bar_no, (SELECT arg_max(a.atr, a.ts) FROM atrs a WHERE a.symbol = t.symbol AND a.ts <= t.ts) AS atr FROM (SELECT symbol, bar_no, ts - INTERVAL 30 MINUTE AS ts FROM bars) t""".replace(") AS atr FROM (", ") AS raw FROM (").join(["SELECT symbol, bar_no, round(raw, 6) AS atr FROM (", ")"]))
def asof_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = keyed_event_bars(spark, sf_dir)
    trades = bars.select("symbol", "bar_no", F.expr("ts - INTERVAL 30 MINUTES").alias("ts"))
    atrs = signals.atr(bars).select("symbol", "ts", "atr")
    return joins.asof(trades, atrs, ["atr"]).select("symbol", "bar_no", F.round("atr", 6).alias("atr"))
