"""Queries over sessions, idea texts, the registry's sets and grids, rolling models of the bars, and user signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import SESSION_MAPS, in_session, local, session_map
from ..functions.draws import drawn_sql
from ..operators import concepts, ideas, joins, outcomes, regimes, registry, reviews, search, signals, studies, zones
from ..operators.frames import last, windowed
from ..sources.bars import keyed, keyed_event_bars, order_bars, read_table
from ..sources.store import stage
from .registry import query
from .registry_queries import _TIERS, results_table, runs_table
from .sql import CTES, W

# sessions and clocks

_MINUTE = "hour(ts) * 60 + minute(ts)"


@query(f"""SELECT symbol, s AS session, count(*) AS bars FROM bars, (SELECT unnest(['asia', 'london', 'ny', 'all']) AS s)
    WHERE CASE s WHEN 'asia' THEN {_MINUTE} >= 60 AND {_MINUTE} < 240 WHEN 'london' THEN {_MINUTE} >= 420 AND {_MINUTE} < 660 WHEN 'ny' THEN {_MINUTE} >= 810 AND {_MINUTE} < 960 ELSE true END GROUP BY 1, 2""")
def session_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = keyed_event_bars(spark, sf_dir)
    names = ("asia", "london", "ny", "all")
    on = F.array_compact(F.array(*[F.when(in_session(F.col("ts"), s), F.lit(s)) for s in names]))
    return bars.select("symbol", F.explode(on).alias("session")).groupBy("symbol", "session").agg(F.count("*").alias("bars"))


def _sql_map(name: str, clock: str, otherwise: str) -> str:
    minute = f"hour({clock}) * 60 + minute({clock})"
    cases = " ".join(f"WHEN {minute} >= {first} AND {minute} < {end} THEN '{label}'" for label, first, end in SESSION_MAPS[name])
    return f"SELECT symbol, '{name}' AS map, CASE {cases} ELSE {otherwise} END AS session FROM bars"


@query("SELECT symbol, map, session, count(*) AS bars FROM (" + " UNION ALL ".join([
    _sql_map("ny_halves", "ny", "'Post'"), _sql_map("settlement", "ny", "'unknown'"), _sql_map("utc_chains", "ts", "'post'"), _sql_map("utc_thirds", "ts", "'ny'"), _sql_map("kill_zones", "ny", "NULL"),
]) + ") GROUP BY 1, 2, 3")
def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ny = keyed_event_bars(spark, sf_dir), local("ts")
    clocks = {"ny_halves": ny, "settlement": ny, "utc_chains": F.col("ts"), "utc_thirds": F.col("ts"), "kill_zones": ny}
    labels = F.array(*[F.struct(F.lit(n).alias("map"), session_map(c, n).alias("session")) for n, c in clocks.items()])
    return bars.select("symbol", F.explode(labels).alias("x")).groupBy("symbol", "x.map", "x.session").agg(F.count("*").alias("bars"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS events FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= DATE '1998-03-01' - 5 AND CAST(o_orderdate AS DATE) <= DATE '1998-06-30' + 5 GROUP BY 1""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("timestamp").alias("event_ts"))
    return joins.events_between(events, F.lit("1998-03-01").cast("date"), F.lit("1998-06-30").cast("date"), 5).groupBy(F.date_format("event_ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


@query("""SELECT * FROM (VALUES ('flag', 'fvg_bear'), ('flag', 'fvg_bear_active'), ('flag', 'fvg_bear_filled'), ('flag', 'fvg_bull'), ('flag', 'fvg_bull_active'), ('flag', 'fvg_bull_filled'),
    ('level', 'prev_day_high'), ('level', 'prev_day_low'), ('level', 'prev_week_high'), ('level', 'prev_week_low'), ('numeric flag', 'rose'), ('zone', 'fvg')) t(kind, name)""")
def signal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = keyed_event_bars(spark, sf_dir)
    b = signals.previous_levels(signals.fair_value_gap(bars), ("day", "week")).withColumn("rose", F.when(F.col("close") != F.col("open"), (F.col("close") > F.col("open")).cast("int")))
    found = {"flag": concepts.flag_columns(b), "numeric flag": concepts.numeric_flags(b), "level": concepts.level_columns(b), "zone": concepts.zone_prefixes(b)}
    return spark.createDataFrame([(k, n) for k, names in found.items() for n in names], "kind string, name string")


# ideas

#: What stands for idea texts: words by the columns of ``part``.
_WORDS = ("fvg standard", "FVG std ft", "ob chaos", "chaos OB dp", "session ob st50", "bos + sweep", "liquidity sweep short", "macro short", "hrl/lrl", "3. fvg", "premium turtle soup", "order block", "manip bos")
_PLACES = ("london", "New York", "asian range", "", "tokyo")
_ENDS = {"ECONOMY": "sl 12 pts", "SMALL": "long", "MEDIUM": "short", "PROMO": "breakeven trail", "STANDARD": "atr trail", "LARGE": "stop: 7.5 points"}
_IDEA_SQL = (
    f"SELECT p_partkey, p_size, [{', '.join(repr(w) for w in _WORDS)}][p_size % {len(_WORDS)} + 1] || ' ' || [{', '.join(repr(w) for w in _PLACES)}][p_partkey % {len(_PLACES)} + 1] || ' ' || "
    f"CASE p_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _ENDS.items())} ELSE '' END AS idea FROM part"
)


def _ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    end = F.coalesce(F.create_map(*[F.lit(x) for kv in _ENDS.items() for x in kv])[F.col("p_type")], F.lit(""))
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", F.concat(pick(_WORDS, F.col("p_size")), F.lit(" "), pick(_PLACES, F.col("p_partkey")), F.lit(" "), end).alias("idea"))


def _held(keywords) -> str:
    return "regexp_matches(idea, '(?i)(^|[^\\w])(" + "|".join(ideas.re.escape(k).replace("'", "''") for k in keywords) + ")([^\\w]|$)')"


_FOUND = "SELECT p_partkey, idea, list_filter([" + ", ".join(f"CASE WHEN {_held(k)} THEN '{c}' END" for c, _, k in ideas.CONCEPTS) + "], lambda x: x IS NOT NULL) AS c FROM idea_texts"
_OF_ZONE = ideas.entries_of_zones()
_KEPT = "SELECT p_partkey, idea, list_filter(c, lambda x: NOT CASE x " + " ".join(f"WHEN '{z}' THEN len(list_intersect(c, {v!r})) > 0" for z, v in _OF_ZONE.items()) + " ELSE false END) AS c FROM found"
_ROLE = {r: repr([c for c, x, _ in ideas.CONCEPTS if x == r]) for r in ("entry", "zone", "context", "timing")}
_PARSED = f"""SELECT p_partkey, c, list_filter(c, lambda x: list_contains({_ROLE['entry']}, x) AND NOT (x = 'MANIP' AND list_contains(c, 'MANIP_BEAR'))) AS entry,
        array_to_string(list_filter(c, lambda x: list_contains({_ROLE['zone']}, x)), ',') AS zone, array_to_string(list_filter(c, lambda x: list_contains({_ROLE['context']}, x)), ',') AS context,
        array_to_string(list_filter(c, lambda x: list_contains({_ROLE['timing']}, x)), ',') AS timing,
        CASE WHEN list_contains(c, 'MANIP_BEAR') OR regexp_matches(d, '\\bshort\\b') THEN -1 WHEN regexp_matches(d, '\\blong\\b') THEN 1 ELSE 0 END AS direction,
        CASE WHEN {_held(('london', 'european'))} THEN 'london' WHEN {_held(('new york', 'ny', 'nyo', 'american'))} THEN 'ny' WHEN {_held(('asia', 'asian', 'tokyo'))} THEN 'asia' ELSE 'all' END AS session,
        try_cast(regexp_extract(lower(idea), '(?:sl|stop|stoploss|stop.loss)\\s*[:\\s]?\\s*(\\d+(?:\\.\\d+)?)\\s*(?:punkte|pts|points|p\\b)', 1) AS DOUBLE) AS said,
        list_filter(c, lambda x: list_contains({list(ideas.GAP_ZONES + ideas.BLOCK_ZONES)!r}, x))[1] AS usual, contains(' ' || lower(idea) || ' ', ' trail ') AS trail,
        CASE WHEN contains(lower(idea), 'breakeven trail') THEN 'breakeven_trail' WHEN contains(lower(idea), 'breakeven') THEN 'breakeven' WHEN contains(lower(idea), 'next zone') THEN 'next_zone'
             WHEN contains(lower(idea), 'session level') THEN 'session_level' WHEN contains(lower(idea), 'atr trail') THEN 'atr_trail' ELSE 'fixed' END AS exit_mode
    FROM (SELECT *, regexp_replace(lower(idea), 'macro (time )?(short|long)', '', 'g') AS d FROM kept)"""
_MORE = "CASE z " + " ".join(f"WHEN '{z}' THEN {v!r}" for z, v in [*_OF_ZONE.items(), ("OB_SESSION_HTIEF", _OF_ZONE["OB_SESSION"])]) + " ELSE []::VARCHAR[] END"


@query(f"""SELECT p_partkey, array_to_string(list_concat(c, list_filter(flatten(list_transform(entry, lambda z: {_MORE})), lambda x: NOT list_contains(c, x))), ',') AS concepts, array_to_string(entry, ',') AS entry,
        zone, context, timing, direction, session, coalesce(said, CASE WHEN list_contains({list(ideas.GAP_ZONES)!r}, usual) THEN 5.0 WHEN usual IS NOT NULL THEN CASE WHEN direction = 1 THEN 20.0 ELSE 10.0 END END) AS stop, trail, exit_mode FROM parsed""",
    idea_texts=_IDEA_SQL, found=_FOUND, kept=_KEPT, parsed=_PARSED)
def parsed_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ideas.parse(_ideas(spark, sf_dir))
    return p.select("p_partkey", *[F.array_join(c, ",").alias(c) for c in ("concepts", "entry", "zone", "context", "timing")], "direction", "session", "stop", "trail", "exit_mode")


_FAILED_SQL = "SELECT DISTINCT lower(trim(CASE WHEN p_size % 5 = 0 THEN left(idea, 9) WHEN p_size % 5 = 1 THEN idea || ' again' ELSE substring(idea, 5) END)) AS t FROM idea_texts WHERE p_partkey % 40 = 3"


@query("SELECT DISTINCT idea FROM idea_texts i WHERE EXISTS (SELECT 1 FROM failed f WHERE f.t <> '' AND (contains(lower(trim(idea)), f.t) OR starts_with(f.t, lower(trim(idea)))))", idea_texts=_IDEA_SQL, failed=_FAILED_SQL)
def known_failing_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _ideas(spark, sf_dir)
    size = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    title = F.when(F.col("p_size") % 5 == 0, F.left("idea", F.lit(9))).when(F.col("p_size") % 5 == 1, F.concat("idea", F.lit(" again"))).otherwise(F.substring("idea", 5, 1000))
    failed = every.join(size, "p_partkey").where("p_partkey % 40 = 3").select(title.alias("title"))
    return ideas.known_failures(every.select("idea").distinct(), failed)


@query("""SELECT run_id, step, token, array_to_string(list_sort(t), ',') AS tokens, s AS session FROM (
        SELECT run_id, 'remove' AS step, u.x AS token, list_filter(w, lambda y: y <> u.x) AS t, session AS s FROM ts, unnest(w) u(x) WHERE len(w) > 1
        UNION ALL SELECT run_id, 'add', v.token, list_append(w, v.token), session FROM ts, vocab v WHERE len(w) < 4 AND NOT list_contains(w, v.token)
        UNION ALL SELECT run_id, 'session', o.s, w, o.s FROM ts, (SELECT unnest(['LONDON', 'NY', 'ASIA']) AS s) o WHERE o.s <> session)""",
    ts="SELECT run_id, session, string_split(idea, ' + ') AS w FROM build_runs", vocab="SELECT DISTINCT p_type AS token FROM part")
def idea_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_table(spark, sf_dir).select("run_id", "session", F.split("idea", r" \+ ").alias("tokens")).withColumnRenamed("session", "at")
    words = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("token")).distinct()
    return ideas.neighbours(runs, words, "run_id", 4, "at").select("run_id", "step", "token", F.array_join("tokens", ",").alias("tokens"), "session")


@query("""SELECT p_partkey, left(md5(array_to_string(list_sort([p_name, p_type]), ',') || '|' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'NY' END || '|' || CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END || '|' || CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END), 8) AS hash FROM part""")
def idea_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", ideas.idea_hash(F.array("p_name", "p_type"), F.when(F.col("p_size") % 3 != 0, "NY"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")), F.col("p_size") > 20).alias("hash"))


@query("""SELECT p_partkey, name, value FROM (SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
        UNION ALL SELECT p_partkey, 'code', CAST(p_partkey * 2 AS DOUBLE) FROM part WHERE p_partkey % 2 = 0)""")
def json_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") * 2).cast("string")).otherwise("x1")
    text = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 3).alias("large"), F.col("p_name").alias("name"), code.alias("code")))
    return ideas.json_numbers(part.select("p_partkey", text.alias("params")), "p_partkey")


# sets of ideas and runs

@query("""SELECT i.idea, i.run_id, r.pf FROM (SELECT i AS idea, arg_max(run_id, struct_pack(a := pf, b := -run_id)) AS run_id FROM (SELECT lower(trim(idea)) AS i, run_id, pf FROM build_runs JOIN results USING (run_id)) GROUP BY 1) i
    JOIN (SELECT run_id, max(pf) AS pf FROM results GROUP BY 1) r USING (run_id)""")
def best_of_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = stage(runs_table(spark, sf_dir), "runs")
    wanted = runs.select(F.lower("idea").alias("idea")).distinct()
    return registry.best_of_idea(wanted, runs.withColumn("idea", F.concat(F.lit("  "), F.col("idea"))), results_table(spark, sf_dir))


@query("""SELECT DISTINCT p_name || ' ' || p_type AS idea FROM part WHERE lower(p_name || ' ' || p_type) NOT IN (SELECT lower(p_name || ' ' || p_type) FROM part WHERE p_size > 30)""")
def ideas_not_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_size", F.concat_ws(" ", "p_name", "p_type").alias("idea"))
    runs = part.where("p_size > 30").select(F.upper(F.concat("idea", F.lit(" "))).alias("idea"))
    return registry.not_run(part.select("idea").distinct(), runs)


@query("""SELECT p_partkey AS run_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 10 WHEN p_partkey % 3 = 0 THEN p_partkey * 10 + 1 WHEN p_partkey % 2 = 0 THEN p_partkey * 10 + 2 END AS study_id FROM part""")
def studies_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    runs = part.select(F.col("p_partkey").alias("run_id"), F.md5(F.col("p_partkey").cast("string")).alias("idea_hash"))  # whole: eight digits are shared by some of 100,000 runs
    has = {0: "run_id % 4 = 0", 1: "run_id % 3 = 0", 2: "run_id % 2 = 0"}
    parts = [runs.where(c).select(F.concat("idea_hash", F.lit(f"_w{w}")).alias("name"), (F.col("run_id") * 10 + w).alias("study_id")) for w, c in has.items()]
    return registry.study_of(runs, parts[0].unionByName(parts[1]).unionByName(parts[2])).select("run_id", "study_id")


@query("""SELECT DISTINCT e.x || ' + ' || f.x || ' ' || s.x AS idea FROM (SELECT DISTINCT p_type AS x FROM part) e, (SELECT DISTINCT p_name AS x FROM part) f, (SELECT DISTINCT o_orderstatus AS x FROM orders) s""")
def idea_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, orders = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "orders")
    return registry.idea_grid(part.select(F.col("p_type").alias("entry")).distinct(), part.select(F.col("p_name").alias("filter")).distinct(), orders.select(F.col("o_orderstatus").alias("session")).distinct())


@query("""SELECT kind, count(*) AS n, count(DISTINCT run_id) AS runs FROM (SELECT 'exploit' AS kind, l_orderkey AS run_id FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT 'explore', l_orderkey FROM lineitem WHERE l_tax > 0.05) GROUP BY 1""")
def united_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    a = li.where("l_discount > 0.05").select(F.lit("exploit").alias("kind"), F.col("l_orderkey").alias("run_id"))
    b = li.where("l_tax > 0.05").select(F.col("l_orderkey").alias("run_id"), F.lit("explore").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))


@query("""SELECT p_name AS idea, min(p_partkey) AS first_at FROM part GROUP BY 1""")
def ideas_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("idea"), F.col("p_partkey").alias("first_at"))
    return ideas.first_of_each(part, "idea", "first_at").select("idea", "first_at")


@query("""SELECT 'both' AS kind, idea FROM (SELECT p_name || p_type AS idea FROM part WHERE p_size < 20 INTERSECT SELECT p_name || p_type FROM part WHERE p_size >= 30)
    UNION ALL SELECT 'only', idea FROM (SELECT p_name || p_type AS idea FROM part WHERE p_size < 20 EXCEPT SELECT p_name || p_type FROM part WHERE p_size >= 30)""")
def idea_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_size", F.concat("p_name", "p_type").alias("idea"))
    a, b = part.where("p_size < 20").select("idea"), part.where("p_size >= 30").select("idea")
    return a.intersect(b).select(F.lit("both").alias("kind"), "idea").unionByName(a.subtract(b).select(F.lit("only").alias("kind"), "idea"))


@query("SELECT run_id FROM tiered WHERE tier = 'A' AND run_id % 3 <> 0", tiered=_TIERS)
def lockable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = registry.tiers(results_table(spark, sf_dir)).withColumn("holdout_validated", F.when(F.col("run_id") % 3 == 0, 1).when(F.col("run_id") % 3 == 1, 0))
    return reviews.lockable(runs, "a").select("run_id")


@query("""SELECT run_id, array_to_string(list_filter([CASE WHEN NOT a >= 1.5 THEN 'oos_pf' END, CASE WHEN b IS NULL OR b < 1.5 THEN 'holdout_pf' END, CASE WHEN n < 40 THEN 'oos_trades' END, CASE WHEN m IS NULL OR m < 40 THEN 'holdout_trades' END,
        CASE WHEN b IS NULL OR 1 - b / a > 0.3 THEN 'degradation' END], lambda x: x IS NOT NULL), ',') AS failures
    FROM (SELECT run_id, max(pf) AS a, CAST(sum(num_trades) AS BIGINT) AS n, min(pf) FILTER (rank > 1) AS b, CAST(sum(num_trades) FILTER (rank > 1) AS BIGINT) AS m FROM results GROUP BY 1)""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("rank") > 1
    runs = results_table(spark, sf_dir).groupBy("run_id").agg(
        F.max("pf").alias("oos_pf"), F.sum("num_trades").alias("oos_trades"), F.min(F.when(late, F.col("pf"))).alias("holdout_pf"), F.sum(F.when(late, F.col("num_trades"))).alias("holdout_trades")
    )
    return reviews.quality_failures(runs, 1.5, 40, 0.3).select("run_id", F.array_join("failures", ",").alias("failures"))


@query("""SELECT run_id, coalesce(CASE WHEN run_id % 3 = 0 THEN NULL ELSE session END, CASE WHEN contains(i, 'london') THEN 'london' WHEN contains(i, 'ny') THEN 'ny' WHEN contains(i, 'asia') THEN 'asia' END) AS session,
        CASE WHEN run_id % 5 = 0 THEN true ELSE r END AS robust FROM (SELECT run_id, session, lower(idea || CASE WHEN run_id % 2 = 0 THEN ' London' ELSE ' x' END) AS i FROM build_runs) JOIN (SELECT run_id, bool_and(pf > 1 AND num_trades > 0) AS r FROM results GROUP BY 1) USING (run_id)""")
def filled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_table(spark, sf_dir).withColumn("session", F.when(F.col("run_id") % 3 != 0, F.col("session")))
    runs = runs.withColumn("idea", F.concat("idea", F.when(F.col("run_id") % 2 == 0, " London").otherwise(" x"))).withColumn("robust", F.when(F.col("run_id") % 5 == 0, True))
    return registry.filled_metadata(runs, results_table(spark, sf_dir)).select("run_id", "session", "robust")


@query("""SELECT CASE WHEN contains(idea, 'PROMO') THEN 'with' ELSE 'without' END AS runs, count(*) AS n, round(avg(avg_pf), 3) AS avg_pf, round(coalesce(avg(avg_pf) FILTER (run_id % 2 = 0), 0), 3) AS holdout_pf,
        round(100 * avg((tier = 'A')::INT), 2) AS tier_a, round(100 * avg((tier = 'B')::INT), 2) AS tier_b, round(100 * avg(robust::INT), 2) AS robust FROM build_runs JOIN tiered USING (run_id) GROUP BY 1""", tiered=_TIERS)
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = registry.tiers(results_table(spark, sf_dir))
    runs = runs_table(spark, sf_dir).join(tiers, "run_id").withColumn("holdout_pf", F.when(F.col("run_id") % 2 == 0, F.col("avg_pf")))
    return registry.with_token(runs, "promo London")


@query("""SELECT profile, count(*) AS runs, round(avg(pf), 4) AS pf, round(avg(winrate), 4) AS winrate FROM (
        SELECT run_id, array_to_string(list_sort(list_distinct(list(CASE WHEN t IN ('ECONOMY', 'PROMO') THEN 'Structure' WHEN t IN ('SMALL', 'MEDIUM') THEN 'Time' ELSE 'Unknown' END))), ' + ') AS profile
        FROM (SELECT run_id, unnest(string_split(idea, ' + ')) AS t FROM build_runs) GROUP BY 1) JOIN (SELECT run_id, max(pf) AS pf, max(winrate) AS winrate FROM results GROUP BY 1) USING (run_id) GROUP BY 1""")
def group_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = results_table(spark, sf_dir).groupBy("run_id").agg(F.max("pf").alias("pf"), F.max("winrate").alias("winrate"))
    part = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("token")).distinct()
    groups = part.withColumn("grp", F.when(F.col("token").isin("ECONOMY", "PROMO"), "Structure").when(F.col("token").isin("SMALL", "MEDIUM"), "Time")).where("grp is not null")
    return registry.group_profiles(runs_table(spark, sf_dir).join(best, "run_id"), groups)


def _token_table(spark: SparkSession, names: list[str], values: list[float]) -> DataFrame:
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(names, values, strict=True)], "token string, weight double")


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    target = results_table(spark, sf_dir).groupBy("run_id").agg(F.avg("pf").alias("value"))
    return registry.named_features(stage(runs_table(spark, sf_dir), "runs"), stage(target, "target"))


@query()
def token_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _features(spark, sf_dir)
    return _token_table(spark, names, registry.lasso(rows))


@query()
def token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _features(spark, sf_dir)
    return _token_table(spark, names, registry.tree_importance(rows))


# grids

_GRID = {
    "gap_atr": "SELECT a.*, bull FROM atrs a JOIN gaps USING (symbol, bar_no)",
    "grid_events": """SELECT symbol, bar_no, m AS mult, r AS reward, CASE WHEN bar_no < 400 THEN 'is' ELSE 'oos' END AS phase, close, close - m * atr AS stop, close + r * (m * atr) AS target
        FROM gap_atr, (SELECT unnest([1.0::DOUBLE, 1.5, 2.0]) AS m), (SELECT unnest([1.5::DOUBLE, 3.0]) AS r) WHERE bull AND atr IS NOT NULL""",
    "grid_hits": """SELECT e.*, arg_min(CASE WHEN b.low <= e.stop THEN 's' ELSE 't' END, b.bar_no) FILTER (b.low <= e.stop OR b.high >= e.target) AS hit
        FROM grid_events e LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_no > e.bar_no AND b.bar_no <= e.bar_no + 48 GROUP BY ALL""",
    "grid_pnl": "SELECT *, CASE hit WHEN 's' THEN stop - close WHEN 't' THEN target - close ELSE 0 END AS pnl FROM grid_hits",
    "grid_perf": """SELECT symbol, phase, mult, reward, count(*) AS trades, round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 3) AS pf, round(avg((pnl > 0)::INT), 6) AS win_rate, round(sum(pnl), 6) AS total, round(max(greatest(peak, 0) - run), 6) AS dd
        FROM (SELECT *, max(run) OVER (PARTITION BY symbol, phase, mult, reward ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS peak FROM (
            SELECT *, sum(pnl) OVER (PARTITION BY symbol, phase, mult, reward ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS run FROM grid_pnl)) GROUP BY 1, 2, 3, 4""",
    "grid_best": """SELECT * FROM (SELECT *, CASE WHEN trades >= 5 THEN coalesce(pf, 0) * (1 + win_rate) - dd / 100 ELSE 0 END AS objective FROM grid_perf WHERE phase = 'is')
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(objective, 6) DESC, mult, reward) = 1""",
}


@query("SELECT b.symbol, b.mult, b.reward, b.trades, round(b.objective, 4) AS objective, coalesce(o.trades, 0) AS oos_trades, round(o.total, 4) AS oos_total FROM grid_best b LEFT JOIN grid_perf o ON o.symbol = b.symbol AND o.mult = b.mult AND o.reward = b.reward AND o.phase = 'oos'", **_GRID)
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of stops and targets in one job; the best configuration in sample is then looked up out of sample."""
    b = stage(signals.atr(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "bars")
    axes = registry.grid(spark, {"mult": [1.0, 1.5, 2.0], "reward": [1.5, 3.0]})
    events = b.where("fvg_bull and atr is not null").crossJoin(F.broadcast(axes))  # six configurations
    risk = F.col("mult") * F.col("atr")
    events = events.select(
        "symbol", "bar_no", "mult", "reward", "config_id", F.when(F.col("bar_no") < 400, "is").otherwise("oos").alias("phase"), F.lit(1).alias("direction"),
        F.col("close").alias("entry"), (F.col("close") - risk).alias("stop"), (F.col("close") + F.col("reward") * risk).alias("target"),
    )
    t = outcomes.first_barrier(events, b, 48)
    pnl = F.when(F.col("outcome") == "stop", F.col("stop") - F.col("entry")).when(F.col("outcome") == "target", F.col("target") - F.col("entry")).otherwise(0.0)
    t = stage(t.withColumn("pnl", pnl).withColumn("win", F.col("pnl") > 0), "trades")
    by = ["symbol", "phase", "mult", "reward", "config_id"]
    perf = outcomes.performance(t, *by).join(outcomes.max_drawdown(t, *by, order="bar_no"), by)
    best = registry.best_config(perf.where("phase = 'is'").drop("phase"), ["symbol"])
    out = registry.applied(best.select("symbol", "config_id", "mult", "reward", "trades", "objective"), perf.where("phase = 'oos'"), ["symbol"])
    return out.select("symbol", "mult", "reward", "trades", F.round("objective", 4).alias("objective"), "oos_trades", F.round("oos_total", 4).alias("oos_total"))


#: The search's bars end where the held-out ones begin.
_HOLDOUT, _CONFIGS, _HORIZON = 600, 12, 96
_U = [f"{drawn_sql('1', 'k', str(at))} / 4294967296.0" for at in range(6)]
_SEARCH = {
    "configs": f"""SELECT k AS config_id, round(1.0 + 1.0 * {_U[0]}, 6) AS atr_mult, round(1.5 + 3.5 * {_U[1]}, 6) AS tp_mult, CAST(floor({_U[2]} * 6) AS INT) AS entry_offset, round(0.8 + 0.7 * {_U[3]}, 6) AS breakeven_rr,
        round(5.0 + 20.0 * {_U[4]}, 6) AS trail_activation, round(5.0 + 15.0 * {_U[5]}, 6) AS trail_distance FROM (SELECT range AS k FROM range({_CONFIGS}))""",
    "gap_atr": "SELECT a.*, bull FROM atrs a JOIN gaps USING (symbol, bar_no)",
    "candidates_": """SELECT DISTINCT s.symbol, e.bar_no, c.config_id, breakeven_rr, trail_activation, trail_distance, e.open AS entry, e.open - s.atr * atr_mult AS stop, e.open + s.atr * atr_mult * tp_mult AS target
        FROM gap_atr s CROSS JOIN configs c JOIN (SELECT symbol, max(bar_no) AS top FROM bars GROUP BY 1) m ON m.symbol = s.symbol JOIN bars e ON e.symbol = s.symbol AND e.bar_no = least(s.bar_no + greatest(entry_offset, 1), top) WHERE s.bull AND s.atr > 0""",
    "search_path": f"SELECT e.*, b.bar_no - e.bar_no AS step, b.open AS o, b.high AS h, b.low AS l FROM candidates_ e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + {_HORIZON}",
    "search_best": "SELECT *, greatest(entry, coalesce(max(h) OVER (PARTITION BY symbol, bar_no, config_id, entry, stop ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry)) AS best FROM search_path",
    "search_moved": """SELECT *, greatest(stop, CASE WHEN best - entry >= breakeven_rr * abs(entry - stop) THEN entry END, CASE WHEN best - entry >= breakeven_rr * abs(entry - stop) AND best - entry >= trail_activation THEN best - trail_distance END) AS x FROM search_best""",
    "search_hit": "SELECT *, CASE WHEN l <= x AND h >= target THEN CASE WHEN abs(target - o) < abs(x - o) THEN 'target' ELSE 'stop' END WHEN l <= x THEN 'stop' WHEN h >= target THEN 'target' END AS hit FROM search_moved",
    "search_all": """SELECT symbol, config_id, bar_no AS entry_no, bar_no + step AS exit_no, CASE WHEN hit = 'target' THEN target ELSE x END - entry - 1.35 AS pnl, entry, stop, target FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol, bar_no, config_id, entry, stop ORDER BY step) AS k FROM search_hit WHERE hit IS NOT NULL) WHERE k = 1""",
    "spans": f"""SELECT symbol, w AS window_, phase, CASE phase WHEN 'is' THEN w * o ELSE w * o + i END AS first_no, CASE phase WHEN 'is' THEN w * o + i - 1 ELSE w * o + i + o - 1 END AS last_no FROM (
        SELECT symbol, floor(count(*) * 0.75)::BIGINT AS i, floor(count(*) * 0.25 / 3)::BIGINT AS o, count(*) AS n FROM bars WHERE bar_no < {_HOLDOUT} GROUP BY 1), (SELECT unnest([0, 1, 2]) AS w), (SELECT unnest(['is', 'oos']) AS phase) WHERE i > 0 AND o > 0 AND w * o + i + o <= n""",
    "in_span": """SELECT t.symbol, s.window_, s.phase, t.config_id, t.entry_no, arg_max(t.exit_no, (t.entry, t.stop, t.target)) AS exit_no, arg_max(t.pnl, (t.entry, t.stop, t.target)) AS pnl
        FROM search_all t JOIN spans s ON s.symbol = t.symbol AND t.entry_no >= s.first_no AND t.exit_no <= s.last_no GROUP BY 1, 2, 3, 4, 5""",
    "one_at_a_time": """SELECT i.* FROM in_span i JOIN (SELECT symbol, window_, phase, config_id, unnest(list_reduce(list_prepend({'till': -1::BIGINT, 'at': []::BIGINT[]}, list({'till': exit_no, 'at': [entry_no]} ORDER BY entry_no)),
        lambda s, x: CASE WHEN x.at[1] > s.till THEN {'till': x.till, 'at': list_append(s.at, x.at[1])} ELSE s END).at) AS entry_no FROM in_span GROUP BY 1, 2, 3, 4) USING (symbol, window_, phase, config_id, entry_no)""",
    "search_perf": """SELECT symbol, window_, phase, config_id, count(*) AS trades, round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 3) AS pf, round(avg((pnl > 0)::INT), 6) AS win_rate, round(sum(pnl), 6) AS total, round(max(greatest(peak, 0) - run), 6) AS dd
        FROM (SELECT *, max(run) OVER q AS peak FROM (SELECT *, sum(pnl) OVER (PARTITION BY symbol, window_, phase, config_id ORDER BY entry_no ROWS UNBOUNDED PRECEDING) AS run FROM one_at_a_time)
              WINDOW q AS (PARTITION BY symbol, window_, phase, config_id ORDER BY entry_no ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2, 3, 4""",
    "search_chosen": """SELECT * FROM (SELECT *, CASE WHEN trades >= 5 THEN coalesce(pf, 0) * (1 + win_rate) - dd / 100 ELSE 0 END AS objective FROM search_perf WHERE phase = 'is')
        QUALIFY row_number() OVER (PARTITION BY symbol, window_ ORDER BY objective DESC, config_id) = 1""",
    "walked": """SELECT b.symbol, b.window_, b.config_id, b.trades AS is_trades, b.objective, coalesce(o.trades, 0) AS oos_trades, o.pf AS oos_pf, coalesce(o.total, 0) AS oos_total
        FROM search_chosen b LEFT JOIN search_perf o ON o.symbol = b.symbol AND o.window_ = b.window_ AND o.config_id = b.config_id AND o.phase = 'oos'""",
}


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Configurations, their closed trades, and what became of the best of each window."""
    b = stage(signals.atr(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "bars")
    configs = stage(search.design(spark, _CONFIGS), "configs")
    trades = stage(search.closed(search.candidates(b, "fvg_bull", configs).distinct(), b, _HORIZON), "trades")
    evaluation = stage(search.evaluated(trades, search.window_bounds(b.where(F.col("bar_no") < _HOLDOUT))), "evaluation")
    return configs, trades, stage(search.walked_forward(evaluation, configs), "walked")


@query("""SELECT w.symbol, CAST(w.window_ AS INT) AS "window", w.config_id, c.entry_offset, is_trades, round(objective, 4) AS objective, oos_trades, round(oos_total, 4) AS oos_total,
        round(sum(oos_total) OVER (PARTITION BY w.symbol ORDER BY w.window_), 4) AS oos_so_far FROM walked w JOIN configs c USING (config_id)""", **_SEARCH)
def rolling_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six axes drawn from a seed, all windows in one job, the best configuration of each window out of sample."""
    out = _searched(spark, sf_dir)[2]
    return out.select("symbol", "window", "config_id", "entry_offset", "is_trades", F.round("objective", 4).alias("objective"), "oos_trades", F.round("oos_total", 4).alias("oos_total"), F.round("oos_so_far", 4).alias("oos_so_far"))


@query(f"""SELECT b.symbol, b.config_id, coalesce(h.trades, 0) AS holdout_trades, h.pf AS holdout_pf, CASE WHEN coalesce(h.trades, 0) < 10 THEN 'not validated' WHEN h.pf >= 0.8 * b.oos_pf THEN 'real edge' WHEN h.pf >= 1 THEN 'partial'
        WHEN 1 - h.pf / nullif(b.oos_pf, 0) > 0.5 THEN 'curve-fitted' ELSE 'regime shift' END AS class FROM (SELECT symbol, config_id, oos_pf FROM walked QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY window_ DESC) = 1) b LEFT JOIN (
            SELECT symbol, config_id, count(*) AS trades, round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 3) AS pf FROM late_kept GROUP BY 1, 2) h USING (symbol, config_id)""", **_SEARCH,
    late=f"SELECT symbol, config_id, entry_no, arg_max(exit_no, (entry, stop, target)) AS exit_no, arg_max(pnl, (entry, stop, target)) AS pnl FROM search_all WHERE entry_no >= {_HOLDOUT} GROUP BY 1, 2, 3",
    late_kept="""SELECT i.* FROM late i JOIN (SELECT symbol, config_id, unnest(list_reduce(list_prepend({'till': -1::BIGINT, 'at': []::BIGINT[]}, list({'till': exit_no, 'at': [entry_no]} ORDER BY entry_no)),
        lambda s, x: CASE WHEN x.at[1] > s.till THEN {'till': x.till, 'at': list_append(s.at, x.at[1])} ELSE s END).at) AS entry_no FROM late GROUP BY 1, 2) USING (symbol, config_id, entry_no)""")
def holdout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last window's best configuration on bars that no window has seen, and what that says of it."""
    _, trades, walked = _searched(spark, sf_dir)
    last_ = walked.groupBy("symbol").agg(F.max_by(F.struct("config_id", F.col("oos_pf").alias("avg_oos_pf")), "window").alias("r")).select("symbol", "r.*")
    out = registry.holdout_class(search.held_out(last_, trades, _HOLDOUT))
    return out.select("symbol", "config_id", "holdout_trades", "holdout_pf", "class")


_SAMPLE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""SELECT g, {", ".join(_SAMPLE_KEY)} FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {drawn_sql("0", *_SAMPLE_KEY)}, {", ".join(_SAMPLE_KEY)}) AS k
        FROM (SELECT *, l_returnflag || l_linestatus AS g FROM lineitem)) WHERE k <= 500""")
def sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").withColumn("g", F.concat("l_returnflag", "l_linestatus"))
    return concepts.sampled(li, list(_SAMPLE_KEY), ["g"], 500).select("g", *_SAMPLE_KEY)


# rolling models and regimes

_DAYS = {
    "day_bars": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM days",
    "day_tr": CTES["tr"].replace("FROM bars", "FROM day_bars"),
    "day_atr": f"SELECT *, avg(tr) OVER ({W} ROWS 13 PRECEDING) AS atr FROM day_tr",
    "day_moves": f"SELECT *, greatest(high - lag(high) OVER ({W}), 0) AS u, greatest(lag(low) OVER ({W}) - low, 0) AS v FROM day_atr",
    "day_adx": f"""SELECT *, avg(dx) OVER ({W} ROWS 13 PRECEDING) AS adx FROM (SELECT *, abs(x / nullif(t, 0) - y / nullif(t, 0)) / nullif(x / nullif(t, 0) + y / nullif(t, 0), 0) * 100 AS dx FROM (
        SELECT *, avg(u) OVER w AS x, avg(v) OVER w AS y, avg(tr) OVER w AS t FROM day_moves WINDOW w AS ({W} ROWS 13 PRECEDING)))""",
    "day_quarters": "SELECT symbol, date_trunc('quarter', ts) AS q, count(*) AS bars, avg(atr) AS atr_mean, stddev_samp(atr) AS atr_std, avg(adx) AS adx_mean FROM day_adx GROUP BY 1, 2",
}


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.quarters(signals.adx(signals.atr(stage(keyed(order_bars(spark, sf_dir)), "days"))))


@query("SELECT symbol, strftime(q, '%Y-%m-%d') AS quarter, bars, round(atr_mean, 4) AS atr_mean, round(atr_std, 4) AS atr_std, round(adx_mean, 4) AS adx_mean FROM day_quarters", **_DAYS)
def quarter_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quarters(spark, sf_dir).select("symbol", F.date_format("quarter", "yyyy-MM-dd").alias("quarter"), "bars", *[F.round(c, 4).alias(c) for c in ("atr_mean", "atr_std", "adx_mean")])


@query("""SELECT symbol, quarters, round(ratio, 6) AS ratio, ratio > 1.4 OR ratio < 0.7 AS shifted FROM (
        SELECT symbol, count(*) AS quarters, max(atr_mean) FILTER (k = 1) / median(atr_mean) FILTER (k > 1) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY q DESC) AS k FROM day_quarters) GROUP BY 1) WHERE quarters >= 3""", **_DAYS)
def regime_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.regime_shift(_quarters(spark, sf_dir))


_AR = f"""SELECT *, CASE WHEN n = 59 THEN c / nullif(vx, 0) END AS b FROM (SELECT symbol, bar_no, close, count(d) OVER p AS n, var_pop(x) OVER p AS vx, var_pop(d) OVER p AS vd, covar_pop(x, d) OVER p AS c, avg(d) OVER p AS md, avg(x) OVER p AS mx
    FROM (SELECT *, lag(close) OVER ({W}) AS x, close - lag(close) OVER ({W}) AS d FROM bars) WINDOW p AS ({W} ROWS 58 PRECEDING))"""


@query("""SELECT symbol, bar_no, round(half, 4) AS ou_half_life, stationary AS ou_is_stationary, coalesce(stationary AND half <= 30 AND close < mean, false) AS ou_bull_passes, coalesce(stationary AND half <= 30 AND close > mean, false) AS ou_bear_passes FROM (
        SELECT *, CASE WHEN b < 0 AND b > -1 THEN -0.6931471805599453 / ln(1 + b) END AS half, CASE WHEN b < 0 THEN mx - md / b END AS mean,
               coalesce(b < 0 AND b / nullif(sqrt(greatest(vd - b * c, 0) / 57 / nullif(vx, 0)), 0) < -2.91, false) AS stationary FROM ar)""", ar=_AR)
def mean_reversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.ou_half_life(keyed_event_bars(spark, sf_dir)).select("symbol", "bar_no", F.round("ou_half_life", 4).alias("ou_half_life"), "ou_is_stationary", "ou_bull_passes", "ou_bear_passes")


_BODY = "coalesce((close - open) / nullif(high - low, 0), 0)"


@query("""SELECT symbol, bar_no, u >= 0.1 AS hawkes_bull_active, d >= 0.1 AS hawkes_bear_active, nu AS hawkes_decay_bull, nd AS hawkes_decay_bear, u >= 0.1 AND NOT nu AS hawkes_bull_passes, d >= 0.1 AND NOT nd AS hawkes_bear_passes FROM (
        SELECT a.symbol, a.bar_no, sum(CASE WHEN p.body >= 0.25 THEN p.body ELSE 0 END * pow(0.5, (a.bar_no - p.bar_no) / 5.0)) AS u, sum(CASE WHEN p.body <= -0.25 THEN -p.body ELSE 0 END * pow(0.5, (a.bar_no - p.bar_no) / 5.0)) AS d,
               count(*) FILTER (p.body < 0 AND p.bar_no > a.bar_no - 3) = 3 AS nu, count(*) FILTER (p.body > 0 AND p.bar_no > a.bar_no - 3) = 3 AS nd
        FROM bodies a JOIN bodies p ON p.symbol = a.symbol AND p.bar_no <= a.bar_no GROUP BY 1, 2)""", bodies=f"SELECT symbol, bar_no, {_BODY} AS body FROM bars")
def excitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = signals.hawkes_decay(keyed_event_bars(spark, sf_dir))
    return h.select("symbol", "bar_no", *[f"hawkes_{s}_{k}" for s in ("bull", "bear") for k in ("active", "passes")], "hawkes_decay_bull", "hawkes_decay_bear")


@query(f"""SELECT symbol, bar_no, round(f, 6) AS ofi_fast, round(s, 6) AS ofi_slow, CASE WHEN n = 15 AND f > 0 AND s > 0 THEN 1 WHEN n = 15 AND f < 0 AND s < 0 THEN -1 ELSE 0 END AS ofi_signal FROM (
        SELECT symbol, bar_no, CASE WHEN count(*) OVER (x ROWS 2 PRECEDING) = 3 THEN avg(raw) OVER (x ROWS 2 PRECEDING) END AS f, CASE WHEN count(*) OVER (x ROWS 14 PRECEDING) = 15 THEN avg(raw) OVER (x ROWS 14 PRECEDING) END AS s, count(*) OVER (x ROWS 14 PRECEDING) AS n
        FROM (SELECT symbol, bar_no, {_BODY} * coalesce(volume / avg(volume) OVER ({W} ROWS 14 PRECEDING), 1) AS raw FROM bars) WINDOW x AS ({W}))""")
def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = signals.order_flow(keyed_event_bars(spark, sf_dir), by_volume=True)
    return o.select("symbol", "bar_no", F.round("ofi_fast", 6).alias("ofi_fast"), F.round("ofi_slow", 6).alias("ofi_slow"), "ofi_signal")


@query(f"""SELECT symbol, bar_no, round(list_reduce(list_prepend(p[1], p), lambda m, x: m * (1 - 2 / 201.0::DOUBLE) + x * (2 / 201.0::DOUBLE)), 4) AS ema FROM (SELECT symbol, bar_no, list(close) OVER ({W}) AS p FROM bars)""")
def ema_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.ema_trend(keyed_event_bars(spark, sf_dir)).select("symbol", "bar_no", F.round("ema", 4).alias("ema"))


# user signals

@studies.register_signal("three_up", n=3)
def three_up(bars: DataFrame, n: int) -> DataFrame:
    """``up_n``: the last ``n`` bars all closed above their open."""
    return windowed(bars, lambda b: b.withColumn("up_n", F.sum((F.col("close") > F.col("open")).cast("int")).over(last(n)) == n), back=n)


@query(f"""SELECT symbol, count(*) AS bars, count(*) FILTER (u = 3) AS fires FROM (SELECT symbol, sum((close > open)::INT) OVER ({W} ROWS 2 PRECEDING) AS u FROM bars) GROUP BY 1""")
def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = studies.USER_SIGNALS["three_up"]
    return s.run(keyed_event_bars(spark, sf_dir), **s.params).groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("up_n").alias("fires"))


@query(f"""SELECT symbol, bar_no, round(avg(close) OVER ({W} ROWS 4 PRECEDING), 6) AS mean5 FROM bars""")
def pandas_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mean5(series: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mean5": series["close"].rolling(5, min_periods=1).mean()})

    return studies.pandas_signal(keyed_event_bars(spark, sf_dir), mean5, "mean5 double", back=4).select("symbol", "bar_no", F.round("mean5", 6).alias("mean5"))


@query("SELECT * FROM (VALUES ('three_up', true, true, true)) t(signal, keys, causal, fires)")
def signal_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = keyed_event_bars(spark, sf_dir)
    rows = [(n, *(studies.audit(s, bars)[k] for k in ("keys", "causal", "fires"))) for n, s in sorted(studies.USER_SIGNALS.items()) if n == "three_up"]
    return spark.createDataFrame(rows, "signal string, keys boolean, causal boolean, fires boolean")


@query("SELECT symbol, side, count(*) AS zones, count(touch_no) AS touches FROM episodes GROUP BY 1, 2")
def gap_zone_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone outcomes of the prefix ``fvg`` under the name that older scripts use."""
    return zones.gap_outcomes(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))).select("symbol", "side", "zones", "touches")
