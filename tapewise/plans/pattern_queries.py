"""Queries over the patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns, signals, zones
from ..sources.bars import keyed_event_bars, resample
from ..sources.store import stage
from .bar_queries import HURST_SQL
from .registry import query
from .research_queries import _PERIODS, _lined, _states
from .sql import W, frame_sql, zone_sql

_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in patterns.COMPONENTS)
_BEFORE = lambda c: f"coalesce(lag({c}) OVER ({W}), false)"


@query(f"SELECT symbol, {_COUNTS} FROM (SELECT *, \"full\" AND chain AS full_chain FROM flagged) GROUP BY 1".replace("FILTER (full)", 'FILTER ("full")').replace("AS full,", 'AS "full",'),
    parts=f"""SELECT *, coalesce(bar_no >= 30 AND atr50 IS NOT NULL AND avg(high - low) OVER p5 < greatest(0.5 * atr50, 1.5), false) AS c,
        coalesce(bar_no >= 30 AND high > max(high) OVER p10 + 1.5 AND volume > 1.5 * med, false) AS up, coalesce(bar_no >= 30 AND low < min(low) OVER p10 - 1.5 AND volume > 1.5 * med, false) AS down
        FROM states WINDOW p5 AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), p10 AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
    judged="SELECT *, up OR down AS s, coalesce((up AND (high - close) / nullif(high - low, 0) > 0.35) OR (down AND (close - low) / nullif(high - low, 0) > 0.35), false) AS r FROM parts",
    flagged=f"""SELECT symbol, {_BEFORE("c AND NOT s")} AS only_compression, {_BEFORE("s AND NOT c AND NOT r")} AS only_sweep, {_BEFORE("r AND NOT s AND NOT c")} AS only_rejection,
        {_BEFORE("c AND s AND NOT r")} AS compression_sweep, {_BEFORE("c AND s AND r")} AS "full",
        coalesce(lag(state, 3) OVER ({W}) = 'SU' AND lag(state, 2) OVER ({W}) = 'SU' AND lag(state) OVER ({W}) = 'DD', false) AS chain FROM judged""")
def component_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.component_flags(_states(spark, sf_dir)).groupBy("symbol").agg(*[F.count_if(c).alias(c) for c in patterns.COMPONENTS])


_NEAR = ("near_24h", "near_day", "near_week", "near_settlement", "in_opening_gap", "in_gap_zone")


@query(f"""SELECT b.symbol, b.bar_no, coalesce(abs(close - hi24) <= 20, false) OR coalesce(abs(close - lo24) <= 20, false) AS near_24h,
        coalesce(abs(close - prev_day_high) <= 15, false) OR coalesce(abs(close - prev_day_low) <= 15, false) AS near_day,
        coalesce(abs(close - prev_week_high) <= 15, false) OR coalesce(abs(close - prev_week_low) <= 15, false) AS near_week,
        coalesce(b.bar_no - settled_no <= 15 AND abs(close - settled) <= 10, false) AS near_settlement,
        coalesce(top - bottom > 10 AND b.bar_no - first_no < 30 AND close BETWEEN bottom AND top, false) AS in_opening_gap,
        coalesce(b.bar_no - z.born_no <= 15 AND b.close BETWEEN z.far AND z.entry AND (z.fill_no IS NULL OR b.bar_no < z.fill_no), false) AS in_gap_zone
    FROM ranged b LEFT JOIN gapped g ON g.symbol = b.symbol AND g.d = date_trunc('day', b.ts) LEFT JOIN first_nos n ON n.symbol = b.symbol AND n.d = date_trunc('day', b.ts)
    LEFT JOIN (SELECT symbol, bar_no, bull_id FROM gap_ids) i ON i.symbol = b.symbol AND i.bar_no = b.bar_no LEFT JOIN fills z ON z.symbol = b.symbol AND z.zone_id = i.bull_id""", **_PERIODS,
    fills="SELECT b.symbol, b.zone_id, b.born_no, b.entry, b.far, min(z.bar_no) AS fill_no FROM born b LEFT JOIN zone_all z ON z.symbol = b.symbol AND z.side = b.side AND z.bar_no > b.born_no AND z.zone_id - z.birth::INT = b.zone_id AND z.lo <= b.far WHERE b.side = 'bull' GROUP BY ALL",
    crossed=f"SELECT *, CASE WHEN hour(chi) >= 15 AND lag(hour(chi)) OVER ({W}) < 15 THEN bar_no END AS cross_no FROM lined",
    ranged=f"""SELECT *, max(high) OVER p AS hi24, min(low) OVER p AS lo24, last_value(cross_no IGNORE NULLS) OVER ({W}) AS settled_no, last_value(CASE WHEN cross_no IS NOT NULL THEN close END IGNORE NULLS) OVER ({W}) AS settled
        FROM crossed WINDOW p AS ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""",
    first_nos="SELECT symbol, date_trunc('day', ts) AS d, min(bar_no) AS first_no FROM bars GROUP BY 1, 2",
    daily="SELECT symbol, date_trunc('day', ts) AS d, arg_min(open, ts) AS open, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2",
    gapped="SELECT *, least(open, p) AS bottom, greatest(open, p) AS top FROM (SELECT symbol, d, open, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS p FROM daily) WHERE p IS NOT NULL AND open <> p")
def proximity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.proximity_flags(stage(keyed_event_bars(spark, sf_dir), "bars")).select("symbol", "bar_no", *_NEAR)


_GAP_DAYS = {
    "daily": "SELECT symbol, date_trunc('day', ts) AS d, arg_min(open, ts) AS open, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2",
    "gapped": "SELECT symbol, d, least(open, p) AS bottom, greatest(open, p) AS top, row_number() OVER (PARTITION BY symbol ORDER BY d) AS n FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS p FROM daily) WHERE p IS NOT NULL AND open <> p",
    "gap_levels": """SELECT symbol, d, (top + above) / 2 AS level FROM (SELECT a.symbol, a.d, b.top, lead(b.bottom) OVER (PARTITION BY a.symbol, a.d ORDER BY (b.top + b.bottom) / 2, b.top, b.bottom) AS above
        FROM gapped a JOIN gapped b ON b.symbol = a.symbol AND b.n BETWEEN a.n - 4 AND a.n) WHERE above IS NOT NULL""",
}


@query("""SELECT symbol, bar_no, round(level, 6) AS bounce_level, coalesce(low <= level + 2 AND close > level, false) AS bounce_bull, coalesce(high >= level - 2 AND close < level, false) AS bounce_bear
    FROM (SELECT b.symbol, b.bar_no, any_value(b.low) AS low, any_value(b.high) AS high, any_value(b.close) AS close, arg_min(g.level, struct_pack(d := abs(g.level - b.close), x := g.level)) AS level
          FROM bars b LEFT JOIN gap_levels g ON g.symbol = b.symbol AND g.d = date_trunc('day', b.ts) GROUP BY 1, 2)""", **_GAP_DAYS)
def gap_level_bounces(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = patterns.gap_level_bounce(keyed_event_bars(spark, sf_dir))
    return b.select("symbol", "bar_no", F.round("bounce_level", 6).alias("bounce_level"), "bounce_bull", "bounce_bear")


@query("""SELECT symbol, bar_no, bull AS ob_bull, bear AS ob_bear, last_value(CASE WHEN bull OR bear THEN greatest(o2, c2) END IGNORE NULLS) OVER d AS ob_high, last_value(CASE WHEN bull OR bear THEN least(o2, c2) END IGNORE NULLS) OVER d AS ob_low
    FROM blocks WINDOW d AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY bar_no ROWS UNBOUNDED PRECEDING)""", **_PERIODS,
    lagged=f"SELECT *, lag(open, 2) OVER ({W}) AS o2, lag(close, 2) OVER ({W}) AS c2, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2, lag(high) OVER ({W}) AS h1, lag(low) OVER ({W}) AS l1 FROM lined",
    blocks="""SELECT *, coalesce(abs(c2 - o2) / nullif(h2 - l2, 0) >= 0.4 AND c2 < o2 AND l1 < l2 AND l1 < low AND abs(l1 - prev_day_low) <= 5, false) AS bull,
        coalesce(abs(c2 - o2) / nullif(h2 - l2, 0) >= 0.4 AND c2 > o2 AND h1 > h2 AND h1 > high AND abs(h1 - prev_day_high) <= 5, false) AS bear FROM lagged""")
def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.order_blocks(_lined(spark, sf_dir), "prev_day_low", "prev_day_high").select("symbol", "bar_no", "ob_bull", "ob_bear", "ob_high", "ob_low")


@query("""SELECT symbol, d AS mtf_direction, d <> 0 AND depth BETWEEN 0.2 AND 0.8 AS mtf_passes, count(*) AS bars, round(avg(depth), 6) AS depth FROM (
        SELECT symbol, d, coalesce(least(greatest(CASE d WHEN 1 THEN (z.bull_top - close) / nullif(z.bull_top - z.bull_bottom, 0) WHEN -1 THEN (close - z.bear_bottom) / nullif(z.bear_top - z.bear_bottom, 0) END, 0), 1), 0) AS depth FROM (
            SELECT *, CASE WHEN z.bull_top IS NOT NULL THEN 1 WHEN z.bear_top IS NOT NULL THEN -1 ELSE 0 END AS d FROM (
                SELECT b.symbol, b.close, (SELECT arg_max(a, a.ts) FROM four_active a WHERE a.symbol = b.symbol AND a.ts + INTERVAL 4 HOUR <= b.ts) AS z FROM bars b))) GROUP BY 1, 2, 3""", **frame_sql("four", "4 HOURS"), **zone_sql("four", "four_bars"))
def frame_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stage(keyed_event_bars(spark, sf_dir), "bars")
    return patterns.frame_alignment(bars, resample(bars, "4 hours"), 4 * 3600).groupBy("symbol", "mtf_direction", "mtf_passes").agg(F.count("*").alias("bars"), F.round(F.avg("mtf_depth"), 6).alias("depth"))


_KER = f"""SELECT *, CASE WHEN count(d) OVER p = 20 THEN abs(close - lag(close, 20) OVER ({W})) / nullif(sum(d) OVER p, 0) END AS ker
    FROM (SELECT *, abs(close - lag(close) OVER ({W})) AS d FROM atrs) WINDOW p AS ({W} ROWS 19 PRECEDING)"""


@query("SELECT symbol, bar_no, coalesce(ker >= 0.3, false) AS regime_gate FROM kers", kers=_KER)
def regime_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.regime_gate(keyed_event_bars(spark, sf_dir)).select("symbol", "bar_no", "regime_gate")


@query("SELECT symbol, side, zone_id, touch_no, disp_no, half_no FROM episodes LEFT JOIN disps USING (symbol, side, zone_id) LEFT JOIN halves USING (symbol, side, zone_id)",
    later="SELECT *, bar_no - row_number() OVER (PARTITION BY symbol, side, zone_id ORDER BY bar_no) AS island FROM zone_bars WHERE bar_no > born_no AND lo <= entry AND hi >= far",
    visited="SELECT *, dense_rank() OVER (PARTITION BY symbol, side, zone_id ORDER BY island) AS visit FROM later",
    halves="SELECT symbol, side, zone_id, min(bar_no) AS half_no FROM visited WHERE visit = 2 AND lo <= (entry + far) / 2 GROUP BY 1, 2, 3",
    disps="SELECT v.symbol, v.side, v.zone_id, min(v.bar_no) AS disp_no FROM visited v JOIN atrs a USING (symbol, bar_no) WHERE abs(a.close - a.open) > 1.5 * a.atr_before AND abs(a.close - a.open) > 0.5 * (a.high - a.low) AND a.close > a.open GROUP BY 1, 2, 3")
def zone_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stage(signals.displacement(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "zones")
    z = stage(zones.zone_bars(bars, context="disp_bull"), "zone_bars")
    return patterns.zone_entries(z).select("symbol", "side", "zone_id", "touch_no", "disp_no", "half_no")


@query()
def range_hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.range_hurst(keyed_event_bars(spark, sf_dir))


@query("SELECT symbol, count(*) FILTER (CASE WHEN n >= 16 AND k >= 2 THEN least(greatest(slope, 0), 1) ELSE 0.5 END < 0.45) AS passes, count(*) AS bars FROM sloped GROUP BY 1", **HURST_SQL)
def reverting_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.hurst(keyed_event_bars(spark, sf_dir), reverting=True).groupBy("symbol").agg(F.count_if("hurst_passes").alias("passes"), F.count("*").alias("bars"))
