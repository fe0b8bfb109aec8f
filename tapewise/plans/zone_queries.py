"""Queries over zone episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concepts, signals, zones
from ..sources.bars import keyed, keyed_event_bars, resample
from ..sources.store import stage
from .registry import query
from .sql import frame_sql, zone_sql

_SEVEN = """CASE WHEN m >= 1080 OR m < 120 THEN 'Asia' WHEN m < 480 THEN 'London' WHEN m < 570 THEN 'PreM' WHEN m < 720 THEN 'AM' WHEN m < 810 THEN 'Lunch'
            WHEN m < 960 THEN 'PM' WHEN m < 1080 THEN 'AH' ELSE 'Other' END"""
_CLASS = "CASE WHEN fill_no IS NULL THEN 'hold' WHEN back_after <= 60 THEN 'fakeout' ELSE 'break' END"


def gap_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), "zones")


def gap_zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = gap_bars(spark, sf_dir)
    return zones.zone_bars(bars), bars


@query("""
    SELECT symbol, side, count(*) AS zones, count(*) FILTER (touch_no IS NULL) AS no_touch, count(touch_no) AS touches,
           count(*) FILTER (touch_no IS NOT NULL AND fill_no IS NULL) AS bounce, count(*) FILTER (touch_no IS NOT NULL AND fill_no IS NOT NULL) AS through,
           round(median(depth), 6) AS depth_median, round(median(pct), 6) AS pct_median, count(*) FILTER (pct < 25) AS below_25,
           count(*) FILTER (pct >= 25 AND pct < 50) AS below_50, count(*) FILTER (pct >= 50 AND pct < 75) AS below_75,
           count(*) FILTER (pct >= 75 AND pct < 100) AS below_100, count(*) FILTER (pct >= 100) AS beyond
    FROM depths GROUP BY 1, 2""")
def zone_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.outcomes(gap_zones(spark, sf_dir)[0])


@query("""
    SELECT symbol, side, count(*) AS through, count(*) FILTER (back_after <= 15) AS back_15, count(*) FILTER (back_after <= 30) AS back_30,
           count(*) FILTER (back_after <= 60) AS back_60, count(*) FILTER (back_after <= 120) AS back_120
    FROM returned WHERE fill_no IS NOT NULL GROUP BY 1, 2""")
def zone_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.return_shares(*gap_zones(spark, sf_dir))


@query(f"SELECT symbol, side, {_CLASS} AS class, CAST(hour(coalesce(fill_ny, born_ny)) AS INT) AS hour, count(*) AS zones FROM returned GROUP BY 1, 2, 3, 4")
def zone_break_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.break_profile(*gap_zones(spark, sf_dir))


@query(f"""SELECT symbol, side, {_CLASS} AS class, {_SEVEN} AS session, count(*) AS zones
    FROM (SELECT *, hour(born_ny) * 60 + minute(born_ny) AS m FROM returned) GROUP BY 1, 2, 3, 4""")
def zone_session_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.break_profile(*gap_zones(spark, sf_dir), by="session")


@query("""SELECT symbol, side, CASE WHEN back_after IS NULL THEN 'out' WHEN back_after <= 5 THEN '1-5' WHEN back_after <= 15 THEN '6-15' WHEN back_after <= 30 THEN '16-30'
           WHEN back_after <= 60 THEN '31-60' ELSE '61-120' END AS band, count(*) AS zones, CAST(trunc(median(back_after)) AS INT) AS median_bars
    FROM returned WHERE fill_no IS NOT NULL GROUP BY 1, 2, 3""")
def zone_break_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.break_duration(*gap_zones(spark, sf_dir))


@query("""SELECT symbol, side, CASE WHEN p <= 10 THEN '0-10' WHEN p <= 25 THEN '10-25' WHEN p <= 50 THEN '25-50' WHEN p <= 75 THEN '50-75' ELSE '75-100' END AS band,
           count(*) AS zones, round(median(p), 6) AS pct_median
    FROM (SELECT *, least(100.0, (entry - lowest) / (entry - far) * 100) AS p FROM episodes WHERE touch_no IS NOT NULL AND fill_no IS NULL AND entry > far) WHERE p > 0 GROUP BY 1, 2, 3""")
def zone_bounce_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.bounce_depth(gap_zones(spark, sf_dir)[0])


@query("""SELECT symbol, side, count(*) AS zones, round(quantile_cont(excursion, 0.5), 6) AS p50, round(quantile_cont(excursion, 0.75), 6) AS p75,
           round(quantile_cont(excursion, 0.8), 6) AS p80, round(quantile_cont(excursion, 0.9), 6) AS p90 FROM returned WHERE back_after IS NOT NULL GROUP BY 1, 2""")
def zone_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.excursions(*gap_zones(spark, sf_dir))


@query("""
    SELECT symbol, side, visit, result, count(*) AS n, CAST(sum(bars) AS BIGINT) AS bars FROM (
        SELECT v.*, CASE WHEN n.px > v.entry THEN 'bounce' WHEN n.px < v.far THEN 'break' ELSE 'unclear' END AS result
        FROM runs v LEFT JOIN later n ON n.symbol = v.symbol AND n.side = v.side AND n.zone_id = v.zone_id AND n.bar_no = v.last_no + 1 WHERE visit <= 3)
    GROUP BY 1, 2, 3, 4""",
    later="SELECT *, lo <= entry AND hi >= far AS inside FROM zone_bars WHERE bar_no > born_no",
    starts="SELECT *, CASE WHEN lag(bar_no) OVER (PARTITION BY symbol, side, zone_id ORDER BY bar_no) = bar_no - 1 THEN 0 ELSE 1 END AS start FROM later WHERE inside",
    numbered="SELECT *, CAST(sum(start) OVER (PARTITION BY symbol, side, zone_id ORDER BY bar_no) AS BIGINT) AS visit FROM starts",
    runs="SELECT symbol, side, zone_id, visit, entry, far, count(*) AS bars, max(bar_no) AS last_no FROM numbered GROUP BY ALL",
)
def zone_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.visit_summary(gap_zones(spark, sf_dir)[0])


_GAP_STATE = """
        SELECT g.*, CASE WHEN e.fill_no IS NULL OR g.bar_no < e.fill_no THEN e.far END AS b_lo, CASE WHEN e.fill_no IS NULL OR g.bar_no < e.fill_no THEN e.entry END AS b_hi,
               CASE WHEN s.fill_no IS NULL OR g.bar_no < s.fill_no THEN -s.entry END AS s_lo, CASE WHEN s.fill_no IS NULL OR g.bar_no < s.fill_no THEN -s.far END AS s_hi,
               p.fill_no IS NOT NULL AS bull_filled
        FROM gap_ids g LEFT JOIN fills e ON e.symbol = g.symbol AND e.side = 'bull' AND e.zone_id = g.bull_id
             LEFT JOIN fills s ON s.symbol = g.symbol AND s.side = 'bear' AND s.zone_id = g.bear_id
             LEFT JOIN fills p ON p.symbol = g.symbol AND p.side = 'bull' AND p.zone_id = g.bull_id - g.bull::INT AND p.fill_no = g.bar_no"""
# a zone may also be filled by the bar that brings the next one
_FILLS = """
        SELECT b.symbol, b.side, b.zone_id, b.entry, b.far, min(z.bar_no) AS fill_no
        FROM born b LEFT JOIN zone_all z ON z.symbol = b.symbol AND z.side = b.side AND z.bar_no > b.born_no AND z.zone_id - z.birth::INT = b.zone_id AND z.lo <= b.far GROUP BY ALL"""


@query("""SELECT symbol, bar_no, bull AS fvg_bull, bull_id::BIGINT AS fvg_bull_id, b_lo IS NOT NULL AS fvg_bull_active, bull_filled AS fvg_bull_filled, b_hi AS fvg_bull_high, b_lo AS fvg_bull_low,
           s_hi AS fvg_bear_high, s_lo AS fvg_bear_low FROM gap_state""", fills=_FILLS, gap_state=_GAP_STATE)
def fair_value_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_bars(spark, sf_dir).select("symbol", "bar_no", "fvg_bull", "fvg_bull_id", "fvg_bull_active", "fvg_bull_filled", "fvg_bull_high", "fvg_bull_low", "fvg_bear_high", "fvg_bear_low")


@query("""SELECT symbol, count(*) FILTER (b_lo IS NOT NULL AND bar_no - e.born_no <= 20) AS active, count(*) FILTER (bull) AS births
    FROM gap_state LEFT JOIN (SELECT symbol, zone_id AS bull_id, born_no FROM born WHERE side = 'bull') e USING (symbol, bull_id) GROUP BY 1""", fills=_FILLS, gap_state=_GAP_STATE)
def fair_value_gaps_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = signals.fair_value_gap(keyed_event_bars(spark, sf_dir), max_age=20)
    return bars.groupBy("symbol").agg(F.count_if("fvg_bull_active").alias("active"), F.count_if("fvg_bull").alias("births"))


#: First bar after the birth that holds the middle of an active zone, for a table of bars with both sides' active zones.
_TOUCHED = {
    "fills": _FILLS, "gap_state": _GAP_STATE,
    "sided": """SELECT symbol, bar_no, ts, low, high, close, 'bull' AS side, bull_id AS zone_id, bull AS birth, b_hi AS zh, b_lo AS zl, s_hi AS oh, s_lo AS ol FROM gap_state
        UNION ALL SELECT symbol, bar_no, ts, low, high, close, 'bear', bear_id, bear, s_hi, s_lo, b_hi, b_lo FROM gap_state""",
    "touched": """SELECT *, CASE side WHEN 'bull' THEN close < (zh + zl) / 2 ELSE close > (zh + zl) / 2 END AS held FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side, zone_id ORDER BY bar_no) AS k FROM sided
        WHERE NOT birth AND low <= (zh + zl) / 2 AND high >= (zh + zl) / 2) WHERE k = 1""",
}
_HELD = "count(*) AS touches, count(*) FILTER (held) AS bounce, count(*) FILTER (NOT held) AS through"


@query(f"SELECT symbol, side, coalesce(NOT (zh < ol OR oh < zl), false)::INT AS overlap, {_HELD} FROM touched GROUP BY 1, 2, 3", **_TOUCHED)
def zone_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.overlap_outcomes(gap_bars(spark, sf_dir))


@query(f"""SELECT t.symbol, side, coalesce(abs(l.h - (zh + zl) / 2) <= 20, false)::INT AS near, {_HELD} FROM touched t LEFT JOIN ld l ON l.symbol = t.symbol AND l.p = date_trunc('day', t.ts) GROUP BY 1, 2, 3""", **_TOUCHED,
    pd="SELECT symbol, date_trunc('day', ts) AS p, max(high) AS h FROM bars GROUP BY 1, 2", ld="SELECT symbol, p, lag(h) OVER (PARTITION BY symbol ORDER BY p) AS h FROM pd")
def zone_near_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.near_level(signals.previous_levels(gap_bars(spark, sf_dir), ("day",)), "prev_day_high")


@query("""SELECT symbol, bar_no FROM (SELECT *, max((bull OR bear)::INT) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING) AS held FROM gap_state) WHERE held = 1 AND b_lo IS NOT NULL AND close > open""", fills=_FILLS, gap_state=_GAP_STATE)
def role_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = gap_bars(spark, sf_dir).withColumn("rising", F.col("close") > F.col("open"))
    names = {"FVG": ["fvg_bull", "fvg_bear", "absent"], "IN_FVG": ["fvg_bull_active"]}
    return concepts.role_query(bars, names, ["FVG", "UNKNOWN"], ["IN_FVG"], ["rising"]).select("symbol", "bar_no")


@query("SELECT symbol, bar_no FROM gaps WHERE bull OR bear")
def any_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.any_query(gap_bars(spark, sf_dir), ["FVG", "nothing"], {"FVG": ["fvg_bull", "fvg_bear"]}).select("symbol", "bar_no")


_NESTED = {
    **zone_sql("one", "bars"), **frame_sql("two", "2 HOURS"), **zone_sql("two", "two_bars"),
    "two_sided": """SELECT i.symbol, i.bar_no, i.ts, i.low, i.high, i.close, 'bull' AS side, i.bull_id AS zone_id, i.bull AS birth, a.bull_top AS zh, a.bull_bottom AS zl FROM two_ids i JOIN two_active a USING (symbol, bar_no)
        UNION ALL SELECT i.symbol, i.bar_no, i.ts, i.low, i.high, i.close, 'bear', i.bear_id, i.bear, a.bear_top, a.bear_bottom FROM two_ids i JOIN two_active a USING (symbol, bar_no)""",
    "two_touched": """SELECT *, CASE side WHEN 'bull' THEN close < (zh + zl) / 2 ELSE close > (zh + zl) / 2 END AS held FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side, zone_id ORDER BY bar_no) AS k FROM two_sided
        WHERE NOT birth AND low <= (zh + zl) / 2 AND high >= (zh + zl) / 2) WHERE k = 1""",
    "two_met": """SELECT t.*, (SELECT arg_min(CASE t.side WHEN 'bull' THEN {'h': o.bull_top, 'l': o.bull_bottom} ELSE {'h': o.bear_top, 'l': o.bear_bottom} END, o.ts) FROM one_active o WHERE o.symbol = t.symbol AND o.ts >= t.ts) AS z FROM two_touched t""",
}


def _nesting(spark: SparkSession, sf_dir: str, nesting: str) -> DataFrame:
    bars = gap_bars(spark, sf_dir)
    higher = signals.fair_value_gap(stage(keyed(resample(bars, "2 hours")), "higher"))
    return zones.nested_zones(bars, higher, nesting=nesting)


@query(f"SELECT symbol, side, coalesce(zl <= z.l AND z.h <= zh, false)::INT AS nested, {_HELD} FROM two_met GROUP BY 1, 2, 3", **_NESTED)
def zone_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nesting(spark, sf_dir, "contained")


@query(f"SELECT symbol, side, coalesce(NOT (zh < z.l OR z.h < zl), false)::INT AS nested, {_HELD} FROM two_met GROUP BY 1, 2, 3", **_NESTED)
def zone_nesting_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nesting(spark, sf_dir, "overlap")


@query(f"SELECT symbol, side, {_CLASS} AS class, context, count(*) AS zones FROM returned JOIN (SELECT symbol, side, zone_id, max((px * CASE side WHEN 'bull' THEN 1 ELSE -1 END > o)::INT) AS context FROM zone_open GROUP BY 1, 2, 3) c USING (symbol, side, zone_id) GROUP BY 1, 2, 3, 4",
    zone_open="SELECT z.*, b.open AS o FROM zone_bars z JOIN bars b ON b.symbol = z.symbol AND b.bar_no = z.bar_no")
def zone_context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = gap_bars(spark, sf_dir).withColumn("rising", F.col("close") > F.col("open"))
    return zones.break_profile(zones.zone_bars(bars, context="rising"), bars, by="context")
