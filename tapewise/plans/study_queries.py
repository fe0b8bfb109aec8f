"""Queries over the studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes, signals, studies
from ..sources.bars import keyed, keyed_event_bars, read_table, resample
from ..sources.store import stage
from .registry import query
from .registry_queries import runs_table
from .research_queries import _FWD, _KEPT, _trades
from .sql import W, frame_sql
from .zone_queries import _FILLS, _GAP_STATE


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stage(signals.atr(keyed_event_bars(spark, sf_dir)), "bars")
    return studies.enrich_trades(_trades(spark, sf_dir), bars)


_RICH = _KEPT | {
    "limits_": "SELECT symbol, quantile_cont(atr, 0.25) AS q1, quantile_cont(atr, 0.75) AS q3 FROM atrs GROUP BY 1",
    "rich": """SELECT p.*, CASE WHEN hour(ts) >= 7 AND hour(ts) < 13 THEN 'london' WHEN hour(ts) >= 13 AND hour(ts) < 21 THEN 'ny' ELSE 'asia' END AS session, CAST((dayofweek(ts) + 6) % 7 AS INT) AS weekday,
        CAST(hour(ts) AS INT) AS hour, CASE WHEN atr < q1 THEN 'low' WHEN atr > q3 THEN 'high' ELSE 'normal' END AS regime FROM pnls p JOIN atrs a ON a.symbol = p.symbol AND a.bar_no = p.entry_no JOIN limits_ l ON l.symbol = p.symbol""",
}


@query("SELECT session, regime, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 4) AS points, round(sum(pnl * 2), 4) AS usd FROM rich GROUP BY ROLLUP (session, regime)", **_RICH)
def trade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.trade_distribution(_enriched(spark, sf_dir), "session", "regime")


@query("SELECT weekday, " + ", ".join(f'round(avg(pnl) FILTER (hour = {h}), 2) AS "{h}"' for h in range(24)) + " FROM rich GROUP BY 1", **_RICH)
def trade_weekday_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.weekday_hours(_enriched(spark, sf_dir))


@query("SELECT symbol, direction, entry_no, round(sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_no, direction ROWS UNBOUNDED PRECEDING), 4) AS total FROM pnls", **_KEPT)
def trade_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.cumulative(_trades(spark, sf_dir), "symbol").select("symbol", "direction", "entry_no", F.round("total", 4).alias("total"))


@query("""SELECT symbol, target, count(*) AS signals, count(*) FILTER (g IS NOT NULL AND (l IS NULL OR g <= l)) AS wins FROM (
        SELECT e.symbol, e.bar_no, target, min(b.bar_no) FILTER (b.high - e.close >= target) AS g, min(b.bar_no) FILTER (e.close - b.low >= target) AS l
        FROM (SELECT *, unnest([5.0::DOUBLE, 10, 20, 50]) AS target FROM gaps WHERE bull) e LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 200 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.target_rates(stage(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), "bars"), "fvg_bull")


@query("""SELECT symbol, outcome, count(*) AS n FROM (SELECT e.symbol, e.bar_no, coalesce(arg_min(CASE WHEN b.low <= stop THEN 'stop' ELSE 'target' END, b.bar_no) FILTER (b.low <= stop OR b.high >= target), 'timeout') AS outcome
        FROM (SELECT b.symbol, b.bar_no, close - 10 * s AS stop, close + 20 * s AS target FROM bars b JOIN scaled USING (symbol) WHERE bar_no % 10 = 0) e
        LEFT JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 199 GROUP BY 1, 2) GROUP BY 1, 2""",
    scaled=f"SELECT symbol, greatest(0.1 * stddev_samp(d), 0.1) AS s FROM (SELECT symbol, close - lag(close) OVER ({W}) AS d FROM bars) GROUP BY 1")
def interval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = keyed_event_bars(spark, sf_dir)
    exits = outcomes.first_barrier(studies.interval_events(bars, 10), bars, 199)
    return exits.groupBy("symbol", "outcome").agg(F.count("*").alias("n"))


@query("""SELECT symbol, CASE WHEN age <= 5 THEN '1-5' WHEN age <= 20 THEN '6-20' WHEN age <= 60 THEN '21-60' ELSE '61+' END AS age, count(*) AS touches, round(sum(mfe_up), 4) AS mfe, round(sum(mae_up), 4) AS mae FROM (
        SELECT g.symbol, g.bar_no - last_value(CASE WHEN g.bull THEN g.bar_no END IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar_no) AS age, f.mfe_up, f.mae_up, b_lo IS NOT NULL AND NOT g.bull AND g.low <= b_hi AND f.mfe_up IS NOT NULL AS hit
        FROM gap_state g JOIN fwd f USING (symbol, bar_no)) WHERE hit GROUP BY 1, 2""", fills=_FILLS, gap_state=_GAP_STATE, fwd=_FWD)
def zone_age_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stage(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), "zones")
    return studies.age_decay(outcomes.forward_excursion(signals.zone_age(b, "fvg_bull"), 60))


@query("""SELECT symbol, strftime(day, '%Y-%m-%d') AS day, side, min(bar_no) AS bar_no FROM (
        SELECT *, unnest(CASE WHEN up THEN ['bear'] ELSE [] END || CASE WHEN down THEN ['bull'] ELSE [] END) AS side FROM (
            SELECT b.symbol, a.day, bar_no, close, hi, lo, max(high) OVER x >= hi + 3 AS up, min(low) OVER x <= lo - 3 AS down
            FROM bars b JOIN asia a ON a.symbol = b.symbol AND a.day = CAST(b.ny AS DATE) WHERE hour(ny) >= 8 AND hour(ny) < 10 WINDOW x AS (PARTITION BY b.symbol, a.day ORDER BY bar_no)) WHERE close < hi AND close > lo) GROUP BY 1, 2, 3""",
    asia="SELECT symbol, CAST(ny AS DATE) AS day, max(high) AS hi, min(low) AS lo FROM bars WHERE hour(ny) < 8 GROUP BY 1, 2")
def liquidity_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.liquidity_sweeps(keyed_event_bars(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT g.symbol, strftime(g.d, '%Y-%m-%d') AS period, direction, min(b.bar_no) AS bar_no FROM (SELECT g.*, o.bar_no FROM gapped g JOIN (SELECT symbol, date_trunc('day', ts) AS d, min(bar_no) AS bar_no FROM bars GROUP BY 1, 2) o USING (symbol, d)) g
    JOIN usual b ON b.symbol = g.symbol AND b.bar_no BETWEEN g.bar_no + 5 AND g.bar_no + 720
    WHERE b.low <= top AND b.high >= bottom AND CASE WHEN direction > 0 THEN abs(b.high - top) ELSE abs(b.low - bottom) END <= 0.6 * (top - bottom) AND b.volume >= 1.2 * med
          AND CASE WHEN direction > 0 THEN b.high - b.close ELSE b.close - b.low END / nullif(b.high - b.low, 0) >= 0.4 GROUP BY 1, 2, 3""",
    usual=f"SELECT *, quantile_cont(volume, 0.5) OVER ({W} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS med FROM bars",
    daily="SELECT symbol, date_trunc('day', ts) AS d, arg_min(open, ts) AS open, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2",
    gapped="SELECT *, CAST(sign(open - p) AS INT) AS direction, least(open, p) AS bottom, greatest(open, p) AS top FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS p FROM daily) WHERE p IS NOT NULL AND open <> p")
def gap_retraces(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = keyed_event_bars(spark, sf_dir)
    return studies.gap_retraces(b, signals.opening_gaps(b)).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


_SEGMENTS = f"SELECT symbol, bar_no // 60 AS segment, row_number() OVER (PARTITION BY symbol, bar_no // 60 ORDER BY bar_no) AS i, move FROM (SELECT symbol, bar_no, close - lag(close) OVER ({W}) AS move FROM bars) WHERE move IS NOT NULL"


@query("""SELECT symbol, segment, n, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END, 6) AS entropy FROM (
        SELECT symbol, segment, n, count(*) FILTER (greatest(abs(x0 - y0), abs(x1 - y1)) <= r) AS b, count(*) FILTER (greatest(abs(x0 - y0), abs(x1 - y1), abs(x2 - y2)) <= r) AS a FROM (
            SELECT s.symbol, s.segment, s.n, s.r, p.v AS x0, p.v1 AS x1, p.v2 AS x2, q.v AS y0, q.v1 AS y1, q.v2 AS y2
            FROM sized s JOIN shifted p USING (symbol, segment) JOIN shifted q ON q.symbol = p.symbol AND q.segment = p.segment AND q.i > p.i WHERE p.v2 IS NOT NULL AND q.v2 IS NOT NULL) GROUP BY 1, 2, 3)""",
    segs=_SEGMENTS, sized="SELECT symbol, segment, count(*) AS n, 0.2 * stddev_pop(move) AS r FROM segs GROUP BY 1, 2 HAVING count(*) >= 59",
    shifted="SELECT symbol, segment, i, move AS v, lead(move) OVER (PARTITION BY symbol, segment ORDER BY i) AS v1, lead(move, 2) OVER (PARTITION BY symbol, segment ORDER BY i) AS v2 FROM segs")
def segment_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.segment_statistics(keyed_event_bars(spark, sf_dir)).select("symbol", "segment", "n", F.round("entropy", 6).alias("entropy"))


@query()
def fluctuation_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.fluctuation_windows(keyed_event_bars(spark, sf_dir), 256)


@query()
def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.segment_statistics(keyed_event_bars(spark, sf_dir))


@query("""SELECT symbol, ker < 0.8 AS lrl, count(*) AS bars FROM (SELECT b.symbol, (SELECT arg_max({'k': a.ker}, a.ts) FROM four_ker a WHERE a.symbol = b.symbol AND a.ts + INTERVAL 4 HOUR <= b.ts).k AS ker FROM bars b) GROUP BY 1, 2""",
    **frame_sql("four", "4 HOURS"), four_ker=f"SELECT symbol, ts, CASE WHEN count(d) OVER (p ROWS 19 PRECEDING) = 20 THEN abs(close - lag(close, 20) OVER p) / nullif(sum(d) OVER (p ROWS 19 PRECEDING), 0) END AS ker FROM (SELECT *, abs(close - lag(close) OVER ({W})) AS d FROM four_bars) WINDOW p AS ({W})")
def regime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = keyed_event_bars(spark, sf_dir)
    four = stage(keyed(resample(bars, "4 hours")), "higher")
    return studies.regime_filter(bars.select("symbol", "ts", "bar_no"), four, 4 * 3600).groupBy("symbol", "lrl").agg(F.count("*").alias("bars"))


@query("""SELECT count(*) AS submitted, count(r.k) AS stored, round(1 - count(r.k) / count(*), 6) AS lost_share FROM (SELECT DISTINCT lower(trim(p_type)) AS k FROM part) s
    LEFT JOIN (SELECT DISTINCT lower(trim(idea)) AS k FROM build_runs) r USING (k)""")
def idea_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    submitted = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("idea"))
    return studies.idea_accounting(submitted, runs_table(spark, sf_dir))


