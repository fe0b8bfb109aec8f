"""Queries over bars: resampling, calendars, signals and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import joins, signals
from ..sources import bars as source
from .registry import query
from .sql import W


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.keyed_event_bars(spark, sf_dir)


@query("SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM bars")
def bars_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_bars(spark, sf_dir).select("symbol", clock.stamp("ts").alias("ts"), "open", "high", "low", "close", "volume")


@query("""SELECT symbol, strftime(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')""")
def bars_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.resample(source.event_bars(spark, sf_dir), "4 hours").withColumn("ts", clock.stamp("ts"))


@query("""SELECT symbol, bar_no // 7 AS bucket, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(open, bar_no) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, bar_no) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2 HAVING count(*) = 7""")
def bars_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.resample_rows(source.event_bars(spark, sf_dir), 7).withColumn("ts", clock.stamp("ts"))


_MINUTES = "SELECT *, hour(ny) * 60 + minute(ny) AS m, hour(ny) AS h, hour(ts) * 60 + minute(ts) AS u FROM bars"
_IN = "(h >= 19 OR h < 4)::INT + (h >= 2 AND h < 11)::INT + (h >= 8 AND h < 17)::INT"


@query(f"""SELECT symbol, CASE WHEN {_IN} > 1 THEN 'overlap' WHEN h >= 19 OR h < 4 THEN 'asia' WHEN h >= 2 AND h < 11 THEN 'london' WHEN h >= 8 AND h < 17 THEN 'ny' ELSE '' END AS session,
           CASE WHEN m >= 1080 OR m < 120 THEN 'Asia' WHEN m < 480 THEN 'London' WHEN m < 570 THEN 'PreM' WHEN m < 720 THEN 'AM' WHEN m < 810 THEN 'Lunch' WHEN m < 960 THEN 'PM' ELSE 'AH' END AS seven,
           CASE WHEN u >= 420 AND u < 780 THEN 'london' WHEN u >= 780 AND u < 1260 THEN 'ny' ELSE 'asia' END AS trade,
           CASE WHEN m >= 120 AND m < 300 THEN 'london' WHEN m >= 420 AND m < 660 THEN 'ny_am' WHEN m >= 810 AND m < 960 THEN 'ny_pm' END AS kill_zone,
           CASE WHEN m >= 1080 OR m < 120 THEN 'Overnight' WHEN m < 570 THEN 'London' WHEN m < 720 THEN 'NY Open' WHEN m < 810 THEN 'Lunch' WHEN m < 960 THEN 'PM' END AS level,
           CAST((dayofweek(ny + INTERVAL 6 HOUR) + 6) % 7 AS INT) AS weekday, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume
    FROM timed GROUP BY ALL""", timed=_MINUTES)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ny = clock.local("ts")
    return _bars(spark, sf_dir).groupBy(
        "symbol", clock.session_name(ny).alias("session"), clock.session_map(ny, "seven").alias("seven"), clock.session_map(F.col("ts"), "utc_trade").alias("trade"),
        clock.session_map(ny, "kill_zones").alias("kill_zone"), clock.session_map(ny, "level").alias("level"), clock.trading_weekday(ny).alias("weekday"),
    ).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("SELECT symbol, bar_no, round(atr, 6) AS atr, round(atr_before, 6) AS atr_before, round(atr50, 6) AS atr_smooth FROM atr50")
def true_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signals.smoothed_atr(signals.atr(signals.atr(_bars(spark, sf_dir)), out="atr_before", shifted=True))
    return b.select("symbol", "bar_no", *[F.round(c, 6).alias(c) for c in ("atr", "atr_before", "atr_smooth")])


@query(f"""
    SELECT symbol, bar_no, above AND NOT coalesce(lag(above) OVER ({W}), false) AS bos_bull, below AND NOT coalesce(lag(below) OVER ({W}), false) AS bos_bear, hi AS bos_level_high, lo AS bos_level_low
    FROM (SELECT *, coalesce(close > hi, false) AS above, coalesce(close < lo, false) AS below FROM leveled)""",
    swings=f"SELECT *, CASE WHEN bar_no >= 4 AND high = max(high) OVER ({W} ROWS 4 PRECEDING) THEN high END AS sh, CASE WHEN bar_no >= 4 AND low = min(low) OVER ({W} ROWS 4 PRECEDING) THEN low END AS sl FROM bars",
    leveled=f"SELECT *, last_value(sh IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, last_value(sl IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM swings",
)
def structure_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.break_of_structure(_bars(spark, sf_dir)).select("symbol", "bar_no", "bos_bull", "bos_bear", "bos_level_high", "bos_level_low")


@query("""SELECT symbol, bar_no, coalesce(b > atr_before * 1.5 AND b / nullif(r, 0) >= 0.5, false) AND close > open AS disp_bull, coalesce(b > atr_before * 1.5 AND b / nullif(r, 0) >= 0.5, false) AND close < open AS disp_bear,
           coalesce(b > atr_before * 1.2 AND (close - low) / nullif(r, 0) >= 0.75, false) AND close > open AS entry_bull, coalesce(b > atr_before * 1.2 AND (close - low) / nullif(r, 0) <= 0.25, false) AND close < open AS entry_bear
    FROM (SELECT *, abs(close - open) AS b, high - low AS r FROM atrs)""")
def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signals.displacement_entry(signals.displacement(_bars(spark, sf_dir)))
    return b.select("symbol", "bar_no", "disp_bull", "disp_bear", "entry_bull", "entry_bear")


@query("""SELECT symbol, bar_no, hi AS dr_high, lo AS dr_low, (hi + lo) / 2 AS dr_mid, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END, 6) AS dr_pct,
           close BETWEEN lo AND hi AS in_range, close > (hi + lo) / 2 AS premium, close < (hi + lo) / 2 AS discount FROM ranged""",
    ranged=f"SELECT *, max(high) OVER ({W} ROWS 19 PRECEDING) AS hi, min(low) OVER ({W} ROWS 19 PRECEDING) AS lo FROM bars")
def dealing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signals.dealing_range(_bars(spark, sf_dir))
    return b.select("symbol", "bar_no", "dr_high", "dr_low", "dr_mid", F.round("dr_pct", 6).alias("dr_pct"), "in_range", "premium", "discount")


@query("""SELECT b.symbol, bar_no, m >= 570 AND m < 600 AS in_or, m >= 600 AND h IS NOT NULL AS or_done, CASE WHEN m >= 600 THEN h END AS or_high, CASE WHEN m >= 600 THEN l END AS or_low
    FROM timed b LEFT JOIN (SELECT symbol, CAST(ny AS DATE) AS d, max(high) AS h, min(low) AS l FROM timed WHERE m >= 570 AND m < 600 GROUP BY 1, 2) o ON o.symbol = b.symbol AND o.d = CAST(b.ny AS DATE)""",
    timed="SELECT * EXCLUDE (h), hour(ny) * 60 + minute(ny) AS m FROM (SELECT *, 0 AS h FROM bars)")
def opening_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.opening_range(_bars(spark, sf_dir)).select("symbol", "bar_no", "in_or", "or_done", "or_high", "or_low")


_DAILY = "SELECT symbol, date_trunc('day', ts) AS d, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2"


@query("""SELECT b.symbol, bar_no, inside AS inside_day, CASE WHEN inside THEN h2 END AS inside_high, CASE WHEN inside THEN l2 END AS inside_low,
           inside AND coalesce(close > h1, false) AS inside_break_up, inside AND coalesce(close < l1, false) AS inside_break_down
    FROM bars b JOIN dayed ON dayed.symbol = b.symbol AND d = date_trunc('day', b.ts)""", daily=_DAILY,
    dayed="SELECT symbol, d, h1, l1, h2, l2, coalesce(h1 <= h2 AND l1 >= l2, false) AS inside FROM (SELECT *, lag(high) OVER x AS h1, lag(low) OVER x AS l1, lag(high, 2) OVER x AS h2, lag(low, 2) OVER x AS l2 FROM daily WINDOW x AS (PARTITION BY symbol ORDER BY d))")
def inside_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.inside_day(_bars(spark, sf_dir)).select("symbol", "bar_no", "inside_day", "inside_high", "inside_low", "inside_break_up", "inside_break_down")


@query("""SELECT b.symbol, bar_no, d.h AS prev_day_high, d.l AS prev_day_low, w.h AS prev_week_high, w.l AS prev_week_low FROM bars b
    JOIN (SELECT symbol, p, lag(h) OVER (PARTITION BY symbol ORDER BY p) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY p) AS l FROM pd) d ON d.symbol = b.symbol AND d.p = date_trunc('day', b.ts)
    JOIN (SELECT symbol, p, lag(h) OVER (PARTITION BY symbol ORDER BY p) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY p) AS l FROM pw) w ON w.symbol = b.symbol AND w.p = date_trunc('week', b.ts)""",
    pd="SELECT symbol, date_trunc('day', ts) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2", pw="SELECT symbol, date_trunc('week', ts) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2")
def previous_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.previous_levels(_bars(spark, sf_dir), ("day", "week")).select("symbol", "bar_no", "prev_day_high", "prev_day_low", "prev_week_high", "prev_week_low")


@query("""SELECT symbol, bar_no, round(avg(dx) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING), 6) AS adx FROM (
        SELECT *, abs(u / nullif(t, 0) - v / nullif(t, 0)) / nullif(u / nullif(t, 0) + v / nullif(t, 0), 0) * 100 AS dx FROM (
            SELECT symbol, bar_no, avg(u) OVER w AS u, avg(v) OVER w AS v, avg(tr) OVER w AS t FROM moves WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING)))""",
    moves=f"SELECT *, greatest(high - lag(high) OVER ({W}), 0) AS u, greatest(lag(low) OVER ({W}) - low, 0) AS v FROM tr")
def directional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.adx(_bars(spark, sf_dir)).select("symbol", "bar_no", F.round("adx", 6).alias("adx"))


@query(f"""SELECT symbol, bar_no, round(abs(close - lag(close, 20) OVER ({W})) / nullif(sum(d) OVER ({W} ROWS 19 PRECEDING), 0), 6) AS ker
    FROM (SELECT *, abs(close - lag(close) OVER ({W})) AS d FROM bars)""")
def efficiency_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.efficiency_ratio(_bars(spark, sf_dir)).select("symbol", "bar_no", F.round("ker", 6).alias("ker"))


_LAGS = range(2, 20)
_HURST = f"""SELECT *, {", ".join(f"CASE WHEN count(r{k}) OVER (o ROWS BETWEEN {100 - k} PRECEDING AND 1 PRECEDING) >= 2 THEN stddev_samp(r{k}) OVER (o ROWS BETWEEN {100 - k} PRECEDING AND 1 PRECEDING) END AS s{k}" for k in _LAGS)},
        count(lg) OVER (o ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS n
        FROM (SELECT *, {", ".join(f"lg - lag(lg, {k}) OVER o AS r{k}" for k in _LAGS)} FROM (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS lg FROM bars) WINDOW o AS ({W})) WINDOW o AS ({W})"""


HURST_SQL = {
    "devs": _HURST,
    "points": "SELECT symbol, bar_no, n, unnest([" + ", ".join(f"ln({k})" for k in _LAGS) + "]) AS x, unnest([" + ", ".join(f"CASE WHEN s{k} > 0 THEN ln(s{k}) END" for k in _LAGS) + "]) AS y FROM devs",
    "sloped": "SELECT symbol, bar_no, n, count(y) AS k, (count(y) * sum(x * y) - sum(x) FILTER (y IS NOT NULL) * sum(y)) / nullif(count(y) * sum(x * x) FILTER (y IS NOT NULL) - pow(sum(x) FILTER (y IS NOT NULL), 2), 0) AS slope FROM points GROUP BY 1, 2, 3",
}


@query("SELECT symbol, bar_no, round(CASE WHEN n >= 16 AND k >= 2 THEN least(greatest(slope, 0), 1) ELSE 0.5 END, 6) AS hurst FROM sloped", **HURST_SQL)
def hurst_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.hurst(_bars(spark, sf_dir)).select("symbol", "bar_no", F.round("hurst", 6).alias("hurst"))


_WINDOW_STATE = """CASE WHEN (du >= 2 OR dd >= 2) AND du >= dd THEN 'DU' WHEN dd >= 2 THEN 'DD' WHEN su >= 3 THEN 'SU' WHEN sd >= 3 THEN 'SD' WHEN c >= 3 THEN 'C'
    WHEN du = 1 THEN 'DU' WHEN dd = 1 THEN 'DD' WHEN su >= 1 AND su >= sd THEN 'SU' WHEN sd >= 1 THEN 'SD' ELSE 'N' END"""


@query(f"""SELECT symbol, state, {_WINDOW_STATE} AS window_state, count(*) AS n FROM (
        SELECT symbol, state, {", ".join(f"coalesce(sum((state = '{s}')::INT) OVER p, 0) AS {s.lower()}" for s in ("C", "SU", "SD", "DU", "DD"))} FROM states
        WINDOW p AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) GROUP BY 1, 2, 3""")
def bar_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.window_state(signals.states(_bars(spark, sf_dir))).groupBy("symbol", "state", "window_state").agg(F.count("*").alias("n"))


@query(f"""SELECT symbol, bar_no, coalesce(lag(hit) OVER ({W}), false) AS pre_disp FROM (
        SELECT *, state IN ('SU', 'SD') AND max((state = 'C')::INT) OVER ({W} ROWS 10 PRECEDING) = 1 AS hit FROM states)""")
def pre_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.pre_displacement(signals.states(_bars(spark, sf_dir)), within=10).select("symbol", "bar_no", "pre_disp")


@query("""SELECT symbol, strftime(d, '%Y-%m-%d') AS period, greatest(open, p) AS gap_top, least(open, p) AS gap_bottom, (greatest(open, p) + least(open, p)) / 2 AS gap_mid,
           greatest(open, p) - least(open, p) AS gap_size, CAST(sign(open - p) AS INT) AS direction FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS p FROM daily) WHERE p IS NOT NULL AND open <> p""", daily=_DAILY)
def opening_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.opening_gaps(_bars(spark, sf_dir)).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(f"SELECT symbol, bar_no, close FROM (SELECT *, lag(hour(chi)) OVER ({W}) AS was FROM bars) WHERE hour(chi) >= 15 AND was < 15")
def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.settlements(_bars(spark, sf_dir)).select("symbol", "bar_no", "close")


@query(f"""SELECT symbol, bar_no, round(v, 6) AS volatility, trending, coalesce(v > quantile_cont(v, 0.66) OVER ({W} ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING), false) AS high_volatility FROM (
        SELECT symbol, bar_no, round(stddev_pop(close) OVER p, 9) AS v,
           coalesce((close - min(low) OVER p) / nullif(max(high) OVER p - min(low) OVER p, 0) <= 0.2 OR (close - min(low) OVER p) / nullif(max(high) OVER p - min(low) OVER p, 0) >= 1 - 0.2, false) AS trending
        FROM bars WINDOW p AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""")
def regime_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.regime_masks(_bars(spark, sf_dir)).select("symbol", "bar_no", F.round("volatility", 6).alias("volatility"), "trending", "high_volatility")


@query(f"SELECT symbol, bar_no, bar_no - last_value(CASE WHEN bull THEN bar_no END IGNORE NULLS) OVER ({W}) AS zone_age FROM gaps")
def zone_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.zone_age(signals.fair_value_gap(_bars(spark, sf_dir)), "fvg_bull").select("symbol", "bar_no", "zone_age")


@query("""SELECT b.symbol, b.bar_no, (SELECT arg_max(h.close, h.ts) FROM four h WHERE h.symbol = b.symbol AND h.ts + INTERVAL 4 HOUR <= b.ts) AS htf_close FROM bars b""",
    four="SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2")
def higher_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    four = source.resample(b, "4 hours").select("symbol", "ts", F.col("close").alias("htf_close"))
    return joins.carry_higher_frame(b.select("symbol", "ts", "bar_no"), four, ["htf_close"], 4 * 3600).select("symbol", "bar_no", "htf_close")


@query("""SELECT symbol, bar_no FROM bars b WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.value > 150 AND abs(epoch_us(e.ts) - epoch_us(b.ts)) <= 300000000)""")
def news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = source.read_table(spark, sf_dir, "events").where("event_type = 'error' and value > 150").select(F.col("ts").cast("timestamp").alias("event_ts"))
    return joins.near_events(_bars(spark, sf_dir), news, 5).select("symbol", "bar_no")
