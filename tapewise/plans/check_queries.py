"""Queries over the checks of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import local, session_map
from ..functions.draws import drawn_sql
from ..operators import checks, levels, outcomes, signals, zones
from ..sources.bars import keyed_event_bars
from ..sources.store import stage
from .pattern_queries import _KER
from .registry import query
from .research_queries import _LIFE, _PERIODS, LEVELS, _lined, _moved, _states
from .sql import W
from .zone_queries import gap_zones


@query("""SELECT symbol, w AS "window", phase, bars, hits, "both", round(("both" / nullif(hits, 0)) / nullif(events / bars, 0), 6) AS lift FROM (
        SELECT symbol, w, CASE WHEN bar_no - w * 100 < 180 THEN 'train' ELSE 'test' END AS phase, count(*) AS bars, count(*) FILTER (calm) AS hits, count(*) FILTER (state IN ('DU', 'DD')) AS events, count(*) FILTER (calm AND state IN ('DU', 'DD')) AS "both"
        FROM (SELECT *, state = 'C' AS calm, max(bar_no) OVER (PARTITION BY symbol) + 1 AS n, unnest(range(CAST(bar_no // 100 AS BIGINT) + 1)) AS w FROM states) WHERE bar_no - w * 100 < 300 AND w * 100 + 300 <= n GROUP BY 1, 2, 3)""")
def sliding_split_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.split_rates(checks.sliding_splits(_states(spark, sf_dir), 300, 100), F.col("state") == "C", _moved())


def _noisy(column: str, k: int) -> str:
    u = [f"({drawn_sql('11', str(k), str(j), 'symbol', 'bar_no')} % {1 << 30} + 1) / {(1 << 30) + 1}.0::DOUBLE" for j in (0, 1)]
    return f"{column} * (1 + share * sqrt(-2 * ln({u[0]})) * cos(6.283185307179586 * ({u[1]}))) AS {column}"


@query("""SELECT h.symbol, h.noise, h.hits, round(h.kept, 6) AS kept, CASE WHEN kept >= 0.8 THEN 'stable' WHEN kept >= 0.5 THEN 'drift' ELSE 'break' END AS label FROM (
        SELECT g.symbol, n.share AS noise, count(*) FILTER (g.bull) AS hits, count(*) FILTER (g.bull AND n.bull) / count(*) FILTER (g.bull) AS kept FROM gaps g JOIN noisy_gaps n USING (symbol, bar_no) GROUP BY 1, 2) h WHERE hits > 0""",
    shaken="SELECT symbol, bar_no, share, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low FROM (SELECT symbol, bar_no, share, " + ", ".join(_noisy(c, k) for k, c in enumerate(("open", "high", "low", "close")))
    + " FROM bars, (SELECT unnest([0.001::DOUBLE, 0.002, 0.005]) AS share))",
    noisy_gaps="SELECT *, coalesce(low - lag(high, 2) OVER (PARTITION BY symbol, share ORDER BY bar_no) > 0, false) AS bull FROM shaken")
def noise_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.noise_check(stage(keyed_event_bars(spark, sf_dir), "bars"), signals.fair_value_gap, "fvg_bull")


_MOVED = f"SELECT * FROM (SELECT *, abs(lead(close, 60) OVER ({W}) - close) AS move FROM atrs) WHERE move IS NOT NULL AND atr IS NOT NULL"


@query("""SELECT symbol, count(*) FILTER (move >= cut) AS large, round(avg(atr) FILTER (move >= cut), 6) AS before_large, round(avg(atr) FILTER (move < cut), 6) AS otherwise
    FROM (SELECT *, quantile_cont(move, 0.95) OVER (PARTITION BY symbol) AS cut FROM moved) GROUP BY 1""", moved=_MOVED)
def before_large_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.before_large_moves(signals.atr(keyed_event_bars(spark, sf_dir)), "atr")


@query("""SELECT symbol, decile, count(*) AS bars, round(avg(move), 6) AS move FROM (SELECT m.symbol, move, CAST(len(list_filter(q, lambda x: x < atr)) + 1 AS INT) AS decile FROM moved m
    JOIN (SELECT symbol, quantile_cont(atr, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM moved GROUP BY 1) USING (symbol)) GROUP BY 1, 2""", moved=_MOVED)
def decile_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.decile_moves(signals.atr(keyed_event_bars(spark, sf_dir)), "atr")


@query("""SELECT symbol, count(*) FILTER (hit) AS signals, count(*) FILTER (hit AND span > 2 * m) AS hits FROM tails WHERE bar_no > last_no - 400 GROUP BY 1""",
    tails=f"""SELECT symbol, bar_no, coalesce(max((state = 'C')::INT) OVER p = 1 AND max((state IN ('SU', 'SD'))::INT) OVER p = 1, false) AS hit, max(high) OVER f - min(low) OVER f AS span,
        max(bar_no) OVER (PARTITION BY symbol) AS last_no, median(atr) OVER (PARTITION BY symbol) AS m FROM states
        WINDOW p AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)""")
def tail_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.tail_check(signals.atr(_states(spark, sf_dir)), 400)


@query("""SELECT t.symbol, CAST(least(n, 3) AS INT) AS others, count(*) AS touches, count(*) FILTER (side * (b.close - price) > 0) AS bounces FROM (
        SELECT t.symbol, t.bar_no, t.price, t.side, t.touch_no, count(o.bar_no) AS n FROM touch t LEFT JOIN active o
            ON o.symbol = t.symbol AND o.bar_no <> t.bar_no AND o.bar_no < t.touch_no AND t.touch_no <= o.until AND abs(o.price - t.price) <= 20 GROUP BY ALL) t
    JOIN bars b ON b.symbol = t.symbol AND b.bar_no = t.touch_no + 15 GROUP BY 1, 2""", **_LIFE,
    active="SELECT symbol, bar_no, price, side, bar_no + coalesce(filled_after, 240) AS until FROM lives WHERE side IS NOT NULL",
    touch="SELECT a.symbol, a.bar_no, a.price, a.side, min(b.bar_no) AS touch_no FROM active a JOIN bars b ON b.symbol = a.symbol AND b.bar_no BETWEEN a.bar_no + 1 AND a.until WHERE b.low <= a.price AND b.high >= a.price GROUP BY 1, 2, 3, 4")
def settlement_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stage(keyed_event_bars(spark, sf_dir), "bars")
    life = stage(levels.level_life(signals.settlements(b).withColumnRenamed("close", "price"), b), "lives")
    return checks.level_clusters(life, b)


@query("""SELECT symbol, CASE WHEN ker > mk THEN 'high' ELSE 'low' END AS ker, CASE WHEN atr > ma THEN 'high' ELSE 'low' END AS atr, count(*) AS touches, count(*) FILTER (bounced) AS bounces FROM (
        SELECT t.symbol, k.ker, k.atr, t.bounced, median(k.ker) OVER (PARTITION BY t.symbol) AS mk, median(k.atr) OVER (PARTITION BY t.symbol) AS ma
        FROM touched t JOIN kers k ON k.symbol = t.symbol AND k.bar_no = t.bar_no WHERE k.ker IS NOT NULL AND k.atr IS NOT NULL) GROUP BY 1, 2, 3""", **_PERIODS, kers=_KER)
def level_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _lined(spark, sf_dir)
    return checks.touches_by_regime(levels.touches(b, LEVELS), signals.efficiency_ratio(signals.atr(b)))


_KIND = """SELECT '{name}' AS kind, e.symbol, e.side, born_no AS bar_no, entry - far AS size, fill_no IS NOT NULL AS filled FROM {table} e"""


@query(f"""SELECT k.symbol, kind, count(*) AS births, round(avg(filled::INT) * 100, 4) AS filled_pct, round(median(size), 6) AS size,
        round(median(CASE WHEN side = 'bull' THEN mfe_up ELSE mae_up END), 6) AS mfe, round(median(CASE WHEN side = 'bull' THEN mae_up ELSE mfe_up END), 6) AS mae
    FROM ({_KIND.format(name="gap", table="episodes")} UNION ALL {_KIND.format(name="wide gap", table="episodes") + " WHERE entry - far >= 20"}) k LEFT JOIN fwd60 f ON f.symbol = k.symbol AND f.bar_no = k.bar_no GROUP BY 1, 2""",
    fwd60=f"""SELECT symbol, bar_no, CASE WHEN count(close) OVER n60 = 60 THEN max(high) OVER n60 - close END AS mfe_up, CASE WHEN count(close) OVER n60 = 60 THEN close - min(low) OVER n60 END AS mae_up
        FROM bars WINDOW n60 AS ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)""")
def zone_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, b = gap_zones(spark, sf_dir)
    e = stage(zones.episodes(z), "episodes")
    return checks.zone_kinds({"gap": e, "wide gap": e.where(F.col("entry") - F.col("far") >= 20)}, b)


_RANGES = f"""SELECT *, (max(high) OVER r + min(low) OVER r) / 2 AS mid FROM bars WINDOW r AS ({W} ROWS 19 PRECEDING)"""


@query(f"""SELECT symbol, side, horizon, count(*) AS bars, round(avg(net), 6) AS mean, count(*) FILTER (net > 0) AS gains FROM (
        SELECT symbol, side, horizon, CASE WHEN side = 'premium' THEN -1 ELSE 1 END * net AS net FROM (
            SELECT symbol, CASE WHEN close > mid THEN 'premium' WHEN close < mid THEN 'discount' END AS side, unnest([5, 15, 60]) AS horizon,
                   unnest([lead(close, 5) OVER ({W}) - close, lead(close, 15) OVER ({W}) - close, lead(close, 60) OVER ({W}) - close]) AS net FROM ranges)
        WHERE side IS NOT NULL AND net IS NOT NULL) GROUP BY 1, 2, 3""", ranges=_RANGES)
def range_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.range_returns(signals.dealing_range(keyed_event_bars(spark, sf_dir)))


@query(f"""SELECT symbol, CASE WHEN was > mid THEN 'above' ELSE 'below' END AS side, count(*) AS touches, count(*) FILTER (CASE WHEN was > mid THEN later > mid ELSE later < mid END) AS bounces FROM (
        SELECT *, lag(close) OVER ({W}) AS was, lead(close, 15) OVER ({W}) AS later FROM ranges) WHERE low <= mid AND high >= mid AND later IS NOT NULL AND was IS NOT NULL GROUP BY 1, 2""", ranges=_RANGES)
def middle_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.middle_touches(signals.dealing_range(keyed_event_bars(spark, sf_dir)))


@query(f"""SELECT symbol, flag, signals, round(signals / days, 6) AS per_day, round(f[1], 6) AS mfe_p50, round(f[2], 6) AS mfe_p75, round(f[3], 6) AS mfe_p90,
        round(a[1], 6) AS mae_p50, round(a[2], 6) AS mae_p80, round(a[3], 6) AS mae_p90, round(a[4], 6) AS mae_p95 FROM (
        SELECT symbol, flag, count(*) AS signals, quantile_cont(CASE WHEN up IS NOT NULL THEN greatest(CASE WHEN flag = 'fvg_bull' THEN up ELSE down END, 0) END, [0.5, 0.75, 0.9]) AS f,
               quantile_cont(CASE WHEN up IS NOT NULL THEN greatest(CASE WHEN flag = 'fvg_bull' THEN down ELSE up END, 0) END, [0.5, 0.8, 0.9, 0.95]) AS a
        FROM (SELECT *, unnest(CASE WHEN bull THEN ['fvg_bull'] ELSE [] END || CASE WHEN bear THEN ['fvg_bear'] ELSE [] END) AS flag FROM (
            SELECT symbol, bull, bear, max(high) OVER n - close AS up, close - min(low) OVER n AS down FROM gaps WINDOW n AS ({W} ROWS BETWEEN 1 FOLLOWING AND 200 FOLLOWING))) GROUP BY 1, 2)
    JOIN (SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS days FROM bars GROUP BY 1) USING (symbol)""")
def entry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.entry_statistics(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), {"fvg_bull": 1, "fvg_bear": -1})


@query(f"""SELECT symbol, bar_no, coalesce(hit, last_step) AS exit_step, CASE WHEN hit IS NULL THEN 'timeout' ELSE 'trail' END AS outcome, round(CASE WHEN hit IS NULL THEN last_close ELSE p END, 6) AS exit_price FROM (
        SELECT symbol, bar_no, min(step) FILTER (h) AS hit, arg_min(stop, step) FILTER (h) AS p, max(step) AS last_step, arg_max(close, step) AS last_close FROM (
            SELECT *, coalesce(ran = 1 AND low <= stop, false) AS h FROM (
                SELECT e.symbol, e.bar_no, b.bar_no - e.bar_no AS step, b.low, b.close, max(b.high - 2.0 * b.atr) OVER w AS stop, max((b.high - e.close >= b.atr)::INT) OVER w AS ran
                FROM (SELECT symbol, bar_no, close FROM gaps WHERE bull) e JOIN atrs b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 120
                WINDOW w AS (PARTITION BY e.symbol, e.bar_no ORDER BY b.bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY 1, 2)""")
def atr_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stage(signals.atr(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "bars")
    e = b.where("fvg_bull").select("symbol", "bar_no", F.lit(1).alias("direction"), F.col("close").alias("entry"))
    out = checks.atr_trail_exit(e, b, 120, 2.0, 1.0)
    return out.select("symbol", "bar_no", "exit_step", "outcome", F.round("exit_price", 6).alias("exit_price"))


@query("SELECT symbol, direction, entry_no, exit_no, place FROM (SELECT *, unnest(CASE WHEN u <= 5 THEN [u] ELSE [] END || CASE WHEN d <= 5 THEN [-d] ELSE [] END) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, bar_no) AS u, row_number() OVER (PARTITION BY symbol ORDER BY pnl, bar_no) AS d FROM trails))".replace("direction, entry_no, exit_no", "bar_no"),
    trails=f"""SELECT symbol, bar_no, CASE WHEN n >= 15 THEN later - close END AS pnl FROM (SELECT *, lead(close, 15) OVER ({W}) AS later, count(*) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS n FROM gaps) WHERE bull AND n >= 15""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = outcomes.forward_excursion(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), 15).where("fvg_bull and net is not null")
    return checks.extremes(b.select("symbol", "bar_no", F.col("net").alias("pnl")), "symbol", key="bar_no").select("symbol", "bar_no", F.col("place").cast("long").alias("place"))


@query("""SELECT symbol, side, CAST(visit AS BIGINT) AS visit, count(*) AS n, median(bars) AS inside, median(outside) AS outside, count(*) FILTER (result = 'bounce') AS bounce, count(*) FILTER (result = 'break') AS "break",
        count(*) FILTER (result = 'unclear') AS unclear, count(*) FILTER (result = 'break' AND again <= 120) AS touched_again FROM (
        SELECT r.*, coalesce(first_no - lag(last_no) OVER v - 1, 0) AS outside, lead(first_no) OVER v - last_no AS again, CASE WHEN n.px > r.entry THEN 'bounce' WHEN n.px < r.far THEN 'break' ELSE 'unclear' END AS result
        FROM stays r LEFT JOIN zone_bars n ON n.symbol = r.symbol AND n.side = r.side AND n.zone_id = r.zone_id AND n.bar_no = r.last_no + 1
        WINDOW v AS (PARTITION BY r.symbol, r.side, r.zone_id ORDER BY visit)) WHERE visit <= 4 GROUP BY 1, 2, 3""",
    within_="SELECT *, bar_no - row_number() OVER (PARTITION BY symbol, side, zone_id ORDER BY bar_no) AS island FROM zone_bars WHERE bar_no > born_no AND lo <= entry AND hi >= far",
    stays="SELECT symbol, side, zone_id, entry, far, row_number() OVER (PARTITION BY symbol, side, zone_id ORDER BY island) AS visit, count(*) AS bars, min(bar_no) AS first_no, max(bar_no) AS last_no FROM within_ GROUP BY symbol, side, zone_id, entry, far, island")
def visit_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.visit_durations(gap_zones(spark, sf_dir)[0])


_SESSIONS = ("Asia", "London", "NY_AM", "NY_PM")
_RANGES = {
    "labelled": f"""SELECT *, CAST(ny + INTERVAL 6 HOUR AS DATE) AS d, CASE WHEN m >= 1080 OR m < 120 THEN 'Asia' WHEN m < 480 THEN 'London' WHEN m < 720 THEN 'NY_AM' WHEN m < 960 THEN 'NY_PM' ELSE 'Post' END AS label,
        {", ".join(f"lead(close, {n}) OVER ({W}) - close AS net_{n}" for n in (5, 15, 60))} FROM (SELECT *, hour(ny) * 60 + minute(ny) AS m FROM bars)""",
    "finished": "SELECT symbol, label AS session, d, max(high) AS s_high, min(low) AS s_low, max(bar_no) AS end_no FROM labelled WHERE label <> 'Post' GROUP BY 1, 2, 3",
    "ranged": """SELECT *, (s_high + s_low) / 2 AS s_mid, close > (s_high + s_low) / 2 AS premium, close < (s_high + s_low) / 2 AS discount FROM (
        SELECT b.symbol, b.bar_no, b.high, b.low, b.close, b.net_5, b.net_15, b.net_60, s.session, r.s_high, r.s_low FROM labelled b JOIN (SELECT unnest(['Asia', 'London', 'NY_AM', 'NY_PM']) AS session) s ON s.session <> b.label
            ASOF JOIN finished r ON r.symbol = b.symbol AND r.session = s.session AND r.end_no < b.bar_no)""",
    "sided": "SELECT *, CASE WHEN premium THEN 'premium' ELSE 'discount' END AS side, CASE WHEN premium THEN -1 ELSE 1 END AS sgn FROM ranged WHERE premium OR discount",
}


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(checks.session_ranges(keyed_event_bars(spark, sf_dir), session_map(local("ts"), "ny_halves"), _SESSIONS), "ranges")


@query("""SELECT symbol, session, count(*) AS bars, round(avg(s_high - s_low), 6) AS span, round(median(s_high - s_low), 6) AS median_span,
        count(*) FILTER (t AND low <= s_mid AND high >= s_mid) AS mid_touches, count(*) FILTER (t AND low <= s_mid AND high >= s_mid AND CASE WHEN close > s_mid THEN close + net_15 > s_mid ELSE close + net_15 < s_mid END) AS mid_bounces,
        count(*) FILTER (t AND high >= s_high AND low < s_high) AS high_touches, count(*) FILTER (t AND high >= s_high AND low < s_high AND close + net_15 < s_high) AS high_bounces,
        count(*) FILTER (t AND low <= s_low AND high > s_low) AS low_touches, count(*) FILTER (t AND low <= s_low AND high > s_low AND close + net_15 > s_low) AS low_bounces
    FROM (SELECT *, net_15 IS NOT NULL AS t FROM ranged) GROUP BY 1, 2""", **_RANGES)
def session_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.session_touches(_ranges(spark, sf_dir))


@query("SELECT symbol, session, side, h AS horizon, count(*) AS bars, round(avg(sgn * net), 6) AS mean, count(*) FILTER (sgn * net > 0) AS gains FROM (SELECT *, unnest([5, 15, 60]) AS h, unnest([net_5, net_15, net_60]) AS net FROM sided) WHERE net IS NOT NULL GROUP BY 1, 2, 3, 4", **_RANGES)
def session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.session_returns(_ranges(spark, sf_dir))


@query("""SELECT symbol, side, l AS level, count(*) AS bars, round(avg(gain), 6) AS mean, count(*) FILTER (gain > 0) AS gains FROM (SELECT symbol, bar_no, side, count(*) AS n, any_value(sgn * net_15) AS gain FROM sided WHERE net_15 IS NOT NULL GROUP BY 1, 2, 3),
        (SELECT unnest([1, 2, 3, 4]) AS l) WHERE n >= l GROUP BY 1, 2, 3""", **_RANGES)
def session_confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.session_confluence(_ranges(spark, sf_dir))


@query("""SELECT s.symbol, session, side, count(*) AS touches, count(*) FILTER (sgn * net_15 > 0) AS gains FROM sided s JOIN (SELECT DISTINCT symbol, bar_no FROM zone_bars WHERE bar_no > born_no AND lo <= entry AND hi >= far) t USING (symbol, bar_no)
    WHERE net_15 IS NOT NULL GROUP BY 1, 2, 3""", **_RANGES)
def session_zone_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoned = zones.zone_bars(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))).where("bar_no > born_no and lo <= entry and hi >= far")
    return checks.session_filter(_ranges(spark, sf_dir), zoned)
