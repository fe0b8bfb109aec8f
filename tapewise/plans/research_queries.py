"""Queries over levels, forward outcomes, chains and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import local
from ..operators import chains, levels, outcomes, regimes, signals
from ..operators.frames import last, windowed
from ..sources.bars import keyed_event_bars
from ..sources.store import stage
from .registry import query
from .sql import W
from .zone_queries import _FILLS, _GAP_STATE

LEVELS = ["prev_day_high", "prev_day_low", "prev_week_high", "prev_week_low"]

_PERIODS = {
    "pd": "SELECT symbol, date_trunc('day', ts) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2",
    "pw": "SELECT symbol, date_trunc('week', ts) AS p, max(high) AS h, min(low) AS l FROM bars GROUP BY 1, 2",
    "ld": "SELECT symbol, p, lag(h) OVER (PARTITION BY symbol ORDER BY p) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY p) AS l FROM pd",
    "lw": "SELECT symbol, p, lag(h) OVER (PARTITION BY symbol ORDER BY p) AS h, lag(l) OVER (PARTITION BY symbol ORDER BY p) AS l FROM pw",
    "lined": """SELECT b.*, ld.h AS prev_day_high, ld.l AS prev_day_low, lw.h AS prev_week_high, lw.l AS prev_week_low, lag(close) OVER (PARTITION BY b.symbol ORDER BY bar_no) AS was
        FROM bars b JOIN ld ON ld.symbol = b.symbol AND ld.p = date_trunc('day', b.ts) JOIN lw ON lw.symbol = b.symbol AND lw.p = date_trunc('week', b.ts)""",
    "long": "UNPIVOT lined ON prev_day_high, prev_day_low, prev_week_high, prev_week_low INTO NAME level VALUE price",
    "episoded": """SELECT *, sum(fresh) OVER (PARTITION BY symbol, level ORDER BY bar_no) AS episode FROM (
        SELECT *, CASE WHEN lag(price) OVER (PARTITION BY symbol, level ORDER BY bar_no) = price AND lag(bar_no) OVER (PARTITION BY symbol, level ORDER BY bar_no) = bar_no - 1 THEN 0 ELSE 1 END AS fresh FROM long)""",
    "touched": """SELECT *, CASE WHEN side = 'above' THEN close > price ELSE close < price END AS bounced, greatest(CASE WHEN side = 'above' THEN price - low ELSE high - price END, 0) AS wick FROM (
        SELECT *, CASE WHEN CASE WHEN fresh = 1 OR was IS NULL THEN low >= price ELSE was > price END THEN 'above' ELSE 'below' END AS side,
               row_number() OVER (PARTITION BY symbol, level, episode ORDER BY bar_no) AS k FROM episoded WHERE low <= price AND high >= price) WHERE k = 1""",
}
_SUMMARY = "count(*) AS touches, count(*) FILTER (bounced) AS bounces, count(*) - count(*) FILTER (bounced) AS through, round(count(*) FILTER (bounced) / count(*) * 100, 1) AS bounce_pct"


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(signals.previous_levels(keyed_event_bars(spark, sf_dir), ("day", "week")), "lined")


@query("SELECT symbol, level, bar_no, price, side, bounced, round(wick, 6) AS wick FROM touched", **_PERIODS)
def level_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.touches(_lined(spark, sf_dir), LEVELS).select("symbol", "level", "bar_no", "price", "side", "bounced", F.round("wick", 6).alias("wick"))


@query(f"SELECT symbol, level, CASE v WHEN 1 THEN '1st' WHEN 2 THEN '2nd' ELSE '3rd+' END AS visit, {_SUMMARY} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, level, price ORDER BY bar_no) AS v FROM touched) GROUP BY 1, 2, 3", **_PERIODS)
def level_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.by_visit(levels.touches(_lined(spark, sf_dir), LEVELS))


@query(f"""SELECT symbol, level, weekday, session, side, {_SUMMARY} FROM (
        SELECT *, CAST((dayofweek(ny + INTERVAL 6 HOUR) + 6) % 7 AS INT) AS weekday,
               CASE WHEN m >= 1080 OR m < 120 THEN 'Overnight' WHEN m < 570 THEN 'London' WHEN m < 720 THEN 'NY Open' WHEN m < 810 THEN 'Lunch' WHEN m < 960 THEN 'PM' END AS session
        FROM (SELECT *, hour(ny) * 60 + minute(ny) AS m FROM touched)) WHERE session IS NOT NULL AND weekday < 5 GROUP BY 1, 2, 3, 4, 5""", **_PERIODS)
def level_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.by_clock(levels.touches(_lined(spark, sf_dir), LEVELS))


@query(f"""SELECT t.symbol, t.level, CASE WHEN {" OR ".join(f"(t.level <> '{c}' AND coalesce(abs(b.{c} - t.price) <= 10, false))" for c in LEVELS)} THEN 'nearby' ELSE 'alone' END AS place, {_SUMMARY}
    FROM touched t JOIN lined b ON b.symbol = t.symbol AND b.bar_no = t.bar_no GROUP BY 1, 2, 3""", **_PERIODS)
def level_confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _lined(spark, sf_dir)
    return levels.confluence(levels.touches(b, LEVELS), b, LEVELS)


@query("""SELECT symbol, CAST(hour(ny) AS INT) AS hour, count(*) AS bars, count(*) FILTER (abs(close - prev_day_high) <= 5) AS within_5, count(*) FILTER (abs(close - prev_day_high) <= 10) AS within_10,
           count(*) FILTER (abs(close - prev_day_high) <= 20) AS within_20, count(*) FILTER (abs(close - prev_day_high) <= 50) AS within_50 FROM lined WHERE prev_day_high IS NOT NULL GROUP BY 1, 2""", **_PERIODS)
def level_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.distance_profile(_lined(spark, sf_dir), "prev_day_high")


@query("""SELECT symbol, CASE WHEN open > p THEN 'above' ELSE 'below' END AS opened, count(*) AS days, count(*) FILTER (close > open) AS up_days, round(avg(close - open), 6) AS mean_move FROM (
        SELECT *, lag(settle) OVER (PARTITION BY symbol ORDER BY d) AS p FROM (
            SELECT symbol, CAST(chi AS DATE) AS d, arg_min(open, bar_no) AS open, arg_max(close, bar_no) AS close, arg_min(close, bar_no) FILTER (hour(chi) >= 15) AS settle FROM bars GROUP BY 1, 2)) WHERE p IS NOT NULL GROUP BY 1, 2""")
def settlement_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.settlement_bias(keyed_event_bars(spark, sf_dir))


@query("""SELECT symbol, direction, count(*) AS gaps, count(fill) AS filled, CAST(trunc(median(fill - f)) AS INT) AS median_bars FROM (
        SELECT g.symbol, g.d, g.direction, min(b.bar_no) AS f, min(b.bar_no) FILTER (CASE WHEN direction > 0 THEN b.low <= bottom ELSE b.high >= top END) AS fill
        FROM gapped g JOIN bars b ON b.symbol = g.symbol AND date_trunc('day', b.ts) = g.d GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    daily="SELECT symbol, date_trunc('day', ts) AS d, arg_min(open, ts) AS open, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2",
    gapped="SELECT *, CAST(sign(open - p) AS INT) AS direction, least(open, p) AS bottom, greatest(open, p) AS top FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS p FROM daily) WHERE p IS NOT NULL AND open <> p")
def gap_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = keyed_event_bars(spark, sf_dir)
    return levels.gap_fills(b, signals.opening_gaps(b))


_LIFE = {
    "settled": f"SELECT symbol, bar_no, close AS price FROM (SELECT *, lag(hour(chi)) OVER ({W}) AS was FROM bars) WHERE hour(chi) >= 15 AND was < 15",
    "off": "SELECT s.symbol, s.bar_no, s.price, b.bar_no - s.bar_no AS step, sign(b.close - s.price) AS s FROM settled s JOIN bars b ON b.symbol = s.symbol AND b.bar_no BETWEEN s.bar_no + 1 AND s.bar_no + 240 WHERE b.close <> s.price",
    "sided": "SELECT symbol, bar_no, arg_min(s, step) AS side FROM off GROUP BY 1, 2",
    "lives": "SELECT s.symbol, s.bar_no, s.price, d.side, min(o.step) FILTER (o.s <> d.side) AS filled_after FROM settled s LEFT JOIN sided d USING (symbol, bar_no) LEFT JOIN off o USING (symbol, bar_no) GROUP BY ALL",
}


@query("SELECT symbol, bar_no, price, CAST(side AS INT) AS side, filled_after FROM lives", **_LIFE)
def settlement_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = keyed_event_bars(spark, sf_dir)
    return levels.level_life(signals.settlements(b).withColumnRenamed("close", "price"), b).withColumn("side", F.col("side").cast("int"))


@query("""SELECT l.symbol, l.bar_no + l.filled_after AS bar_no, CAST(-side AS INT) AS direction, round(max(CASE WHEN side < 0 THEN b.high - price ELSE price - b.low END) FILTER (b.bar_no - l.bar_no - filled_after <= 5), 6) AS mfe_5,
           round(max(CASE WHEN side < 0 THEN b.high - price ELSE price - b.low END), 6) AS mfe_15, round(max(CASE WHEN side < 0 THEN price - b.low ELSE b.high - price END), 6) AS mae_15
    FROM lives l JOIN bars b ON b.symbol = l.symbol AND b.bar_no BETWEEN l.bar_no + filled_after + 1 AND l.bar_no + filled_after + 15 GROUP BY l.symbol, l.bar_no, filled_after, side""", **_LIFE)
def settlement_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = keyed_event_bars(spark, sf_dir)
    life = levels.level_life(signals.settlements(b).withColumnRenamed("close", "price"), b).where("filled_after is not null")
    fills = life.select("symbol", (F.col("bar_no") + F.col("filled_after")).alias("bar_no"), "price", (-F.col("side")).cast("int").alias("direction"))
    out = levels.momentum_after(fills, b, (5, 15))
    return out.select("symbol", "bar_no", "direction", *[F.round(c, 6).alias(c) for c in ("mfe_5", "mfe_15", "mae_15")])


# forward outcomes

_FWD = f"""SELECT *, CASE WHEN count(close) OVER n60 = 60 THEN max(high) OVER n60 - close END AS mfe_up, CASE WHEN count(close) OVER n60 = 60 THEN close - min(low) OVER n60 END AS mae_up,
           lead(close, 60) OVER ({W}) - close AS net FROM gaps WINDOW n60 AS ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)"""


@query("SELECT symbol, bar_no, round(mfe_up, 6) AS mfe_up, round(mae_up, 6) AS mae_up, round(net, 6) AS net FROM fwd", fwd=_FWD)
def forward_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.forward_excursion(keyed_event_bars(spark, sf_dir), 60).select("symbol", "bar_no", *[F.round(c, 6).alias(c) for c in ("mfe_up", "mae_up", "net")])


@query("""SELECT symbol, count(*) AS events, round(median(mfe_up), 6) AS mfe, round(median(mae_up), 6) AS mae, count(*) FILTER (mfe_up >= 2 * m) AS strong
    FROM (SELECT *, median(mae_up) OVER (PARTITION BY symbol) AS m FROM fwd WHERE bull AND mfe_up IS NOT NULL) GROUP BY 1""", fwd=_FWD)
def entry_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.excursion_summary(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), 60, "fvg_bull")


_GAPPED = f"SELECT g.*, a.atr FROM gaps g JOIN atrs a USING (symbol, bar_no)"
_SWEEP = {
    "gap_atr": _GAPPED,
    "events_": "SELECT symbol, bar_no, mult, close AS entry, close - atr * mult AS stop, close + 2 * atr * mult AS target FROM gap_atr, (SELECT unnest([1.0::DOUBLE, 1.5, 2.0, 3.0]) AS mult) WHERE bull AND atr IS NOT NULL",
    "hits": "SELECT e.*, b.bar_no - e.bar_no AS step, b.open AS o, b.low <= stop AS s, b.high >= target AS t, b.low AS lo, b.high AS hi FROM events_ e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 120",
    "exits": "SELECT symbol, bar_no, mult, min(step) AS exit_step, arg_min(CASE WHEN s THEN 'stop' ELSE 'target' END, step) AS outcome FROM hits WHERE s OR t GROUP BY 1, 2, 3",
}


@query("""SELECT symbol, mult, count(*) AS events, count(*) FILTER (outcome = 'target') AS wins, count(*) FILTER (outcome = 'stop') AS losses,
           round(count(*) FILTER (outcome = 'target') * 2.0 / nullif(count(*) FILTER (outcome = 'stop'), 0), 6) AS pf FROM events_ LEFT JOIN exits USING (symbol, bar_no, mult) GROUP BY 1, 2""", **_SWEEP)
def barrier_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stage(signals.atr(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "bars")
    events = outcomes.atr_barriers(b, "fvg_bull", [1.0, 1.5, 2.0, 3.0])
    return outcomes.barrier_sweep(outcomes.first_barrier(events, b, 120))


_TRADES = {
    "gap_atr": _GAPPED,
    "signals_": f"SELECT *, lead(open) OVER ({W}) AS o1, lead(bar_no) OVER ({W}) AS n1 FROM gap_atr",
    "entries_": "SELECT symbol, n1 AS bar_no, d AS direction, o1 AS entry, o1 - d * atr * 1.5 AS stop, o1 + d * (atr * 1.5) * 2 AS target FROM signals_, (SELECT unnest([1, -1]) AS d) WHERE bull AND n1 IS NOT NULL AND atr IS NOT NULL",
    "path": """SELECT e.symbol, e.bar_no, e.direction, entry, stop, target, b.bar_no - e.bar_no AS step, entry * direction AS e, stop * direction AS s, target * direction AS t, b.open * direction AS o,
        CASE WHEN direction > 0 THEN b.high ELSE -b.low END AS h, CASE WHEN direction > 0 THEN b.low ELSE -b.high END AS l
        FROM entries_ e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 200""",
    "best": "SELECT *, greatest(e, coalesce(max(h) OVER (PARTITION BY symbol, bar_no, direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e)) AS b FROM path",
    "moved": "SELECT *, greatest(s, CASE WHEN b - e >= 1.0 * (e - s) THEN e END, CASE WHEN b - e >= 40 THEN b - 30 END) AS x FROM best",
    "decided": "SELECT *, CASE WHEN l <= x AND h >= t THEN CASE WHEN abs(t - o) < abs(x - o) THEN 'target' ELSE 'stop' END WHEN l <= x THEN 'stop' WHEN h >= t THEN 'target' END AS hit FROM moved",
    "closed": "SELECT symbol, bar_no, direction, entry, min(step) AS exit_step, arg_min(hit, step) AS outcome, arg_min(CASE WHEN hit = 'target' THEN target ELSE x * direction END, step) AS exit_price FROM decided WHERE hit IS NOT NULL GROUP BY 1, 2, 3, 4",
}


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stage(signals.atr(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "bars")
    return outcomes.moving_stop_exit(outcomes.entries(b, "fvg_bull"), b, 200, trail=30.0, activation=40.0, break_even=1.0)


@query("SELECT e.symbol, e.bar_no, e.direction, coalesce(outcome, 'timeout') AS outcome, exit_step, round(exit_price, 6) AS exit_price FROM entries_ e LEFT JOIN closed USING (symbol, bar_no, direction)", **_TRADES)
def moving_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir).select("symbol", "bar_no", "direction", "outcome", "exit_step", F.round("exit_price", 6).alias("exit_price"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _closed(spark, sf_dir).where("exit_step is not null").withColumnRenamed("bar_no", "entry_no").withColumn("exit_no", F.col("entry_no") + F.col("exit_step"))
    return outcomes.trade_points(outcomes.without_overlap(done, "direction"))


_KEPT = _TRADES | {
    "ordered": "SELECT *, bar_no AS entry_no, bar_no + exit_step AS exit_no, row_number() OVER (PARTITION BY symbol, direction ORDER BY bar_no) AS k FROM closed",
    "kept": """SELECT symbol, direction, k, entry_no, exit_no, entry, exit_price FROM (
        SELECT o.*, list_contains(f.ks, o.k) AS keep FROM ordered o JOIN (
            SELECT symbol, direction, list_reduce(list_prepend({'till': -1::BIGINT, 'ks': []::BIGINT[]}, list({'till': exit_no, 'ks': [k, entry_no]} ORDER BY k)),
                   lambda s, x: CASE WHEN x.ks[2] > s.till THEN {'till': x.till, 'ks': list_append(s.ks, x.ks[1])} ELSE s END).ks AS ks FROM ordered GROUP BY 1, 2) f USING (symbol, direction)) WHERE keep""",
    "pnls": "SELECT *, (exit_price - entry) * direction - 1.35 AS pnl FROM kept",
}


@query("""SELECT symbol, direction, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 3) AS pf, sum(greatest(-pnl, 0)) = 0 AS no_loss,
           round(avg((pnl > 0)::INT), 6) AS win_rate, round(sum(pnl), 6) AS total, round(coalesce(CASE WHEN count(*) > 1 AND stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) END, 0), 6) AS sharpe
    FROM pnls GROUP BY 1, 2""", **_KEPT)
def trade_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.performance(_trades(spark, sf_dir), "symbol", "direction")


@query("""SELECT symbol, direction, round(max(peak - run), 6) AS max_drawdown FROM (SELECT *, greatest(0, max(run) OVER (PARTITION BY symbol, direction ORDER BY entry_no ROWS UNBOUNDED PRECEDING)) AS peak FROM (
        SELECT *, sum(pnl) OVER (PARTITION BY symbol, direction ORDER BY entry_no ROWS UNBOUNDED PRECEDING) AS run FROM pnls)) GROUP BY 1, 2""", **_KEPT)
def trade_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.max_drawdown(_trades(spark, sf_dir), "symbol", "direction")


#: Entries two bars after a gap of the London hours, stops five points beyond the zone, else 25 points; levels of the day before as targets, the low and high of the last bars as stops.
_LEVELLED = {
    "fills": _FILLS, "gap_state": _GAP_STATE,
    "signals_": f"SELECT *, last_value(open) OVER x AS o2, last_value(bar_no) OVER x AS n2 FROM gap_state WINDOW x AS ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)",
    "entries_": """SELECT symbol, n2 AS bar_no, d AS direction, o2 AS entry, stop, o2 + d * abs(o2 - stop) * 2 AS target FROM (SELECT *, CASE WHEN b_lo IS NULL THEN o2 - d * 25 WHEN d > 0 THEN b_lo - 5 ELSE b_hi + 5 END AS stop
        FROM signals_, (SELECT unnest([1, -1]) AS d) WHERE bull AND date_part('hour', ts) >= 7 AND date_part('hour', ts) < 16)""",
    "levelled": f"SELECT *, min(low) OVER ({W} ROWS 4 PRECEDING) AS floor_, max(high) OVER ({W} ROWS 4 PRECEDING) AS ceiling_, CASE WHEN bar_no % 3 = 0 THEN high + 10 END AS aim_up, CASE WHEN bar_no % 3 = 0 THEN low - 10 END AS aim_down FROM bars",
    "path": """SELECT e.*, b.bar_no - e.bar_no AS step, entry * direction AS e, e.stop * direction AS s, target * direction AS t, b.open * direction AS o, CASE WHEN direction > 0 THEN b.high ELSE -b.low END AS h,
        CASE WHEN direction > 0 THEN b.low ELSE -b.high END AS l, CASE WHEN direction > 0 THEN floor_ ELSE ceiling_ END * direction AS level, CASE WHEN direction > 0 THEN aim_up ELSE aim_down END * direction AS aim
        FROM entries_ e JOIN levelled b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 60""",
    "moved": """SELECT *, greatest(s, max(level) OVER q) AS x, coalesce(last_value(aim IGNORE NULLS) OVER q, t) AS y FROM path WINDOW q AS (PARTITION BY symbol, bar_no, direction, entry, stop, target ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "decided": "SELECT *, CASE WHEN l <= x AND h >= y THEN CASE WHEN abs(y - o) < abs(x - o) THEN 'target' ELSE 'stop' END WHEN l <= x THEN 'stop' WHEN h >= y THEN 'target' END AS hit FROM moved",
    "closed": "SELECT symbol, bar_no, direction, entry, stop, target, min(step) AS exit_step, arg_min(hit, step) AS outcome, arg_min(CASE WHEN hit = 'target' THEN y ELSE x END * direction, step) AS exit_price FROM decided WHERE hit IS NOT NULL GROUP BY ALL",
}


@query("""SELECT e.symbol, e.bar_no, e.direction, round(e.stop, 6) AS stop, coalesce(outcome, 'timeout') AS outcome, exit_step, round(exit_price, 6) AS exit_price FROM (SELECT DISTINCT * FROM entries_) e LEFT JOIN closed USING (symbol, bar_no, direction, entry, stop, target)""", **_LEVELLED)
def moving_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by session and zone, exits at levels that move."""
    b = stage(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), "bars")

    def levels(x: DataFrame) -> DataFrame:
        return x.withColumn("floor_", F.min("low").over(last(5))).withColumn("ceiling_", F.max("high").over(last(5)))

    third = F.col("bar_no") % 3 == 0
    levelled = stage(windowed(b, levels, back=5).withColumn("aim_up", F.when(third, F.col("high") + 10)).withColumn("aim_down", F.when(third, F.col("low") - 10)), "levelled")
    hour = F.hour("ts")
    e = outcomes.entries(b, "fvg_bull", 2, points=25.0, zone=("fvg_bull_high", "fvg_bull_low"), session=(hour >= 7) & (hour < 16), clamp=True).distinct()
    out = outcomes.moving_stop_exit(e, levelled, 60, stops=("floor_", "ceiling_"), targets=("aim_up", "aim_down"))
    return out.select("symbol", "bar_no", "direction", F.round("stop", 6).alias("stop"), "outcome", "exit_step", F.round("exit_price", 6).alias("exit_price"))


_SINGLE = _TRADES | {
    "arrived": "SELECT symbol, bar_no AS entry_no, arg_max(direction, -direction) AS direction, arg_max(exit_price, -direction) AS exit_price, arg_max(entry, -direction) AS entry, arg_max(bar_no + exit_step, -direction) AS exit_no FROM closed GROUP BY 1, 2",
    "single": """SELECT a.* FROM arrived a JOIN (SELECT symbol, unnest(list_reduce(list_prepend({'till': -1::BIGINT, 'at': []::BIGINT[]}, list({'till': exit_no, 'at': [entry_no]} ORDER BY entry_no)),
        lambda s, x: CASE WHEN x.at[1] > s.till THEN {'till': x.till, 'at': list_append(s.at, x.at[1])} ELSE s END).at) AS entry_no FROM arrived GROUP BY 1) USING (symbol, entry_no)""",
}


@query("SELECT symbol, entry_no, exit_no, direction, round((exit_price - entry) * direction - 1.35, 6) AS pnl FROM single", **_SINGLE)
def trades_one_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per symbol: of a long and a short signal for the same bar the short one arrives last and counts."""
    done = _closed(spark, sf_dir).where("exit_step is not null").withColumnRenamed("bar_no", "entry_no").withColumn("exit_no", F.col("entry_no") + F.col("exit_step"))
    kept = outcomes.trade_points(outcomes.without_overlap(done.withColumn("arrival", -F.col("direction")), arrival="arrival"))
    return kept.select("symbol", "entry_no", "exit_no", "direction", F.round("pnl", 6).alias("pnl"))


@query("""SELECT symbol, h AS horizon, m AS multiple, count(*) AS signals, count(*) FILTER (move >= m) AS hits FROM (
        SELECT e.symbol, e.bar_no, h, m, max(greatest(b.high - e.close, e.close - b.low) / e.atr) AS move FROM gap_atr e JOIN bars b ON b.symbol = e.symbol AND b.bar_no > e.bar_no AND b.bar_no <= e.bar_no + 15,
             (SELECT unnest([3, 5, 10, 15]) AS h), (SELECT unnest([1.0::DOUBLE, 2.0]) AS m) WHERE bull AND atr IS NOT NULL AND b.bar_no - e.bar_no <= h GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", gap_atr=_GAPPED)
def signal_predictivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stage(signals.atr(signals.fair_value_gap(keyed_event_bars(spark, sf_dir))), "bars")
    return outcomes.predictivity(b, "fvg_bull")


# chains

def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(signals.states(keyed_event_bars(spark, sf_dir)), "states")


_CHAINED = f"""SELECT symbol, bar_no, state, unnest([1, 2, 3]) AS length, unnest([lag(state) OVER w, lag(state, 2) OVER w || '→' || lag(state) OVER w, lag(state, 3) OVER w || '→' || lag(state, 2) OVER w || '→' || lag(state) OVER w]) AS chain
    FROM states WINDOW w AS ({W})"""
_LIFTS = """SELECT symbol, length, chain, bars, events, round((events / n) / (bars / b), 6) AS lift FROM (
        SELECT *, sum(bars) OVER (PARTITION BY symbol, length) AS b, nullif(sum(events) OVER (PARTITION BY symbol, length), 0) AS n FROM (
            SELECT symbol, length, chain, count(*) AS bars, count(*) FILTER (state IN ('DU', 'DD')) AS events FROM chained WHERE chain IS NOT NULL GROUP BY 1, 2, 3)) WHERE bars >= 10"""


def _moved() -> Column:
    return F.col("state").isin("DU", "DD")


@query("SELECT * FROM lifts", chained=_CHAINED, lifts=_LIFTS)
def chain_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.chain_lift(_states(spark, sf_dir), _moved())


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, length ORDER BY events DESC, chain) AS rank FROM lifts) WHERE rank <= 5", chained=_CHAINED, lifts=_LIFTS)
def top_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.top_chains(chains.chain_lift(_states(spark, sf_dir), _moved()), 5)


_MATRIX = f"""SELECT symbol, prev, state AS cur, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol, prev), 6) AS share
    FROM (SELECT symbol, state, lag(state) OVER ({W}) AS prev FROM states) WHERE prev IS NOT NULL GROUP BY 1, 2, 3"""


@query("SELECT * FROM matrix", matrix=_MATRIX)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.transitions(_states(spark, sf_dir))


@query("""SELECT symbol, rank, path, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p DESC, path) AS rank FROM (
        SELECT l.symbol, a.cur || '→' || b.cur || '→' || c.cur AS path, a.share * b.share * c.share AS p FROM (SELECT symbol, arg_max(state, bar_no) AS state FROM states GROUP BY 1) l
        JOIN matrix a ON a.symbol = l.symbol AND a.prev = l.state JOIN matrix b ON b.symbol = l.symbol AND b.prev = a.cur JOIN matrix c ON c.symbol = l.symbol AND c.prev = b.cur)) WHERE rank <= 3""", matrix=_MATRIX)
def next_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    latest = s.groupBy("symbol").agg(F.max_by("state", "bar_no").alias("state"))
    return chains.next_paths(stage(chains.transitions(s), "matrix"), latest)


@query("""SELECT symbol, CASE WHEN lift >= 3 THEN 'A' WHEN lift >= 2 THEN 'B' WHEN lift >= 1 THEN 'C' ELSE 'D' END AS grade, count(*) AS bars FROM (
        SELECT s.symbol, s.bar_no, arg_max(l.lift, c.length) FILTER (l.lift IS NOT NULL) AS lift FROM states s LEFT JOIN chained c USING (symbol, bar_no) LEFT JOIN lifts l ON l.symbol = s.symbol AND l.length = c.length AND l.chain = c.chain GROUP BY 1, 2) GROUP BY 1, 2""", chained=_CHAINED, lifts=_LIFTS)
def chain_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    return chains.grade(s, stage(chains.chain_lift(s, _moved()), "lifts")).groupBy("symbol", "grade").agg(F.count("*").alias("bars"))


@query(f"""SELECT symbol, fold, f AS filter, count(*) AS bars, count(*) FILTER (e) AS events, count(*) FILTER (c) AS hits, count(*) FILTER (c AND e) AS both,
           CASE WHEN count(*) FILTER (c) >= 5 THEN round((count(*) FILTER (c AND e) / count(*) FILTER (c)) / nullif(count(*) FILTER (e) / count(*), 0), 6) END AS lift FROM (
        SELECT symbol, CASE WHEN bar_no / n < 0.7 THEN 'train' WHEN bar_no / n < 0.9 THEN 'valid' ELSE 'blind' END AS fold, unnest(['none'] || CASE WHEN close > open THEN ['rising'] ELSE [] END) AS f,
               state IN ('DU', 'DD') AS e, coalesce(lag(state) OVER ({W}) = 'C', false) AS c FROM (SELECT *, max(bar_no) OVER (PARTITION BY symbol) + 1 AS n FROM states)) GROUP BY 1, 2, 3""")
def chain_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.split_lift(_states(spark, sf_dir), "C", {"rising": F.col("close") > F.col("open")}, _moved())


@query("""SELECT symbol, component, count(*) AS events, round(avg((m >= 1)::INT), 6) AS win_1, round(avg((m >= 2)::INT), 6) AS win_2 FROM (
        SELECT s.symbol, s.bar_no, component, max(greatest(b.high - s.close, s.close - b.low) / s.atr) AS m
        FROM (SELECT *, unnest(CASE WHEN state = 'C' THEN ['compression'] WHEN state IN ('SU', 'SD') THEN ['sweep'] WHEN state IN ('BU', 'BD') THEN ['break'] ELSE [] END) AS component FROM states WHERE atr IS NOT NULL) s
        JOIN bars b ON b.symbol = s.symbol AND b.bar_no BETWEEN s.bar_no + 1 AND s.bar_no + 15 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def chain_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stage(signals.atr(_states(spark, sf_dir)), "bars")
    return chains.component_test(s, {"compression": F.col("state") == "C", "sweep": F.col("state").isin("SU", "SD"), "break": F.col("state").isin("BU", "BD")})


@query(f"""SELECT a.symbol, l AS lag, count(a.r + b.r) AS n, round(corr(a.r, b.r), 6) AS corr FROM
        (SELECT symbol, bar_no, close / lag(close) OVER ({W}) - 1 AS r, unnest(range(-3, 4)) AS l FROM bars) a JOIN (SELECT symbol, bar_no, close / lag(close) OVER ({W}) - 1 AS r FROM bars) b ON b.symbol = a.symbol AND b.bar_no = a.bar_no + a.l GROUP BY 1, 2""")
def lead_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = keyed_event_bars(spark, sf_dir)
    return chains.lead_lag(b, b, 3)


# time, phases, regimes

@query("""SELECT symbol, col AS column, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
           round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT symbol, unnest(['atr', 'atr_before']) AS col, unnest([atr, atr_before]) AS v FROM atrs) GROUP BY 1, 2""")
def range_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signals.atr(signals.atr(keyed_event_bars(spark, sf_dir)), out="atr_before", shifted=True)
    return regimes.describe(b, ["atr", "atr_before"])


@query("""SELECT symbol, flag, printf('%02d:00', hour(ny)) AS "window", count(*) AS n, round(count(*) / any_value(days), 6) AS per_day FROM (
        SELECT *, unnest(CASE WHEN bull THEN ['fvg_bull'] ELSE [] END || CASE WHEN bear THEN ['fvg_bear'] ELSE [] END) AS flag FROM (SELECT g.*, d.days FROM gaps g JOIN (SELECT symbol, count(DISTINCT CAST(ny AS DATE)) AS days FROM bars GROUP BY 1) d USING (symbol))) GROUP BY 1, 2, 3""")
def signal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.count_by_window(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), ["fvg_bull", "fvg_bear"])


@query(f"""SELECT symbol, printf('%02d:00', hour(ny)) AS "window", {", ".join(f"count(*) FILTER ((dayofweek(ny) + 6) % 7 = {d}) AS d{d}" for d in range(7))} FROM gaps WHERE bull GROUP BY 1, 2""")
def signal_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.heat_map(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), "fvg_bull")


@query("""SELECT 'fvg_bull' AS flag, count(*) FILTER (bull) AS fires, round(count(*) FILTER (bull) / count(*), 6) AS rate, count(*) FILTER (bull) = 0 AS dead FROM gaps
    UNION ALL SELECT 'fvg_bear', count(*) FILTER (bear), round(count(*) FILTER (bear) / count(*), 6), count(*) FILTER (bear) = 0 FROM gaps""")
def signal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.fire_rates(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), ["fvg_bull", "fvg_bear"])


_PREMIUM = f"SELECT *, close > (max(high) OVER x + min(low) OVER x) / 2 AS premium FROM bars WINDOW x AS ({W} ROWS 19 PRECEDING)"
_RUNS = f"SELECT *, CASE WHEN premium THEN sum((premium AND NOT coalesce(p, false))::INT) OVER ({W}) END AS run FROM (SELECT *, lag(premium) OVER ({W}) AS p FROM prem)"


@query("""SELECT symbol, CAST(hour(ny) AS INT) AS hour, count(*) AS runs, CAST(sum(bars) AS BIGINT) AS bars, count(*) FILTER (net > 0) AS up, round(avg(net), 6) AS mean_net FROM (
        SELECT symbol, run, min(ny) AS ny, count(*) AS bars, arg_max(close, bar_no) - arg_min(open, bar_no) AS net FROM runs WHERE run IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2""", prem=_PREMIUM, runs=_RUNS)
def run_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.run_profile(stage(signals.dealing_range(keyed_event_bars(spark, sf_dir)), "bars"), "premium")


@query(f"""SELECT symbol, CASE WHEN run IS NOT NULL THEN 'during' WHEN max(s::INT) OVER (o ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 1 THEN 'before' WHEN max(e::INT) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 THEN 'after' ELSE 'neutral' END AS phase, high, low, open, close
    FROM (SELECT *, run IS NOT NULL AND lag(run) OVER ({W}) IS DISTINCT FROM run AS s, run IS NOT NULL AND lead(run) OVER ({W}) IS DISTINCT FROM run AS e FROM runs) WINDOW o AS ({W})""".join(
    ["SELECT symbol, phase, count(*) AS bars, round(avg(high - low), 6) AS mean_range, count(*) FILTER (close > open) AS up, count(*) FILTER (close < open) AS down FROM (", ") GROUP BY 1, 2"]), prem=_PREMIUM, runs=_RUNS)
def phase_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.phase_summary(stage(signals.dealing_range(keyed_event_bars(spark, sf_dir)), "bars"), "premium", 5)


@query(f"""SELECT symbol, regime, h AS horizon, count(*) AS changes, round(median(net), 6) AS net, round(median(ker), 6) AS ker FROM (
        SELECT symbol, regime, unnest([15, 30]) AS h, unnest([n15, n30]) AS net, unnest([abs(n15) / nullif(k15, 0), abs(n30) / nullif(k30, 0)]) AS ker FROM (
            SELECT symbol, premium::INT AS regime, lag(premium) OVER ({W}) <> premium AS change, lead(close, 15) OVER ({W}) - close AS n15, lead(close, 30) OVER ({W}) - close AS n30,
                   sum(d) OVER ({W} ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS k15, sum(d) OVER ({W} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS k30 FROM (SELECT *, abs(lead(close) OVER ({W}) - close) AS d FROM prem)) WHERE change) WHERE net IS NOT NULL GROUP BY 1, 2, 3""", prem=_PREMIUM)
def forward_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = signals.dealing_range(keyed_event_bars(spark, sf_dir)).withColumn("regime", F.col("premium").cast("int"))
    return regimes.forward_regimes(b, "regime", (15, 30))


@query("""SELECT symbol, flagged, count(*) AS days, round(avg(move), 6) AS mean, round(stddev_pop(move), 6) AS std, count(*) FILTER (move < 0) AS down, count(*) FILTER (move > 0) AS up FROM (
        SELECT symbol, max(bull::INT) AS flagged, arg_max(close, bar_no) FILTER (hour(ny) >= 9 AND hour(ny) < 16) - arg_min(close, bar_no) FILTER (hour(ny) >= 9 AND hour(ny) < 16) AS move FROM gaps GROUP BY symbol, CAST(ny AS DATE)) WHERE move IS NOT NULL GROUP BY 1, 2""")
def day_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.day_bias(signals.fair_value_gap(keyed_event_bars(spark, sf_dir)), "fvg_bull")


@query("""SELECT symbol, premium, hour, count(*) AS events, round(sum(mfe_up), 4) AS mfe, round(sum(mae_up), 4) AS mae FROM (
        SELECT f.symbol, p.premium::INT AS premium, CAST(hour(f.ny) AS INT) AS hour, mfe_up, mae_up FROM fwd f JOIN prem p USING (symbol, bar_no) WHERE mfe_up IS NOT NULL) GROUP BY CUBE (symbol, premium, hour)""", fwd=_FWD, prem=_PREMIUM)
def entry_quality_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = outcomes.forward_excursion(signals.dealing_range(keyed_event_bars(spark, sf_dir)), 60).where("mfe_up is not null")
    b = b.select("symbol", F.col("premium").cast("int").alias("premium"), F.hour(local("ts")).alias("hour"), "mfe_up", "mae_up")
    return regimes.cube_quality(b, ["symbol", "premium", "hour"])
