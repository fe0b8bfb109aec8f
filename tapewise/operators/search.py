"""Parameter search over rolling windows: a seeded design, evaluated as one job for all windows, the best of each looked up out of sample."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import drawn
from ..sources.store import stage
from .frames import by_chunk, windowed
from .outcomes import max_drawdown, moving_stop_exit, performance, trade_points, without_overlap
from .registry import best_config

#: Most configurations that are paired with every signal.
MOST_CONFIGS = 10_000


class Real(NamedTuple):
    """Numbers from ``low`` to ``high``, to six decimals."""

    low: float
    high: float


class Whole(NamedTuple):
    """Whole numbers from ``low`` to ``high``, both included."""

    low: int
    high: int


class Choice(NamedTuple):
    values: tuple[str, ...]


#: The axes of the search for trades whose stop goes to the entry and then trails. Where a regime filter is on, tp_mult ends at 4.
SPACE: dict[str, Real | Whole | Choice] = {
    "atr_mult": Real(1.0, 2.0), "tp_mult": Real(1.5, 5.0), "entry_offset": Whole(0, 5), "breakeven_rr": Real(0.8, 1.5), "trail_activation": Real(5.0, 25.0), "trail_distance": Real(5.0, 20.0),
}
REGIME_TP = Real(1.5, 4.0)


def design(spark: SparkSession, n: int, space: Mapping[str, Real | Whole | Choice] = SPACE, seed: int = 1) -> DataFrame:
    """``n`` configurations (config_id from 0 and the axes), each axis drawn from seed, config_id and its place among the axes: more of them extend the same design."""
    if n > MOST_CONFIGS:
        raise ValueError(f"at most {MOST_CONFIGS} configurations")
    out = spark.range(n).withColumnRenamed("id", "config_id")
    for at, (name, axis) in enumerate(space.items()):
        u = drawn(seed, "config_id", at) / 4294967296.0
        if isinstance(axis, Real):
            value: Column = F.round(axis.low + (axis.high - axis.low) * u, 6)
        elif isinstance(axis, Whole):
            value = (axis.low + F.floor(u * (axis.high - axis.low + 1))).cast("int")
        else:
            value = F.element_at(F.array(*map(F.lit, axis.values)), (F.floor(u * len(axis.values)) + 1).cast("int"))
        out = out.withColumn(name, value)
    return out


def window_bounds(bars: DataFrame, n: int = 3, ratio: float = 0.75) -> DataFrame:
    """symbol, window, phase ('is' or 'oos'), first_no, last_no of the rolling windows (see ``registry.rolling_windows``)."""
    size = bars.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_n"))
    size = size.withColumn("_is", F.floor(F.col("_n") * ratio)).withColumn("_oos", F.floor(F.col("_n") * (1 - ratio) / n)).where("_is > 0 and _oos > 0")
    windows = size.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_from", F.col("window") * F.col("_oos")).where("_from + _is + _oos <= _n")
    phases = F.array(
        F.struct(F.lit("is").alias("phase"), F.col("_from").alias("first_no"), (F.col("_from") + F.col("_is") - 1).alias("last_no")),
        F.struct(F.lit("oos").alias("phase"), (F.col("_from") + F.col("_is")).alias("first_no"), (F.col("_from") + F.col("_is") + F.col("_oos") - 1).alias("last_no")),
    )
    return windows.select("symbol", "window", F.inline(phases))


def candidates(bars: DataFrame, signal: str, configs: DataFrame, direction: int = 1, atr: str = "atr", most_offset: int = 5) -> DataFrame:
    """Every signal with every configuration as a trade: entry entry_offset bars later (one at least, the last bar at most) at the open, stop atr_mult ATRs of the signal's bar away, target tp_mult times as far."""
    ahead = by_chunk().rowsBetween(0, max(most_offset, 1))
    b = windowed(bars, lambda x: x.withColumn("_ahead", F.collect_list(F.struct("bar_no", "open")).over(ahead)), ahead=max(most_offset, 1))
    e = b.where(F.col(signal) & (F.col(atr) > 0)).select("symbol", F.col(atr).alias("_atr"), "_ahead").crossJoin(F.broadcast(configs))  # MOST_CONFIGS rows at most
    at = F.element_at("_ahead", F.least(F.greatest(F.col("entry_offset"), F.lit(1)) + 1, F.size("_ahead")).cast("int"))
    e = e.withColumn("_at", at).withColumn("_risk", F.col("_atr") * F.col("atr_mult")).withColumn("direction", F.lit(direction))
    return e.select(
        "symbol", F.col("_at.bar_no").alias("bar_no"), "direction", "config_id", "breakeven_rr", "trail_activation", "trail_distance", F.col("_at.open").alias("entry"),
        (F.col("_at.open") - direction * F.col("_risk")).alias("stop"), (F.col("_at.open") + direction * F.col("_risk") * F.col("tp_mult")).alias("target"),
    )


def closed(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """The trades of ``candidates`` with their exits (entry_no, exit_no, pnl, win); those that the horizon doesn't close are left out."""
    out = moving_stop_exit(events, bars, horizon, trail="trail_distance", activation="trail_activation", break_even="breakeven_rr", after_break_even=True).where("exit_step is not null")
    return trade_points(out.withColumnRenamed("bar_no", "entry_no").withColumn("exit_no", F.col("entry_no") + F.col("exit_step")))


def evaluated(trades: DataFrame, spans: DataFrame) -> DataFrame:
    """Per symbol, window, phase and configuration: performance and drawdown of the trades that begin and end within the phase, one at a time.

    ``spans``: symbol, window, phase, first_no, last_no; a trade that the phase's bars don't close doesn't count.
    """
    by = ["window", "phase", "config_id"]
    met = trades.join(spans, "symbol").where("entry_no >= first_no and exit_no <= last_no").drop("first_no", "last_no")
    kept = stage(without_overlap(met, *by), "kept")
    return performance(kept, "symbol", *by).join(max_drawdown(kept, "symbol", *by), ["symbol", *by])


def walked_forward(evaluation: DataFrame, configs: DataFrame) -> DataFrame:
    """Per symbol and window the configuration that is best in sample (objective; the smaller id in a tie), its values, and what it does out of sample; ``oos_so_far`` adds up the windows' results."""
    best = best_config(evaluation.where("phase = 'is'").drop("phase"), ["symbol", "window"])
    best = best.select("symbol", "window", "config_id", F.col("trades").alias("is_trades"), F.col("pf").alias("is_pf"), "objective")
    out = evaluation.where("phase = 'oos'").select("symbol", "window", "config_id", F.col("trades").alias("oos_trades"), F.col("pf").alias("oos_pf"), F.col("total").alias("oos_total"))
    both = best.join(out, ["symbol", "window", "config_id"], "left").join(F.broadcast(configs), "config_id")  # MOST_CONFIGS rows at most
    both = both.withColumn("oos_trades", F.coalesce("oos_trades", F.lit(0))).withColumn("oos_total", F.coalesce("oos_total", F.lit(0.0)))
    earlier = both.select("symbol", F.col("window").alias("_w"), F.col("oos_total").alias("_t"))
    so_far = both.select("symbol", "window").join(earlier, "symbol").where("_w <= window").groupBy("symbol", "window").agg(F.round(F.sum("_t"), 6).alias("oos_so_far"))  # windows are few
    return both.join(so_far, ["symbol", "window"])


def held_out(best: DataFrame, trades: DataFrame, first_no: int) -> DataFrame:
    """The configurations of ``best`` (symbol, config_id, avg_oos_pf) on the bars from ``first_no`` on, which no window has seen: holdout_trades and holdout_pf."""
    late = trades.where(F.col("entry_no") >= first_no).join(best.select("symbol", "config_id").distinct(), ["symbol", "config_id"])
    done = performance(without_overlap(late, "config_id"), "symbol", "config_id").select("symbol", "config_id", F.col("trades").alias("holdout_trades"), F.col("pf").alias("holdout_pf"))
    return best.join(done, ["symbol", "config_id"], "left").withColumn("holdout_trades", F.coalesce("holdout_trades", F.lit(0)))
