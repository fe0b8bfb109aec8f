"""Studies that combine signals, outcomes and clocks: trade enrichment, targets, components, sweeps, entropy, user signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import local, session_map
from ..sources.bars import keyed
from .frames import by_chunk, flag, last, recursion, windowed
from .joins import asof, forward_join
from .outcomes import POINT_VALUE, running_points
from .signals import efficiency_ratio


def enrich_trades(trades: DataFrame, bars: DataFrame, atr: str = "atr") -> DataFrame:
    """Trades (symbol, entry_no, direction, pnl, ...) with the entry bar's session, weekday, hour (UTC), ATR regime and pnl_usd.

    Regime: low, normal or high by the quartiles of the symbol's ATR.
    """
    limits = bars.groupBy("symbol").agg(F.percentile(atr, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    at = bars.select("symbol", F.col("bar_no").alias("entry_no"), "ts", F.col(atr).alias("_atr"))
    t = trades.join(at, ["symbol", "entry_no"]).join(limits, "symbol")
    regime = F.when(F.col("_atr") < F.col("_q")[0], "low").when(F.col("_atr") > F.col("_q")[1], "high").otherwise("normal")
    return (
        t.withColumn("session", session_map(F.col("ts"), "utc_trade")).withColumn("weekday", F.weekday("ts")).withColumn("hour", F.hour("ts"))
        .withColumn("regime", regime).withColumn("pnl_usd", F.col("pnl") * POINT_VALUE).drop("_atr", "_q")
    )


def trade_distribution(trades: DataFrame, *dims: str) -> DataFrame:
    """n, wins, points and USD of trades for each dimension and all of them together (rollup; null: all).

    The row of all trades is there without any trade too, as in SQL; a rollup alone gives none then.
    """
    sums = ("n", "wins", "points", "usd")
    cells = trades.groupBy(*dims).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("points"), F.sum("pnl_usd").alias("usd"))
    rolled = cells.rollup(*dims).agg(*[F.sum(c).alias(c) for c in sums], F.grouping_id().alias("_level")).where(F.col("_level") < (1 << len(dims)) - 1).drop("_level")
    out = rolled.unionByName(cells.agg(*[F.sum(c).alias(c) for c in sums]), allowMissingColumns=True)
    return out.select(*dims, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums[:2]], *[F.round(c, 4).alias(c) for c in sums[2:]])


def weekday_hours(trades: DataFrame) -> DataFrame:
    """Mean points per weekday, one column for each hour."""
    return trades.groupBy("weekday").pivot("hour", list(range(24))).agg(F.round(F.avg("pnl"), 2))


def cumulative(trades: DataFrame, *by: str) -> DataFrame:
    """Running total of points in the order of entry, per group."""
    return running_points(trades, *by)


def target_rates(bars: DataFrame, signal: str, targets: tuple[float, ...] = (5, 10, 20, 50), n: int = 200, direction: int = 1) -> DataFrame:
    """Signals per symbol and target that reach it before the loss of the same size; both in one bar counts as reached, neither as lost."""
    events = bars.where(F.col(signal)).select("symbol", "bar_no", "close")
    steps = forward_join(events, bars, n, ["high", "low"])
    gain, loss = F.col("high") - F.col("close"), F.col("close") - F.col("low")
    gain, loss = (gain, loss) if direction > 0 else (loss, gain)
    firsts = steps.groupBy("symbol", "bar_no").agg(
        *[F.min(F.when(gain >= t, F.col("step"))).alias(f"g{i}") for i, t in enumerate(targets)], *[F.min(F.when(loss >= t, F.col("step"))).alias(f"l{i}") for i, t in enumerate(targets)]
    )
    per = events.join(firsts, ["symbol", "bar_no"], "left")
    long = per.select("symbol", F.expr(f"stack({len(targets)}, {', '.join(f'double({t}), g{i}, l{i}' for i, t in enumerate(targets))}) AS (target, g, l)"))
    won = F.col("g").isNotNull() & (F.col("l").isNull() | (F.col("g") <= F.col("l")))
    return long.groupBy("symbol", "target").agg(F.count("*").alias("signals"), F.count_if(won).alias("wins"))


def interval_events(bars: DataFrame, every: int, stop: float = 10.0, target: float = 20.0) -> DataFrame:
    """A long event at each ``every``-th bar; distances scale with a tenth of the deviation of the symbol's close-to-close moves (0.1 at least)."""
    moves = windowed(bars, lambda b: b.withColumn("_d", F.col("close") - F.lag("close").over(by_chunk())), back=1)
    scale = moves.groupBy("symbol").agg(F.greatest(0.1 * F.stddev_samp("_d"), F.lit(0.1)).alias("_s"))
    e = bars.where(F.col("bar_no") % every == 0).join(scale, "symbol")
    return e.select("symbol", "bar_no", F.lit(1).alias("direction"), F.col("close").alias("entry"), (F.col("close") - stop * F.col("_s")).alias("stop"), (F.col("close") + target * F.col("_s")).alias("target"))


def regime_filter(bars: DataFrame, higher: DataFrame, seconds: int, n: int = 20, limit: float = 0.80) -> DataFrame:
    """lrl: the efficiency ratio of the last closed bar of the higher frame lies below ``limit``; null before the first."""
    score = efficiency_ratio(higher, n).select("symbol", (F.col("ts").cast("long") + seconds).cast("timestamp").alias("ts"), "ker")
    return asof(bars, score, ["ker"]).withColumn("lrl", F.col("ker") < limit)


def ema_trend(bars: DataFrame, n: int = 200, reach: int | None = None) -> DataFrame:
    """above_ema: the close lies above its exponential mean ``ema``, which begins with the first close; true where there is no mean.

    The mean is exact; ``reach``, once the bars after which weights were cut off, has no effect.
    """
    alpha = 2.0 / (n + 1)
    b = keyed(bars).withColumn("_x", F.when(F.col("bar_no") == 0, F.col("close")).otherwise(alpha * F.col("close")))
    return recursion(b, {"ema": "_x"}, 1 - alpha).drop("_x").withColumn("above_ema", F.coalesce(F.col("close") > F.col("ema"), F.lit(True)))


def age_decay(bars: DataFrame, prefix: str = "fvg") -> DataFrame:
    """Touches of active bull zones by age band (bars since birth): touches and total excursions; needs mfe_up, mae_up and zone_age."""
    touch = bars.where(F.col(f"{prefix}_bull_active") & ~F.col(f"{prefix}_bull") & (F.col("low") <= F.col(f"{prefix}_bull_high")) & F.col("mfe_up").isNotNull())
    age = F.col("zone_age")
    band = F.when(age <= 5, "1-5").when(age <= 20, "6-20").when(age <= 60, "21-60").otherwise("61+")
    return touch.groupBy("symbol", band.alias("age")).agg(F.count("*").alias("touches"), F.round(F.sum("mfe_up"), 4).alias("mfe"), F.round(F.sum("mae_up"), 4).alias("mae"))


def liquidity_sweeps(bars: DataFrame, least: float = 3.0) -> DataFrame:
    """First sweep per New York day and side: from 08:00 to 10:00 price passes the range of 00:00-08:00 by ``least`` and closes back inside.

    The close may come at the same bar or a later one of the window. (symbol, day, side, bar_no) of that close.
    """
    ny = local("ts")
    b = bars.withColumn("_h", F.hour(ny)).withColumn("day", F.to_date(ny))
    asia = b.where("_h < 8").groupBy("symbol", "day").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    w = b.where("_h >= 8 and _h < 10").join(asia, ["symbol", "day"])
    so_far = Window.partitionBy("symbol", "day").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("_up", F.max("high").over(so_far) >= F.col("_hi") + least).withColumn("_down", F.min("low").over(so_far) <= F.col("_lo") - least)
    inside = (F.col("close") < F.col("_hi")) & (F.col("close") > F.col("_lo"))
    long = w.where(inside).select("symbol", "day", "bar_no", F.explode(F.array_compact(F.array(F.when(F.col("_up"), "bear"), F.when(F.col("_down"), "bull")))).alias("side"))
    return long.groupBy("symbol", "day", "side").agg(F.min("bar_no").alias("bar_no"))


def gap_retraces(bars: DataFrame, gaps: DataFrame, first: int = 5, until: int = 720, reach: float = 0.6, rejection: float = 0.4, volume: float = 1.2, volume_n: int = 100) -> DataFrame:
    """First bar that rejects an opening gap, against whose direction a trade then goes: symbol, period, direction (of the gap), bar_no.

    From ``first`` to ``until`` bars after the open: the bar is in the gap, its extreme lies within ``reach`` of the gap's height from the gap's far
    side (top of a gap up, bottom of a gap down), its close has left that extreme by ``rejection`` of the range, and its volume is at least
    ``volume`` times the median of the ``volume_n`` bars before.
    """
    opens = bars.withColumn("period", F.date_trunc("day", "ts")).groupBy("symbol", "period").agg(F.min("bar_no").alias("bar_no"))
    g = gaps.join(opens, ["symbol", "period"]).select("symbol", "period", "direction", "gap_top", "gap_bottom", "bar_no")
    usual = windowed(bars, lambda b: b.withColumn("_usual", F.percentile("volume", F.lit(0.5)).over(last(volume_n, including=False))), back=volume_n)
    steps = forward_join(g, usual, until, ["high", "low", "close", "volume", "_usual"]).where(F.col("step") >= first)
    up, height = F.col("direction") > 0, F.col("gap_top") - F.col("gap_bottom")
    inside = (F.col("low") <= F.col("gap_top")) & (F.col("high") >= F.col("gap_bottom"))
    near = F.when(up, F.abs(F.col("high") - F.col("gap_top"))).otherwise(F.abs(F.col("low") - F.col("gap_bottom"))) <= reach * height
    left = F.when(up, F.col("high") - F.col("close")).otherwise(F.col("close") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    hit = steps.where(flag((height > 0) & inside & near & (left >= rejection) & (F.col("volume") >= volume * F.col("_usual"))))
    return hit.groupBy("symbol", "period", "direction").agg((F.min(F.col("bar_no") + F.col("step"))).alias("bar_no"))


def _entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """Sample entropy; None where it is undefined."""
    r = share * x.std()
    if len(x) <= m + 1 or r == 0:
        return None

    def pairs(k: int) -> int:
        v = np.lib.stride_tricks.sliding_window_view(x, k)[: len(x) - m]
        return int(((np.abs(v[:, None, :] - v[None, :, :]).max(axis=2) <= r).sum() - len(v)) // 2)

    a, b = pairs(m + 1), pairs(m)
    return float(-np.log(a / b)) if a and b else None


def _approximate(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """Approximate entropy, in which each stretch also matches itself; None without any variation."""
    r = share * x.std()
    if len(x) <= m + 1 or r == 0:
        return None

    def phi(k: int) -> float:
        v = np.lib.stride_tricks.sliding_window_view(x, k)
        return float(np.log((np.abs(v[:, None, :] - v[None, :, :]).max(axis=2) <= r).mean(axis=1)).mean())

    return phi(m) - phi(m + 1)


def _fluctuation(x: np.ndarray) -> float | None:
    """Exponent of detrended fluctuations with linear detrending."""
    y, sizes, out = np.cumsum(x - x.mean()), [4 * 2**k for k in range(24) if 4 * 2**k <= len(x) // 2], []
    for s in sizes:
        parts = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s)
        fit = np.polyfit(t, parts.T, 1)
        out.append(np.sqrt(((parts - (np.outer(fit[0], t) + fit[1][:, None])) ** 2).mean()))
    return float(np.polyfit(np.log(sizes), np.log(out), 1)[0]) if len(sizes) > 1 and min(out) > 0 else None


def segment_statistics(bars: DataFrame, size: int = 60) -> DataFrame:
    """Sample and approximate entropy and fluctuation exponent of the close-to-close moves of each full segment of ``size`` bars: one small group each."""
    moves = windowed(bars, lambda b: b.withColumn("move", F.col("close") - F.lag("close").over(by_chunk())), back=1)
    segments = moves.where("move is not null").withColumn("segment", F.expr(f"bar_no div {size}")).select("symbol", "segment", "bar_no", "move")

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("bar_no")["move"].to_numpy()
        return pd.DataFrame([(group["symbol"].iloc[0], int(group["segment"].iloc[0]), len(x), _entropy(x), _approximate(x), _fluctuation(x))], columns=["symbol", "segment", "n", "entropy", "approximate", "dfa"])

    return segments.groupBy("symbol", "segment").applyInPandas(measure, "symbol string, segment long, n long, entropy double, approximate double, dfa double").where(f"n >= {size - 1}")


def fluctuation_windows(bars: DataFrame, size: int = 1000, step: int | None = None) -> DataFrame:
    """(symbol, window, n, dfa): fluctuation exponent of the close-to-close moves of each window of ``size`` bars (usually 1000, 5000 or 20000), a third
    of it on from the one before unless ``step`` says otherwise. A window is one group of bounded size."""
    step = step or max(1, size // 3)
    moves = windowed(bars, lambda b: b.withColumn("move", F.col("close") - F.lag("close").over(by_chunk())), back=1).where("move is not null")
    first = F.expr(f"greatest(0L, (bar_no - {size}) div {step} + IF(bar_no >= {size}, 1, 0))")
    rows = moves.select("symbol", "bar_no", "move", F.explode(F.sequence(first, F.expr(f"bar_no div {step}"))).alias("window"))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("bar_no")["move"].to_numpy()
        return pd.DataFrame([(group["symbol"].iloc[0], int(group["window"].iloc[0]), len(x), _fluctuation(x))], columns=["symbol", "window", "n", "dfa"])

    return rows.groupBy("symbol", "window").applyInPandas(measure, "symbol string, window long, n long, dfa double").where(f"n >= {size - 1}")


@dataclass
class UserSignal:
    """A signal of a user's own: bars to bars with more columns, its parameters, and how far it looks back."""

    name: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)


USER_SIGNALS: dict[str, UserSignal] = {}


def register_signal(name: str, **params):
    """Decorator that puts a function (bars, **params) -> bars into USER_SIGNALS."""

    def put(f):
        USER_SIGNALS[name] = UserSignal(name, f, params)
        return f

    return put


def pandas_signal(bars: DataFrame, compute: Callable[[pd.DataFrame], pd.DataFrame], added: str, back: int) -> DataFrame:
    """Run a pandas function of one ordered series on chunks with ``back`` bars before them; ``added`` is the schema of its new columns."""
    bars = keyed(bars)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema), added])
    names = bars.columns

    def build(b: DataFrame) -> DataFrame:
        whole = ", ".join([schema, "_home bigint"])

        def one(group: pd.DataFrame) -> pd.DataFrame:
            g = group.sort_values("bar_no", ignore_index=True)
            new = compute(g[names])
            return pd.concat([g, new.drop(columns=[c for c in new.columns if c in g.columns])], axis=1)

        order = [*names, *[x.split()[0] for x in added.split(",")], "_home"]
        return b.groupBy("symbol", "chunk").applyInPandas(lambda g: one(g)[order], whole)

    return windowed(bars, build, back=back)


def audit(signal: UserSignal, bars: DataFrame) -> dict[str, bool]:
    """Contract of a signal: the same keys, no change of the past when later bars are cut off, and some flag that fires."""
    out = signal.run(bars, **signal.params)
    half = bars.groupBy("symbol").agg((F.max("bar_no") / 2).cast("long").alias("_half"))
    short = signal.run(bars.join(half, "symbol").where("bar_no <= _half").drop("_half"), **signal.params)
    new = [c for c in out.columns if c not in bars.columns]
    same_keys = out.count() == bars.count() and out.select("symbol", "bar_no").exceptAll(bars.select("symbol", "bar_no")).isEmpty()
    changed = short.select("symbol", "bar_no", *new).exceptAll(out.select("symbol", "bar_no", *new))
    flags = [f.name for f in out.schema if f.name in new and f.dataType.simpleString() == "boolean"]
    fires = bool(flags) and bool(out.agg(F.max(F.greatest(*[F.col(c).cast("int") for c in flags]) if len(flags) > 1 else F.col(flags[0]).cast("int"))).first()[0])
    return {"keys": same_keys, "causal": changed.isEmpty(), "fires": fires}


def idea_accounting(submitted: DataFrame, runs: DataFrame, text: str = "idea") -> DataFrame:
    """One row: distinct ideas submitted, those among them with a run, and the share that was lost."""
    key: Column = F.lower(F.trim(text))
    a, b = submitted.select(key.alias("k")).distinct(), runs.select(key.alias("k")).distinct().withColumn("_run", F.lit(1))
    out = a.join(b, "k", "left").agg(F.count("*").alias("submitted"), F.count("_run").alias("stored"))
    return out.withColumn("lost_share", F.round(1 - F.try_divide("stored", "submitted"), 6))
