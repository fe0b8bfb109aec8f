"""Forward outcomes of bars and events: excursions, barriers, moving stops, trades that don't overlap."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage
from .frames import by_chunk, flag, next_, windowed
from .joins import forward_join

#: Fixed values of the cost model, in points: half a point of slippage each way, and commission.
FRICTION = 2 * 0.5 + 0.70 / 2
POINT_VALUE = 2.0
#: Entry bars whose trades one task handles together.
TRADE_STRETCH = 50_000


def forward_excursion(bars: DataFrame, n: int, truncate: bool = False) -> DataFrame:
    """mfe_up, mae_up, net of the next ``n`` bars from the close (for the short side exchange the two); null without a full horizon."""

    def build(b: DataFrame) -> DataFrame:
        full = F.lit(True) if truncate else F.count("close").over(next_(n)) == n
        up, down = F.max("high").over(next_(n)) - F.col("close"), F.col("close") - F.min("low").over(next_(n))
        b = b.withColumn("mfe_up", F.when(full, up)).withColumn("mae_up", F.when(full, down))
        return b.withColumn("net", F.lead("close", n).over(by_chunk()) - F.col("close"))

    return windowed(bars, build, ahead=n)


def excursion_summary(bars: DataFrame, n: int, signal: str, direction: int = 1) -> DataFrame:
    """Per symbol, of the bars where ``signal`` holds: events, medians of MFE and MAE, and how many have MFE >= twice the median MAE."""
    b = forward_excursion(bars, n).where(F.col(signal) & F.col("mfe_up").isNotNull())
    mfe, mae = ("mfe_up", "mae_up") if direction > 0 else ("mae_up", "mfe_up")
    medians = b.groupBy("symbol").agg(F.count("*").alias("events"), F.median(mfe).alias("mfe"), F.median(mae).alias("mae"))
    good = b.join(medians.select("symbol", F.col("mae").alias("_m")), "symbol").groupBy("symbol").agg(F.count_if(F.col(mfe) >= 2 * F.col("_m")).alias("strong"))
    return medians.join(good, "symbol").select("symbol", "events", F.round("mfe", 6).alias("mfe"), F.round("mae", 6).alias("mae"), "strong")


def _counted(events: DataFrame) -> DataFrame:
    """Events that are equal in all columns, nulls included, as one row with their number."""
    return events.groupBy(*events.columns).agg(F.count("*").alias("_times"))


def _first_hits(events: DataFrame, steps: DataFrame, values: dict[str, str]) -> DataFrame:
    """The counted events with the first of their ``steps`` that has a ``_hit``: outcome, exit_step and ``values``; timeout without one."""
    names = [c for c in events.columns if c != "_times"]
    seen = steps.where("_hit is not null").select(*events.columns, "step", "_hit", *values.values())
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in seen.schema if f.name not in events.columns]
    every = seen.unionByName(events.select("*", *none))  # grouping takes nulls as equal, which a join on the columns would not
    out = every.groupBy(*events.columns).agg(
        F.coalesce(F.min_by("_hit", "step"), F.lit("timeout")).alias("outcome"), F.min("step").alias("exit_step"), *[F.min_by(c, "step").alias(o) for o, c in values.items()]
    )
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*names, "outcome", "exit_step", *values)


def first_barrier(events: DataFrame, bars: DataFrame, n: int, ties: str = "stop") -> DataFrame:
    """Events (symbol, bar_no, direction, entry, stop, target) with the first barrier that the next ``n`` bars reach.

    Adds exit_step and outcome: target, stop or timeout. Both in one bar: ``ties`` names the winner; 'open' is the one nearer to
    the bar's open, the stop if equal.
    """
    events = _counted(events)
    steps = forward_join(events, bars, n, ["open", "high", "low"])
    long = F.col("direction") > 0
    at_stop = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    at_target = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    nearer = F.abs(F.col("target") - F.col("open")) < F.abs(F.col("stop") - F.col("open"))
    both = {"stop": F.lit("stop"), "target": F.lit("target"), "open": F.when(nearer, "target").otherwise("stop")}[ties]
    hit = F.when(at_stop & at_target, both).when(at_stop, "stop").when(at_target, "target")
    return _first_hits(events, steps.withColumn("_hit", hit), {})


def atr_barriers(bars: DataFrame, signal: str, multiples: list[float], reward: float = 2.0, direction: int = 1, atr: str = "atr") -> DataFrame:
    """Events of a signal times stop multiples: symbol, bar_no, mult, direction, entry (close), stop, target."""
    e = bars.where(F.col(signal) & F.col(atr).isNotNull()).withColumn("mult", F.explode(F.array(*map(F.lit, multiples))))
    risk = F.col(atr) * F.col("mult")
    return e.select("symbol", "bar_no", "mult", F.lit(direction).alias("direction"), F.col("close").alias("entry"), (F.col("close") - direction * risk).alias("stop"), (F.col("close") + direction * reward * risk).alias("target"))


def barrier_sweep(exits: DataFrame, reward: float = 2.0) -> DataFrame:
    """Per symbol and multiple: events, wins, losses and profit factor of ``first_barrier``'s outcomes."""
    out = exits.groupBy("symbol", "mult").agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "target").alias("wins"), F.count_if(F.col("outcome") == "stop").alias("losses"))
    return out.withColumn("pf", F.round(F.try_divide(F.col("wins") * reward, "losses"), 6))


def entries(
    bars: DataFrame, signal: str, offset: int = 1, atr: str = "atr", stop_mult: float = 1.5, target_mult: float = 2.0, direction: int = 0, points: float | None = None,
    zone: tuple[str, str] | None = None, buffer: float = 5.0, session: Column | None = None, clamp: bool = False, atr_at: str = "signal",
) -> DataFrame:
    """Trades to be opened ``offset`` bars after a signal (one at least), at the open, in one ``direction`` or, for 0, in both.

    symbol, bar_no (of the entry), direction, entry, stop, target. The stop lies ``stop_mult`` ATRs away, or ``points``, or ``buffer`` points beyond the bounds of a
    ``zone`` (columns of its high and low at the signal; without a zone there the other rule holds); the target lies ``target_mult`` times as far. ``session``
    keeps signals where it holds. Signals without that many later bars are dropped, or with ``clamp`` enter at the last bar. ``atr_at`` 'entry' takes the ATR of the entry bar, as the
    original does, though it isn't known at its open; without an ATR above 0 there is no trade.
    """
    offset = max(offset, 1)

    def build(b: DataFrame) -> DataFrame:
        ahead = by_chunk().rowsBetween(0, offset)
        at = (lambda c: F.last(c).over(ahead)) if clamp else (lambda c: F.lead(c, offset).over(by_chunk()))
        return b.withColumns({"_open": at("open"), "_no": at("bar_no"), **({"_atr": at(atr) if atr_at == "entry" else F.col(atr)} if points is None else {})})

    e = windowed(bars, build, ahead=offset).where(F.col(signal) & F.col("_no").isNotNull())
    if session is not None:
        e = e.where(session)
    if points is None:
        e = e.where("_atr > 0")
    e = e.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))) if direction == 0 else F.lit(direction))
    risk, d = F.lit(points) if points is not None else F.col("_atr") * stop_mult, F.col("direction")
    e = e.withColumn("_stop", F.col("_open") - d * risk)
    if zone:
        high, low = zone
        bound = F.when(d > 0, F.col(low) - buffer).otherwise(F.col(high) + buffer)
        e = e.withColumn("_stop", F.when(F.col(high).isNotNull() & F.col(low).isNotNull(), bound).otherwise(F.col("_stop")))
        risk = F.abs(F.col("_open") - F.col("_stop"))
    return e.select("symbol", F.col("_no").alias("bar_no"), "direction", F.col("_open").alias("entry"), F.col("_stop").alias("stop"), (F.col("_open") + d * risk * target_mult).alias("target"))


def moving_stop_exit(
    events: DataFrame, bars: DataFrame, n: int, trail: float | str | None = None, activation: float | str = 0.0, break_even: float | str | None = None, after_break_even: bool = False,
    stops: tuple[str, str] | None = None, targets: tuple[str, str] | None = None,
) -> DataFrame:
    """First exit when stop and target move: exit_step, exit_price and outcome.

    The stop at a bar comes from the bars before it: the initial stop, the entry once the best price is ``break_even`` initial
    risks away, ``trail`` points behind the best price once that is ``activation`` points away (with ``after_break_even`` only once the stop is at the entry), and the levels of ``stops``, columns
    for long and short trades. Whichever is tightest counts; it never loosens. Each of the three may be the name of a column of the events. The target is the last level of ``targets`` before the bar, either way, else the initial one.
    Levels count from the bar after the entry on; null ones and 0 are none. Both barriers in one bar: the one nearer to the open, the stop if equal. No exit within ``n`` bars: timeout.
    """
    events = _counted(events)
    columns = [*(stops or ()), *(targets or ())]
    steps = forward_join(events, bars, n, list(dict.fromkeys(["open", "high", "low", *columns])))
    d = F.col("direction")
    # one coordinate for both directions
    steps = (
        steps.withColumn("_e", F.col("entry") * d).withColumn("_s", F.col("stop") * d).withColumn("_t", F.col("target") * d).withColumn("_o", F.col("open") * d)
        .withColumn("_h", F.when(d > 0, F.col("high")).otherwise(-F.col("low"))).withColumn("_l", F.when(d > 0, F.col("low")).otherwise(-F.col("high")))
    )
    path = Window.partitionBy(*events.columns).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    for name, pair in (("_level", stops), ("_aim", targets)):
        if pair:
            level = F.when(d > 0, F.col(pair[0])).otherwise(F.col(pair[1])).cast("double")
            steps = steps.withColumn(name, F.when((level != 0) & ~F.isnan(level), level * d))
    best = F.greatest(F.col("_e"), F.max("_h").over(path))
    steps = steps.withColumn("_best", F.coalesce(best, F.col("_e")))
    gain, risk = F.col("_best") - F.col("_e"), F.abs(F.col("_e") - F.col("_s"))
    given = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    even = gain >= given(break_even) * risk if break_even is not None else F.lit(False)
    levels: list[Column] = [F.col("_s")]
    if break_even is not None:
        levels.append(F.when(even, F.col("_e")))
    if trail is not None:
        levels.append(F.when((gain >= given(activation)) & (even if after_break_even else F.lit(True)), F.col("_best") - given(trail)))
    if stops:
        levels.append(F.max("_level").over(path))
    steps = steps.withColumn("_stop", F.greatest(*levels) if len(levels) > 1 else levels[0])
    if targets:
        steps = steps.withColumn("_t", F.coalesce(F.last("_aim", ignorenulls=True).over(path), F.col("_t")))
    at_stop, at_target = F.col("_l") <= F.col("_stop"), F.col("_h") >= F.col("_t")
    nearer = F.abs(F.col("_t") - F.col("_o")) < F.abs(F.col("_stop") - F.col("_o"))
    hit = F.when(flag(at_stop) & flag(at_target), F.when(nearer, "target").otherwise("stop")).when(flag(at_stop), "stop").when(flag(at_target), "target")
    price = F.when(hit == "target", F.col("_t") * d).otherwise(F.col("_stop") * d)
    return _first_hits(events, steps.withColumn("_hit", hit).withColumn("_p", price), {"exit_price": "_p"})


def _carried_over(trades: DataFrame, key: list[str], order: str, values: dict[str, tuple[Column, Callable[[Column], Column]]], including: bool) -> DataFrame:
    """Adds, for each {name: (value, aggregate)}, the aggregate over all trades of the group before the current one (or with it).

    Within stretches of TRADE_STRETCH in ``order``, and over what the stretches before leave behind, so no task handles a whole group.
    """
    t = trades.withColumn("_stretch", F.floor(F.col(order) / TRADE_STRETCH))
    for name, (value, _) in values.items():
        t = t.withColumn(f"_v_{name}", value)
    before = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    left = t.groupBy(*key, "_stretch").agg(*[f(F.col(f"_v_{name}")).alias(f"_b_{name}") for name, (_, f) in values.items()])
    left = left.select(*key, "_stretch", *[f(F.col(f"_b_{name}")).over(before).alias(f"_b_{name}") for name, (_, f) in values.items()])
    inner = [c for c in ("entry_no", "direction", "exit_no") if c in trades.columns and c != order]
    within = Window.partitionBy(*key, "_stretch").orderBy(order, *inner).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    for name, (_, f) in values.items():
        t = t.withColumn(f"_w_{name}", f(F.col(f"_v_{name}")).over(within))
    return t.join(left, [*key, "_stretch"]).drop("_stretch", *[f"_v_{name}" for name in values])


def _leaving(rows: pd.DataFrame) -> pd.DataFrame:
    """For each trade of one stretch the exit with which the trades that follow from it leave the stretch."""
    rows = rows.sort_values("entry_no")
    entry, leave = rows["entry_no"].to_numpy(), rows["exit_no"].tolist()
    after = entry.searchsorted(rows["exit_no"].to_numpy(), side="right").tolist()  # the first trade that begins after the exit
    for i in range(len(leave) - 1, -1, -1):
        if after[i] < len(leave):
            leave[i] = leave[after[i]]
    return rows.assign(leave=leave)


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    """The trades of one stretch that are kept if the first of them is the one at ``start``."""
    rows = rows.sort_values("entry_no")
    entry, exits = rows["entry_no"].to_numpy(), rows["exit_no"].tolist()
    kept, i = [], int(entry.searchsorted(rows["start"].iloc[0]))
    after = entry.searchsorted(rows["exit_no"].to_numpy(), side="right").tolist()
    while i < len(exits):
        kept.append(i)
        i = after[i]
    return rows.iloc[kept]


def _next_entry(points: DataFrame, entries: DataFrame, key: list[str], at: str) -> DataFrame:
    """``points`` (key, ``at``) with ``next_no``, the first of ``entries`` (key, entry_no) after ``at``; points without one are left out."""
    no = F.lit(None).cast("long")
    both = points.select(*key, (F.col(at) + 1).alias("_pos"), F.col(at).alias("_at"), no.alias("_entry")).unionByName(entries.select(*key, F.col("entry_no").alias("_pos"), no.alias("_at"), F.col("entry_no").alias("_entry")))
    both = both.withColumn("_s", F.floor(F.col("_pos") / TRADE_STRETCH))
    later = Window.partitionBy(*key).orderBy("_s").rowsBetween(1, Window.unboundedFollowing)
    firsts = both.groupBy(*key, "_s").agg(F.min("_entry").alias("_first")).withColumn("_later", F.min("_first").over(later)).drop("_first")
    within = Window.partitionBy(*key, "_s").orderBy("_pos").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("_here", F.min("_entry").over(within)).where("_at is not null").join(firsts, [*key, "_s"])
    return found.select(*key, F.col("_at").alias(at), F.coalesce("_here", "_later").alias("next_no")).where("next_no is not null")


def without_overlap(trades: DataFrame, *by: str, arrival: str | None = None) -> DataFrame:
    """Trades in order of entry, dropping those that begin before the last kept one has ended (its exit bar included).

    ``trades`` has entry_no and exit_no (null: never ends; before the entry: ends with its bar); series are (symbol and ``by``), none of them null. Of trades that begin at the same bar the last to arrive counts, whatever becomes
    of it: the largest ``arrival``, or without that the largest in direction, entry, stop and target.

    Stretches of TRADE_STRETCH bars are handled on their own: first each tells with which exit any of its trades leaves it; these exits and the trades that
    follow them form a chain, whose links from the first trade on are found by doubling pointers; then each stretch knows where it begins. So a series
    whose trades all overlap is still many tasks.
    """
    key, spark = ["symbol", *by], trades.sparkSession
    rest = [c for c in trades.columns if c not in (*key, "entry_no")]
    known = [arrival] if arrival else [c for c in ("direction", "entry", "stop", "target") if c in rest]
    last = F.max_by(F.struct(*rest), F.struct(*known)) if known else F.max(F.struct(*rest))
    kept = stage(trades.groupBy(*key, "entry_no").agg(last.alias("r")).select(*key, "entry_no", "r.*"), "trades")
    ends = F.coalesce(F.greatest(F.col("exit_no").cast("long"), F.when(F.col("exit_no").isNotNull(), F.col("entry_no"))), F.lit(1 << 62))
    t = kept.select(*key, F.col("entry_no").cast("long").alias("entry_no"), ends.alias("exit_no"), F.floor(F.col("entry_no") / TRADE_STRETCH).alias("_stretch"))
    kinds = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in t.columns)
    left = stage(t.groupBy(*key, "_stretch").applyInPandas(_leaving, f"{kinds}, leave long"), "leaves")
    first = t.groupBy(*key).agg(F.min("entry_no").alias("entry_no"))
    exits = _next_entry(left.select(*key, "leave").distinct(), t, key, "leave").withColumnRenamed("next_no", "entry_no")
    jumps = stage(exits.join(left.select(*key, "entry_no", F.col("leave").alias("to")), [*key, "entry_no"]).select(*key, F.col("leave").alias("from"), "to"), "jumps")
    met = left.join(first, [*key, "entry_no"]).select(*key, "leave")
    while not jumps.isEmpty():
        met = stage(met.unionByName(met.withColumnRenamed("leave", "from").join(jumps, [*key, "from"]).select(*key, F.col("to").alias("leave"))).distinct(), "met")
        further = jumps.select(*key, F.col("from").alias("to"), F.col("to").alias("_next"))
        jumps = stage(jumps.join(further, [*key, "to"]).select(*key, "from", F.col("_next").alias("to")), "jumps")
    starts = _next_entry(met, t, key, "leave").select(*key, F.col("next_no").alias("start")).unionByName(first.withColumnRenamed("entry_no", "start"))
    starts = starts.withColumn("_stretch", F.floor(F.col("start") / TRADE_STRETCH)).distinct()
    walked = t.join(starts, [*key, "_stretch"]).groupBy(*key, "_stretch").applyInPandas(_walked, f"{kinds}, start long")
    return kept.join(walked.select(*key, "entry_no"), [*key, "entry_no"], "left_semi").select(*trades.columns)


def running_points(trades: DataFrame, *by: str, order: str = "entry_no", out: str = "total") -> DataFrame:
    """Running total of ``pnl`` in the order of entry, per group."""
    t = _carried_over(trades, list(by), order, {"sum": (F.col("pnl"), F.sum)}, including=True)
    return t.withColumn(out, F.coalesce("_b_sum", F.lit(0.0)) + F.coalesce("_w_sum", F.lit(0.0))).drop("_b_sum", "_w_sum")


def trade_points(trades: DataFrame, friction: float = FRICTION) -> DataFrame:
    """pnl in points after friction, and whether it is a win: a gain that friction eats up is a loss."""
    raw = (F.col("exit_price") - F.col("entry")) * F.col("direction")
    return trades.withColumn("pnl", raw - friction).withColumn("win", F.col("pnl") > 0)


def performance(trades: DataFrame, *by: str) -> DataFrame:
    """Per group: trades, wins, profit factor (null without a loss, with flag no_loss), win rate, total and Sharpe ratio per trade."""
    gain, loss = F.sum(F.greatest(F.col("pnl"), F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    deviation = F.stddev_samp("pnl")
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if("win").alias("wins"), F.round(F.try_divide(gain, loss), 3).alias("pf"), (loss == 0).alias("no_loss"),
        F.round(F.avg(F.col("win").cast("int")), 6).alias("win_rate"), F.round(F.sum("pnl"), 6).alias("total"),
        F.round(F.coalesce(F.when((F.count("*") > 1) & (deviation > 0), F.avg("pnl") / deviation), F.lit(0.0)), 6).alias("sharpe"),
    )


def max_drawdown(trades: DataFrame, *by: str, order: str = "entry_no") -> DataFrame:
    """Largest fall of the running total below its peak (which starts at 0), per group of trades."""
    t = running_points(trades, *by, order=order, out="_sum")
    t = _carried_over(t, list(by), order, {"peak": (F.col("_sum"), F.max)}, including=True).withColumn("_peak", F.greatest(F.lit(0.0), "_b_peak", "_w_peak"))
    return t.groupBy(*by).agg(F.round(F.max(F.col("_peak") - F.col("_sum")), 6).alias("max_drawdown"))


def predictivity(bars: DataFrame, signal: str, atr: str = "atr", horizons: tuple[int, ...] = (3, 5, 10, 15), multiples: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Per symbol, horizon and multiple: signals, and how many see a move of so many ATRs either way within the horizon."""
    events = bars.where(F.col(signal) & F.col(atr).isNotNull()).select("symbol", "bar_no", "close", F.col(atr).alias("_atr"))
    steps = forward_join(events, bars, max(horizons), ["high", "low"]).withColumn("_move", F.try_divide(F.greatest(F.col("high") - F.col("close"), F.col("close") - F.col("low")), F.col("_atr")))
    per = steps.groupBy("symbol", "bar_no").agg(*[F.max(F.when(F.col("step") <= h, F.col("_move"))).alias(f"m{h}") for h in horizons])
    long = per.select("symbol", F.expr(f"stack({len(horizons)}, {', '.join(f'{h}, m{h}' for h in horizons)}) AS (horizon, move)"))
    long = long.withColumn("multiple", F.explode(F.array(*map(F.lit, multiples))))
    return long.groupBy("symbol", "horizon", "multiple").agg(F.count("*").alias("signals"), F.count_if(F.col("move") >= F.col("multiple")).alias("hits"))
