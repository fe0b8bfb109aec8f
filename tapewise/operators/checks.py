"""Checks of patterns: splits over time, noise, what precedes large moves, clusters of levels, kinds of zones, entry statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import local
from ..functions.draws import drawn
from .frames import by_chunk, carried, flag, last, next_, windowed
from .joins import forward_join
from .outcomes import forward_excursion


def sliding_splits(bars: DataFrame, length: int, step: int, share: float = 0.6) -> DataFrame:
    """Bars with each window of ``length`` bars that they are in (one starts every ``step`` bars): window, phase (train or test).

    The first ``share`` of a window is for training. Windows that the series does not fill are left out.
    """
    size = bars.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_n"))
    first = F.expr(f"greatest(0L, (bar_no - {length}) div {step} + IF(bar_no >= {length}, 1, 0))")
    out = bars.join(size, "symbol").withColumn("window", F.explode(F.sequence(first, F.expr(f"bar_no div {step}"))))
    out = out.where(F.col("window") * step + length <= F.col("_n"))
    return out.withColumn("phase", F.when(F.col("bar_no") - F.col("window") * step < int(length * share), "train").otherwise("test")).drop("_n")


def split_rates(split: DataFrame, condition: Column, event: Column) -> DataFrame:
    """Per symbol, window and phase: bars, hits of a condition, and the lift of the event where it holds."""
    c, e = flag(condition), flag(event)
    out = split.groupBy("symbol", "window", "phase").agg(F.count("*").alias("bars"), F.count_if(c).alias("hits"), F.count_if(e).alias("events"), F.count_if(c & e).alias("both"))
    lift = F.try_divide(F.try_divide("both", "hits"), F.try_divide("events", "bars"))
    return out.select("symbol", "window", "phase", "bars", "hits", "both", F.round(lift, 6).alias("lift"))


def with_noise(bars: DataFrame, share: float, seed: int = 11) -> DataFrame:
    """Prices moved by normal noise of ``share`` of their value; draws are hashes of seed and bar, so runs agree. The range stays around open and close."""

    def draw(k: int) -> Column:
        u = lambda j: (drawn(seed, k, j, "symbol", "bar_no") % (1 << 30) + 1) / float((1 << 30) + 1)
        return F.sqrt(-2 * F.ln(u(0))) * F.cos(6.283185307179586 * u(1))

    moved = bars.select(*[(F.col(c) * (1 + share * draw(("open", "high", "low", "close").index(c)))).alias(c) if c in ("open", "high", "low", "close") else F.col(c) for c in bars.columns])
    top, bottom = F.greatest("open", "high", "low", "close"), F.least("open", "high", "low", "close")
    return moved.withColumn("_t", top).withColumn("_b", bottom).withColumn("high", F.col("_t")).withColumn("low", F.col("_b")).drop("_t", "_b")


def noise_check(bars: DataFrame, run: Callable[[DataFrame], DataFrame], column: str, shares: tuple[float, ...] = (0.001, 0.002, 0.005)) -> DataFrame:
    """Per symbol and noise: the share of hits of a flag (of ``run(bars)``) that stay, and stable (>= 0.8), drift (>= 0.5) or break."""
    base = run(bars).where(flag(F.col(column))).select("symbol", "bar_no")
    total = base.groupBy("symbol").agg(F.count("*").alias("hits"))
    parts = []
    for s in shares:
        noisy = run(with_noise(bars, s)).where(flag(F.col(column))).select("symbol", "bar_no")
        stay = base.join(noisy, ["symbol", "bar_no"], "left_semi").groupBy("symbol").agg(F.count("*").alias("stay"))
        parts.append(total.join(stay, "symbol", "left").withColumn("noise", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kept = F.coalesce("stay", F.lit(0)) / F.col("hits")
    return out.select("symbol", "noise", "hits", F.round(kept, 6).alias("kept"), F.when(kept >= 0.8, "stable").when(kept >= 0.5, "drift").otherwise("break").alias("label"))


def _move(bars: DataFrame, n: int) -> DataFrame:
    return windowed(bars, lambda b: b.withColumn("_move", F.abs(F.lead("close", n).over(by_chunk()) - F.col("close"))), ahead=n).where("_move is not null")


def before_large_moves(bars: DataFrame, value: str, n: int = 60, share: float = 0.95) -> DataFrame:
    """Per symbol: mean of ``value`` at bars before moves of ``n`` bars at or above their ``share`` quantile, and at all other bars."""
    b = _move(bars, n).where(F.col(value).isNotNull())
    cut = b.groupBy("symbol").agg(F.percentile("_move", F.lit(share)).alias("_cut"))
    large = F.col("_move") >= F.col("_cut")
    return b.join(cut, "symbol").groupBy("symbol").agg(
        F.count_if(large).alias("large"), F.round(F.avg(F.when(large, F.col(value))), 6).alias("before_large"), F.round(F.avg(F.when(~large, F.col(value))), 6).alias("otherwise")
    )


def decile_moves(bars: DataFrame, value: str, n: int = 60) -> DataFrame:
    """Per symbol and decile of ``value`` (1..10, by the symbol's quantiles): bars and mean move of the next ``n`` bars."""
    b = _move(bars, n).where(F.col(value).isNotNull())
    cuts = b.groupBy("symbol").agg(F.percentile(value, F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("_q"))
    decile = F.size(F.filter("_q", lambda q: q < F.col(value))) + 1
    return b.join(cuts, "symbol").groupBy("symbol", decile.alias("decile")).agg(F.count("*").alias("bars"), F.round(F.avg("_move"), 6).alias("move"))


def tail_check(bars: DataFrame, tail: int = 2000, back: int = 10, n: int = 15, multiple: float = 2.0, atr: str = "atr") -> DataFrame:
    """On each symbol's last ``tail`` bars: bars after both a compression and a sweep within ``back`` bars, and how many see a
    range of ``multiple`` median ATRs in the next ``n`` bars (as far as there are any)."""

    def build(b: DataFrame) -> DataFrame:
        seen = lambda *s: F.max(F.col("state").isin(*s).cast("int")).over(last(back, including=False)) == 1
        b = b.withColumn("_hit", flag(seen("C")) & flag(seen("SU", "SD")))
        return b.withColumn("_range", F.max("high").over(next_(n)) - F.min("low").over(next_(n)))

    sizes = bars.groupBy("symbol").agg(F.max("bar_no").alias("_last"), F.median(atr).alias("_m"))
    b = windowed(bars, build, back=back, ahead=n).join(sizes, "symbol").where(F.col("bar_no") > F.col("_last") - tail)
    return b.groupBy("symbol").agg(F.count_if("_hit").alias("signals"), F.count_if(F.col("_hit") & flag(F.col("_range") > multiple * F.col("_m"))).alias("hits"))


def level_clusters(life: DataFrame, bars: DataFrame, horizon: int = 240, distance: float = 20.0, after: int = 15) -> DataFrame:
    """First touches of levels by the number of other levels active near them then: touches, and those that close ``after`` bars
    later on the side that price came from.

    ``life``: symbol, bar_no, price, side, filled_after; a level is active from the bar after its own until it is filled,
    ``horizon`` bars at most. Levels meet touches on (symbol, block of ``horizon`` bars).
    """
    active = life.where("side is not null").withColumn("until", F.col("bar_no") + F.coalesce("filled_after", F.lit(horizon)))
    steps = forward_join(active.select("symbol", "bar_no", "price", "side", "until"), bars, horizon, ["high", "low"])
    hit = steps.where((F.col("low") <= F.col("price")) & (F.col("high") >= F.col("price")) & (F.col("bar_no") + F.col("step") <= F.col("until")))
    touch = hit.groupBy("symbol", "bar_no", "price", "side").agg((F.min(F.col("bar_no") + F.col("step"))).alias("touch_no")).withColumn("_b", F.expr(f"touch_no div {horizon}"))
    spread = active.select(
        "symbol", F.col("bar_no").alias("_no"), F.col("price").alias("_price"), "until",
        F.explode(F.sequence(F.expr(f"bar_no div {horizon}"), F.expr(f"until div {horizon}"))).alias("_b"),
    )
    near = (F.col("_no") != F.col("bar_no")) & (F.col("_no") < F.col("touch_no")) & (F.col("touch_no") <= F.col("until")) & (F.abs(F.col("_price") - F.col("price")) <= distance)
    others = touch.join(spread, ["symbol", "_b"]).where(near).groupBy("symbol", "bar_no").agg(F.count("*").alias("_n"))
    then = bars.select("symbol", (F.col("bar_no") - after).alias("touch_no"), F.col("close").alias("_then"))
    out = touch.join(others, ["symbol", "bar_no"], "left").join(then, ["symbol", "touch_no"])
    bounced = F.col("side") * (F.col("_then") - F.col("price")) > 0
    return out.groupBy("symbol", F.least(F.coalesce("_n", F.lit(0)), F.lit(3)).cast("int").alias("others")).agg(F.count("*").alias("touches"), F.count_if(bounced).alias("bounces"))


def touches_by_regime(touched: DataFrame, bars: DataFrame, first: str = "ker", second: str = "atr") -> DataFrame:
    """Touches and bounces by whether two values lie above or at most at the symbol's median of them at touches."""
    t = touched.join(bars.select("symbol", "bar_no", F.col(first).alias("_a"), F.col(second).alias("_b")), ["symbol", "bar_no"]).where("_a is not null and _b is not null")
    m = t.groupBy("symbol").agg(F.median("_a").alias("_ma"), F.median("_b").alias("_mb"))
    high = lambda v, c: F.when(F.col(v) > F.col(c), "high").otherwise("low")
    t = t.join(m, "symbol").groupBy("symbol", high("_a", "_ma").alias(first), high("_b", "_mb").alias(second))
    return t.agg(F.count("*").alias("touches"), F.count_if("bounced").alias("bounces"))


def zone_kinds(kinds: Mapping[str, DataFrame], bars: DataFrame, n: int = 60) -> DataFrame:
    """Per symbol and kind of zone: births, share filled, median size, and medians of the excursion of the next ``n`` bars for the zone's side.

    ``kinds``: episodes of each kind (symbol, side, born_no, entry, far, fill_no).
    """
    every = None
    for name, e in kinds.items():
        part = e.select(F.lit(name).alias("kind"), "symbol", "side", F.col("born_no").alias("bar_no"), (F.col("entry") - F.col("far")).alias("size"), F.col("fill_no").isNotNull().alias("filled"))
        every = part if every is None else every.unionByName(part)
    moves = forward_excursion(bars, n).select("symbol", "bar_no", "mfe_up", "mae_up")
    bull = F.col("side") == "bull"
    out = every.join(moves, ["symbol", "bar_no"], "left").withColumn("mfe", F.when(bull, F.col("mfe_up")).otherwise(F.col("mae_up"))).withColumn("mae", F.when(bull, F.col("mae_up")).otherwise(F.col("mfe_up")))
    return out.groupBy("symbol", "kind").agg(
        F.count("*").alias("births"), F.round(F.avg(F.col("filled").cast("int")) * 100, 4).alias("filled_pct"), *[F.round(F.median(c), 6).alias(c) for c in ("size", "mfe", "mae")]
    )


def range_returns(bars: DataFrame, horizons: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    """Per symbol, side (premium: short, discount: long) and horizon: bars, mean signed move and how many gain; needs premium and discount."""

    def build(b: DataFrame) -> DataFrame:
        for h in horizons:
            b = b.withColumn(f"_n{h}", F.lead("close", h).over(by_chunk()) - F.col("close"))
        return b

    b = windowed(bars, build, ahead=max(horizons)).withColumn("side", F.when(F.col("premium"), "premium").when(F.col("discount"), "discount")).where("side is not null")
    long = b.select("symbol", "side", F.expr(f"stack({len(horizons)}, {', '.join(f'{h}, _n{h}' for h in horizons)}) AS (horizon, net)")).where("net is not null")
    net = F.when(F.col("side") == "premium", -F.col("net")).otherwise(F.col("net"))
    return long.withColumn("net", net).groupBy("symbol", "side", "horizon").agg(F.count("*").alias("bars"), F.round(F.avg("net"), 6).alias("mean"), F.count_if(F.col("net") > 0).alias("gains"))


def middle_touches(bars: DataFrame, middle: str = "dr_mid", n: int = 15) -> DataFrame:
    """Bars that touch the middle of the range coming from above or below, and how many close back on that side ``n`` bars later."""

    def build(b: DataFrame) -> DataFrame:
        return b.withColumn("_was", F.lag("close").over(by_chunk())).withColumn("_then", F.lead("close", n).over(by_chunk()))

    m = F.col(middle)
    b = windowed(bars, build, back=1, ahead=n).where((F.col("low") <= m) & (F.col("high") >= m) & F.col("_then").isNotNull() & F.col("_was").isNotNull())
    above = F.col("_was") > m
    held = F.when(above, F.col("_then") > m).otherwise(F.col("_then") < m)
    return b.groupBy("symbol", F.when(above, "above").otherwise("below").alias("side")).agg(F.count("*").alias("touches"), F.count_if(held).alias("bounces"))


def entry_statistics(bars: DataFrame, flags: Mapping[str, int], n: int = 200) -> DataFrame:
    """Per symbol and flag (with its direction): signals, signals per day, and quantiles of MFE and MAE of the next ``n`` bars, cut at 0.

    Horizons end with the data; a signal on the last bar has no excursion and counts in ``signals`` only.
    """
    days = bars.groupBy("symbol").agg(F.count_distinct(F.to_date("ts")).alias("_days"))
    b = forward_excursion(bars, n, truncate=True)
    hits = F.array_compact(F.array(*[F.when(flag(F.col(f)), F.struct(F.lit(f).alias("flag"), F.lit(d).alias("d"))) for f, d in flags.items()]))
    b = b.select("symbol", "mfe_up", "mae_up", F.explode(hits).alias("x")).select("symbol", "x.flag", "x.d", "mfe_up", "mae_up")
    up, zero = F.col("d") > 0, F.lit(0.0)
    cut = lambda a, c: F.when(F.col(a).isNotNull(), F.greatest(F.when(up, F.col(a)).otherwise(F.col(c)), zero))
    b = b.withColumn("mfe", cut("mfe_up", "mae_up")).withColumn("mae", cut("mae_up", "mfe_up"))
    mfe, mae = (50, 75, 90), (50, 80, 90, 95)
    q = lambda c, ps: F.percentile(c, F.array(*[F.lit(p / 100) for p in ps])).alias(f"_{c}")
    out = b.groupBy("symbol", "flag").agg(F.count("*").alias("signals"), q("mfe", mfe), q("mae", mae)).join(days, "symbol")
    return out.select(
        "symbol", "flag", "signals", F.round(F.col("signals") / F.col("_days"), 6).alias("per_day"),
        *[F.round(F.col("_mfe")[i], 6).alias(f"mfe_p{p}") for i, p in enumerate(mfe)], *[F.round(F.col("_mae")[i], 6).alias(f"mae_p{p}") for i, p in enumerate(mae)],
    )


def atr_trail_exit(events: DataFrame, bars: DataFrame, n: int, distance: float, activation: float = 0.0, atr: str = "atr") -> DataFrame:
    """Exit of events (symbol, bar_no, direction, entry, ...) at a stop that trails the high (long) by ``distance`` ATRs of each bar.

    The stop of a bar comes from the bars since entry before it; it never loosens, and works once price has run
    ``activation`` ATRs (of the bar it does so on) beyond the entry. Adds exit_step, exit_price and outcome: trail, or timeout at the
    close of the last bar within ``n``.
    """
    d = F.col("direction")
    steps = forward_join(events, bars, n, ["high", "low", "close", atr])
    best = F.when(d > 0, F.col("high")).otherwise(-F.col("low"))
    worst = F.when(d > 0, F.col("low")).otherwise(-F.col("high"))
    steps = steps.withColumn("_best", best).withColumn("_worst", worst).withColumn("_e", F.col("entry") * d)
    before = Window.partitionBy(*events.columns).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ran = F.max((F.col("_best") - F.col("_e") >= activation * F.col(atr)).cast("int")).over(before) == 1
    steps = steps.withColumn("_stop", F.max(F.col("_best") - distance * F.col(atr)).over(before)).withColumn("_on", flag(ran))
    hit = F.col("_on") & flag(F.col("_worst") <= F.col("_stop"))
    out = steps.groupBy(*events.columns).agg(
        F.min(F.when(hit, F.col("step"))).alias("_s"), F.min_by("_stop", F.when(hit, F.col("step"))).alias("_p"), F.max("step").alias("_last"), F.max_by("close", "step").alias("_c")
    )
    trailed = F.col("_s").isNotNull()
    return out.select(
        *events.columns, F.coalesce("_s", "_last").alias("exit_step"), F.when(trailed, F.col("_p") * d).otherwise(F.col("_c")).alias("exit_price"), F.when(trailed, "trail").otherwise("timeout").alias("outcome")
    )


def extremes(trades: DataFrame, by: str, k: int = 5, value: str = "pnl", key: str = "entry_no") -> DataFrame:
    """The ``k`` best and worst trades of each group, with ``place`` (best: 1.., worst: -1..); a trade may be both. Each task keeps its own ``k`` before the shuffle."""

    def first(order: Column, sign: int) -> DataFrame:
        places = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
        return trades.withColumn("place", places).where(F.col("place") <= k).withColumn("place", F.col("place") * sign)

    return first(F.col(value).desc(), 1).unionByName(first(F.col(value).asc(), -1))


def session_ranges(bars: DataFrame, labels: Column, sessions: Sequence[str], horizons: Sequence[int] = (5, 15, 60)) -> DataFrame:
    """Every bar with the finished range of each session that it is not in: symbol, bar_no, ts, session, prices, s_high, s_low, s_mid, premium, discount and net_{n}.

    ``labels`` names the session of a bar; a session's range is that of its bars of one trading day (from 18:00 New York time) and holds from the
    bar after its last one until it begins again. net_{n}: change of the close in the next n bars.
    """
    day = F.to_date(local("ts") + F.expr("INTERVAL 6 HOURS"))
    closes = [F.lead("close", n).over(by_chunk()) - F.col("close") for n in horizons]
    b = windowed(bars, lambda x: x.select("*", *[c.alias(f"net_{n}") for n, c in zip(horizons, closes, strict=True)]), ahead=max(horizons))
    b = b.withColumn("_label", labels).withColumn("_day", day)
    ranges = b.where(F.col("_label").isin(*sessions)).groupBy("symbol", "_label", "_day").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("bar_no").alias("bar_no"))
    ends = ranges.groupBy("symbol", "bar_no").agg(*[F.max(F.when(F.col("_label") == s, F.struct("high", "low"))).alias(f"_r{k}") for k, s in enumerate(sessions)])
    marked = carried(b.join(ends, ["symbol", "bar_no"], "left"), {f"_s{k}": f"_r{k}" for k in range(len(sessions))}, including=False)
    each = F.array(*[F.when((F.col("_label") != s) | F.col("_label").isNull(), F.struct(F.lit(s).alias("session"), F.col(f"_s{k}.high").alias("s_high"), F.col(f"_s{k}.low").alias("s_low"))) for k, s in enumerate(sessions)])
    long = marked.select("symbol", "bar_no", "ts", "high", "low", "close", *[f"net_{n}" for n in horizons], F.inline(F.array_compact(each))).where("s_high is not null")
    long = long.withColumn("s_mid", (F.col("s_high") + F.col("s_low")) / 2)
    return long.withColumn("premium", F.col("close") > F.col("s_mid")).withColumn("discount", F.col("close") < F.col("s_mid"))


def session_touches(ranges: DataFrame, n: int = 15) -> DataFrame:
    """Per symbol and session: bars held against the range, its mean and median span, and touches of its middle, high and low with those that hold ``n`` bars later."""
    then = F.col("close") + F.col(f"net_{n}")
    seen = then.isNotNull()
    mid = seen & (F.col("low") <= F.col("s_mid")) & (F.col("high") >= F.col("s_mid"))
    high, low = seen & (F.col("high") >= F.col("s_high")) & (F.col("low") < F.col("s_high")), seen & (F.col("low") <= F.col("s_low")) & (F.col("high") > F.col("s_low"))
    held = F.when(F.col("close") > F.col("s_mid"), then > F.col("s_mid")).otherwise(then < F.col("s_mid"))
    span = F.col("s_high") - F.col("s_low")
    return ranges.groupBy("symbol", "session").agg(
        F.count("*").alias("bars"), F.round(F.avg(span), 6).alias("span"), F.round(F.median(span), 6).alias("median_span"), F.count_if(mid).alias("mid_touches"), F.count_if(mid & held).alias("mid_bounces"),
        F.count_if(high).alias("high_touches"), F.count_if(high & (then < F.col("s_high"))).alias("high_bounces"), F.count_if(low).alias("low_touches"), F.count_if(low & (then > F.col("s_low"))).alias("low_bounces"),
    )


def _sided(rows: DataFrame) -> DataFrame:
    return rows.withColumn("side", F.when(F.col("premium"), "premium").when(F.col("discount"), "discount")).where("side is not null")


def session_returns(ranges: DataFrame, horizons: Sequence[int] = (5, 15, 60)) -> DataFrame:
    """Per symbol, session, side and horizon: bars, mean gain and number of gains of selling in the upper and buying in the lower half."""
    long = _sided(ranges).select("symbol", "session", "side", F.expr(f"stack({len(horizons)}, {', '.join(f'{h}, net_{h}' for h in horizons)}) AS (horizon, net)")).where("net is not null")
    gain = F.when(F.col("side") == "premium", -F.col("net")).otherwise(F.col("net"))
    return long.withColumn("gain", gain).groupBy("symbol", "session", "side", "horizon").agg(F.count("*").alias("bars"), F.round(F.avg("gain"), 6).alias("mean"), F.count_if(F.col("gain") > 0).alias("gains"))


def session_confluence(ranges: DataFrame, most: int = 4, n: int = 15) -> DataFrame:
    """Per symbol, side and level: bars that are on this side of at least so many sessions' ranges, and their mean gain ``n`` bars later."""
    net = F.col(f"net_{n}")
    per = _sided(ranges).where(net.isNotNull()).groupBy("symbol", "bar_no", "side").agg(F.count("*").alias("_n"), F.first(net).alias("net"))
    gain = F.when(F.col("side") == "premium", -F.col("net")).otherwise(F.col("net"))
    each = per.withColumn("gain", gain).withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.col("_n").cast("int"), F.lit(most)))))
    return each.groupBy("symbol", "side", "level").agg(F.count("*").alias("bars"), F.round(F.avg("gain"), 6).alias("mean"), F.count_if(F.col("gain") > 0).alias("gains"))


def session_filter(ranges: DataFrame, touches: DataFrame, n: int = 15) -> DataFrame:
    """Per symbol, session and side: touches of zones (symbol, bar_no), and how many gain in ``n`` bars by selling in the upper and buying in the lower half."""
    met = _sided(ranges).where(F.col(f"net_{n}").isNotNull()).join(touches.select("symbol", "bar_no").distinct(), ["symbol", "bar_no"])
    gain = F.when(F.col("side") == "premium", -F.col(f"net_{n}")).otherwise(F.col(f"net_{n}"))
    return met.groupBy("symbol", "session", "side").agg(F.count("*").alias("touches"), F.count_if(gain > 0).alias("gains"))
