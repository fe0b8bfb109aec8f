"""Price-pattern signals: bars in, the same bars with more columns out; no signal looks ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import CHICAGO, local, minute_of_day
from ..sources.bars import keyed
from ..sources.store import stage
from .frames import by_chunk, carried, flag, last, recursion, rising, running_sum, windowed

SIDES = ("bull", "bear")


def _true_range() -> Column:
    before = F.lag("close").over(by_chunk())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14, out: str = "atr", shifted: bool = False, full: bool = False) -> DataFrame:
    """Mean true range of ``n`` bars; ``shifted``: of the bars before this one; ``full``: null until n bars are there."""

    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_tr", _true_range())
        mean = F.avg("_tr").over(last(n, including=not shifted))
        if full:
            mean = F.when(F.count("_tr").over(last(n, including=not shifted)) == n, mean)
        return b.withColumn(out, mean).drop("_tr")

    return windowed(bars, build, back=n + 1)


def smoothed_atr(bars: DataFrame, n: int = 14, smooth: int = 50, out: str = "atr_smooth") -> DataFrame:
    """``smooth``-bar mean of the ATR, null until it is full."""
    with_atr = atr(bars, n, "_atr")

    def build(b: DataFrame) -> DataFrame:
        mean = F.avg("_atr").over(last(smooth))
        return b.withColumn(out, F.when(F.count("_atr").over(last(smooth)) == smooth, mean)).drop("_atr")

    return windowed(with_atr, build, back=smooth)


def fair_value_gap(bars: DataFrame, min_gap: float = 0.0, max_age: int = 0, prefix: str = "fvg") -> DataFrame:
    """Three-bar gaps as zones, per side: {prefix}_bull (new zone), _bull_id (zones so far), _bull_high, _bull_low,
    _bull_mid, _bull_active, _bull_filled and _bull_zone (born, ts, high and low of the last zone, filled or not).

    A bull gap is low - high[two bars ago] > min_gap; its zone runs from that high to the low. At each bar the zone
    before the bar may be filled (low <= zone low), then a new zone may replace it. ``max_age``: bars after which a zone is
    no longer active (0: never). Bounds are there while the zone is active; sides are independent.

    One pass sorts the chunks' bars and follows the zones born in each; a row for each chunk says with which zone it ends, and composing these rows gives the zone with which
    each chunk begins.
    """
    before, up_to = (by_chunk().rowsBetween(Window.unboundedPreceding, to) for to in (-1, 0))
    kind = "struct<born: bigint, ts: timestamp, high: double, low: double>"
    edge = {"bull": "low", "bear": "high"}  # where a zone ends, and the price that gets there

    def follow(b: DataFrame) -> DataFrame:
        own = F.col("chunk") == F.col("_home")  # not one of the copies from the chunk before
        high, low = F.lag("high", 2).over(by_chunk()), F.lag("low", 2).over(by_chunk())
        b = b.withColumns({f"{prefix}_bull": flag(F.col("low") - high > min_gap), f"{prefix}_bear": flag(low - F.col("high") > min_gap), "_high2": high, "_low2": low})
        # bar, bounds and time of new zones; and what a zone from an earlier chunk meets: the furthest price of the chunk's bars
        new = {"bull": ("low", "_high2"), "bear": ("_low2", "high")}
        b = b.withColumns({f"_{side}_{name}": F.when(F.col(f"{prefix}_{side}") & own, F.col(value)) for side in SIDES for name, value in (("born", "bar_no"), ("top", new[side][0]), ("bottom", new[side][1]), ("ts", "ts"))})
        last_ = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
        reach = {"bull": F.min(F.when(own, F.col("low"))), "bear": F.max(F.when(own, F.col("high")))}
        limit = {"bull": "bottom", "bear": "top"}
        b = b.withColumns({f"_{side}_{name}": value for side in SIDES for name, value in (
            ("n", F.count(f"_{side}_born").over(up_to)), *((f"own_{k}", last_(f"_{side}_{k}", up_to)) for k in ("born", "top", "bottom", "ts")), ("was", last_(f"_{side}_born", before)),
            ("limit", last_(f"_{side}_{limit[side]}", before)), ("far", reach[side].over(up_to)), ("far_was", reach[side].over(before)))})
        hit = {"bull": F.col("low") <= F.col("_bull_limit"), "bear": F.col("high") >= F.col("_bear_limit")}
        b = b.withColumns({f"_{side}_hit": F.when(hit[side], F.col(f"_{side}_was")) for side in SIDES})
        b = b.withColumns({f"_{side}_{name}": last_(f"_{side}_hit", frame) for side in SIDES for name, frame in (("gone", up_to), ("gone_was", before))})
        return b.drop("_high2", "_low2", *[f"_{side}_{k}" for side in SIDES for k in ("top", "bottom", "ts", "limit")])

    followed = stage(windowed(bars, follow, back=2), "gaps")
    reached = {"bull": F.min("low"), "bear": F.max("high")}

    def zone_of(side: str) -> Column:
        born, ts, top, bottom = (F.col(f"_{side}_own_{k}") for k in ("born", "ts", "top", "bottom"))
        return F.when(born.isNotNull(), F.struct(born.cast("long").alias("born"), ts.cast("timestamp").alias("ts"), top.cast("double").alias("high"), bottom.cast("double").alias("low")))

    ends = followed.groupBy("symbol", "chunk").agg(F.struct(*[F.struct(
        F.count(f"_{side}_born").alias("n"), F.max_by(zone_of(side), "bar_no").alias("zone"), F.max_by(flag(F.col(f"_{side}_gone") == F.col(f"_{side}_own_born")), "bar_no").alias("gone"),
        reached[side].cast("double").alias("far")).alias(side) for side in SIDES]).alias("e"))
    ends = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("chunk", "e"))).alias("p"))  # as long as a symbol has chunks
    steps = ", ".join(f"""named_struct('n', s[size(s) - 1].{side}.n + c.e.{side}.n, 'zone', coalesce(c.e.{side}.zone, s[size(s) - 1].{side}.zone), 'gone', IF(c.e.{side}.zone IS NOT NULL, c.e.{side}.gone,
        s[size(s) - 1].{side}.gone OR coalesce({reach}, false))) AS {side}""" for side, reach in (("bull", "c.e.bull.far <= s[size(s) - 1].bull.zone.low"), ("bear", "c.e.bear.far >= s[size(s) - 1].bear.zone.high")))
    start = ", ".join(f"named_struct('n', 0L, 'zone', cast(null AS {kind}), 'gone', false) AS {side}" for side in SIDES)
    fold = F.expr(f"aggregate(p, array(struct({start})), (s, c) -> concat(s, array(struct({steps}))))")
    into = ends.select("symbol", F.explode(F.arrays_zip(F.transform("p", lambda c: c["chunk"]).alias("chunk"), F.slice(fold, F.lit(1), F.size("p")).alias("s"))).alias("x"))
    began = [F.col(f"x.s.{side}.{k}").alias(f"_{side}_s_{k}") for side in SIDES for k in ("n", "gone")] + [F.col(f"x.s.{side}.zone.{k}").alias(f"_{side}_s_{k}") for side in SIDES for k in ("born", "ts", "high", "low")]
    out = followed.join(into.select("symbol", "x.chunk", *began), ["symbol", "chunk"])
    c = {side: (lambda k, side=side: F.col(f"_{side}_{k}")) for side in SIDES}
    beyond = {"bull": lambda far: flag(far <= c["bull"]("s_low")), "bear": lambda far: flag(far >= c["bear"]("s_high"))}
    # zones of the chunk itself, else the one with which it began
    out = out.withColumns({f"_{side}_{z}": F.coalesce(c[side](f"own_{k}"), c[side](f"s_{z}")) for side in SIDES for z, k in (("born", "born"), ("ts", "ts"), ("high", "top"), ("low", "bottom"))} | {
        f"_{side}_alive": ~F.when(c[side]("own_born").isNotNull(), flag(c[side]("gone") == c[side]("own_born"))).otherwise(c[side]("s_gone") | beyond[side](c[side]("far"))) for side in SIDES
    })
    active = {side: c[side]("born").isNotNull() & c[side]("alive") & ((F.col("bar_no") - c[side]("born") <= max_age) if max_age else F.lit(True)) for side in SIDES}
    out = out.withColumns({f"{prefix}_{side}_active": flag(active[side]) for side in SIDES})
    told = {}
    for side in SIDES:
        name, on, high, low = f"{prefix}_{side}", F.col(f"{prefix}_{side}_active"), c[side]("high").cast("double"), c[side]("low").cast("double")
        filled = F.when(c[side]("was").isNotNull(), c[side]("hit").isNotNull() & ~flag(c[side]("gone_was") == c[side]("hit")))
        zone = F.struct(c[side]("born").cast("long").alias("born"), c[side]("ts").cast("timestamp").alias("ts"), high.alias("high"), low.alias("low"))
        told |= {
            f"{name}_id": c[side]("n") + c[side]("s_n"), f"{name}_zone": F.when(c[side]("born").isNotNull(), zone), f"{name}_high": F.when(on, high), f"{name}_low": F.when(on, low), f"{name}_mid": F.when(on, (high + low) / 2),
            f"{name}_filled": filled.otherwise(~c[side]("s_gone") & ~beyond[side](c[side]("far_was")) & beyond[side](F.col(edge[side]))),
        }
    out = out.withColumns(told)
    return out.select(*[x for x in out.columns if not (x.startswith("_bull_") or x.startswith("_bear_"))])


def break_of_structure(bars: DataFrame, n: int = 5) -> DataFrame:
    """bos_bull, bos_bear and the levels bos_level_high, bos_level_low: the close first passes the last swing point.

    A swing high is a bar whose high is the highest of the last ``n``; its level holds from the next bar on.
    """

    def swings(b: DataFrame) -> DataFrame:
        full = F.count("*").over(last(n)) == n
        return b.withColumn("_sh", F.when(full & (F.col("high") == F.max("high").over(last(n))), F.col("high"))).withColumn(
            "_sl", F.when(full & (F.col("low") == F.min("low").over(last(n))), F.col("low"))
        )

    out = carried(windowed(bars, swings, back=n), {"bos_level_high": "_sh", "bos_level_low": "_sl"}, including=False)
    out = out.withColumn("_above", flag(F.col("close") > F.col("bos_level_high"))).withColumn("_below", flag(F.col("close") < F.col("bos_level_low")))

    def breaks(b: DataFrame) -> DataFrame:
        return b.withColumn("bos_bull", rising("_above")).withColumn("bos_bear", rising("_below"))

    return windowed(out, breaks, back=1).drop("_sh", "_sl", "_above", "_below")


def displacement(bars: DataFrame, atr_mult: float = 1.5, body_share: float = 0.5, n: int = 14) -> DataFrame:
    """disp_bull, disp_bear: the body exceeds ``atr_mult`` mean true ranges of the bars before and half of the bar's range."""
    out = atr(bars, n, "_atr", shifted=True)
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    strong = flag((body > F.col("_atr") * atr_mult) & (body / F.when(span > 0, span) >= body_share))
    return out.withColumn("disp_bull", strong & (F.col("close") > F.col("open"))).withColumn("disp_bear", strong & (F.col("close") < F.col("open"))).drop("_atr")


def displacement_entry(bars: DataFrame, atr_mult: float = 1.2, close_part: float = 0.75, n: int = 14, volume_n: int = 0) -> DataFrame:
    """entry_bull, entry_bear: a large body that closes in the outer part of its bar, with volume above its mean if asked for."""
    out = atr(bars, n, "_atr", shifted=True)
    if volume_n:
        out = windowed(out, lambda b: b.withColumn("_mean", F.avg("volume").over(last(volume_n))), back=volume_n)
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    big = flag(body > F.col("_atr") * atr_mult) & (flag(F.col("volume") > F.col("_mean")) if volume_n else F.lit(True))
    place = (F.col("close") - F.col("low")) / F.when(span > 0, span)
    out = out.withColumn("entry_bull", big & flag(place >= close_part) & (F.col("close") > F.col("open")))
    return out.withColumn("entry_bear", big & flag(place <= 1 - close_part) & (F.col("close") < F.col("open"))).drop("_atr", "_mean")


def dealing_range(bars: DataFrame, n: int = 20) -> DataFrame:
    """dr_high, dr_low, dr_mid, dr_span, dr_pct (50 in a flat range), in_range, premium and discount of the last n bars."""

    def build(b: DataFrame) -> DataFrame:
        return b.withColumn("dr_high", F.max("high").over(last(n))).withColumn("dr_low", F.min("low").over(last(n)))

    out = windowed(bars, build, back=n)
    span = F.col("dr_high") - F.col("dr_low")
    out = out.withColumn("dr_mid", (F.col("dr_high") + F.col("dr_low")) / 2).withColumn("dr_span", span)
    out = out.withColumn("dr_pct", F.when(span > 0, (F.col("close") - F.col("dr_low")) / span * 100).otherwise(50.0))
    out = out.withColumn("in_range", F.col("close").between(F.col("dr_low"), F.col("dr_high")))
    return out.withColumn("premium", F.col("close") > F.col("dr_mid")).withColumn("discount", F.col("close") < F.col("dr_mid"))


def adx(bars: DataFrame, n: int = 14, out: str = "adx") -> DataFrame:
    """Mean directional index in its simple form: means of clipped moves over the mean true range, then of their contrast."""

    def build(b: DataFrame) -> DataFrame:
        up, down = F.greatest(F.col("high") - F.lag("high").over(by_chunk()), F.lit(0.0)), F.greatest(F.lag("low").over(by_chunk()) - F.col("low"), F.lit(0.0))
        b = b.withColumn("_up", up).withColumn("_down", down).withColumn("_tr", _true_range())
        for c in ("_up", "_down", "_tr"):
            b = b.withColumn(c, F.avg(c).over(last(n)))
        plus, minus = F.try_divide("_up", "_tr"), F.try_divide("_down", "_tr")
        b = b.withColumn("_dx", F.try_divide(F.abs(plus - minus), plus + minus) * 100)
        return b.withColumn(out, F.avg("_dx").over(last(n))).drop("_up", "_down", "_tr", "_dx")

    return windowed(bars, build, back=2 * n + 1)


def efficiency_ratio(bars: DataFrame, n: int = 20, out: str = "ker") -> DataFrame:
    """Net move of n bars over the length of the path; null where the path is flat or the window not full."""

    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_d", F.abs(F.col("close") - F.lag("close").over(by_chunk())))
        path = F.sum("_d").over(last(n))
        return b.withColumn(out, F.try_divide(F.abs(F.col("close") - F.lag("close", n).over(by_chunk())), path)).drop("_d")

    return windowed(bars, build, back=n + 1)


def hurst(bars: DataFrame, n: int = 100, lags: tuple[int, int] = (2, 19), reverting: bool = False) -> DataFrame:
    """Rolling Hurst exponent of the ``n`` closes before the bar: hurst, hurst_regime (-1, 0, 1) and hurst_passes.

    Slope of log deviation against log lag over the k-lag log returns within the window, in [0, 1]; 0.5 with fewer than
    two usable lags. ``reverting``: passes means below 0.45 instead of above 0.50.
    """
    first, final = lags

    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_log", F.when(F.col("close") > 0, F.ln("close")))
        names = []
        for k in range(first, final + 1):
            b = b.withColumn(f"_r{k}", F.col("_log") - F.lag("_log", k).over(by_chunk()))
        for k in range(first, final + 1):
            inside = by_chunk().rowsBetween(k - n, -1)
            b = b.withColumn(f"_s{k}", F.when(F.count(f"_r{k}").over(inside) >= 2, F.stddev_samp(f"_r{k}").over(inside)))
            names.append((k, f"_s{k}"))
        points = F.filter(F.array(*[F.struct(F.ln(F.lit(float(k))).alias("x"), F.when(F.col(c) > 0, F.ln(c)).alias("y")) for k, c in names]), lambda p: p["y"].isNotNull())
        b = b.withColumn("_p", points)
        slope = F.expr("""
            try_divide(
                size(_p) * aggregate(_p, 0D, (t, p) -> t + p.x * p.y) - aggregate(_p, 0D, (t, p) -> t + p.x) * aggregate(_p, 0D, (t, p) -> t + p.y),
                size(_p) * aggregate(_p, 0D, (t, p) -> t + p.x * p.x) - pow(aggregate(_p, 0D, (t, p) -> t + p.x), 2))
        """)
        enough = (F.size("_p") >= 2) & (F.count("_log").over(last(n, including=False)) >= 16)
        b = b.withColumn("hurst", F.when(enough, F.least(F.greatest(slope, F.lit(0.0)), F.lit(1.0))).otherwise(0.5))
        return b.drop("_log", "_p", *[f"_r{k}" for k, _ in names], *[c for _, c in names])

    out = windowed(bars, build, back=n + final + 1)
    h = F.col("hurst")
    out = out.withColumn("hurst_regime", F.when(h > 0.5, 1).when(h < 0.45, -1).otherwise(0).cast("tinyint"))
    return out.withColumn("hurst_passes", h < 0.45 if reverting else h > 0.5)


#: Thresholds of the states below.
COMPRESS, SWEEP_ADD, SWEEP_VOLUME, WICK, MOVED = 0.5, 1.5, 1.5, 0.35, 2.0


def states(bars: DataFrame, compress: float = COMPRESS, sweep_add: float = SWEEP_ADD, sweep_volume: float = SWEEP_VOLUME, wick: float = WICK, volume_n: int = 100) -> DataFrame:
    """Raw state of each bar: C, SU, SD, DU, DD, BU, BD or N, in this order of priority, from bar 30 on.

    C: the five ranges before are on average below ``compress`` smoothed ATRs. SU / SD: a high / low beyond the ten bars
    before by ``sweep_add`` on high volume, from which the close has come back by ``wick`` of the range. DU / DD: the close moves by two ATRs. BU / BD: the close leaves
    the fifteen bars before on volume above its median. The median is that of the ``volume_n`` bars before.
    """

    def build(b: DataFrame) -> DataFrame:
        span = F.col("high") - F.col("low")
        b = b.withColumn("_median", F.percentile("volume", F.lit(0.5)).over(last(volume_n, including=False)))
        calm = F.avg(span).over(last(5, including=False)) < compress * F.col("_atr50")
        loud = F.col("volume") > sweep_volume * F.col("_median")
        upper, lower = (F.col("high") - F.col("close")) / F.when(span > 0, span), (F.col("close") - F.col("low")) / F.when(span > 0, span)
        up = (F.col("high") > F.max("high").over(last(10, including=False)) + sweep_add) & loud & (upper > wick)
        down = (F.col("low") < F.min("low").over(last(10, including=False)) - sweep_add) & loud & (lower > wick)
        move = F.col("close") - F.lag("close").over(by_chunk())
        busy = F.col("volume") > F.col("_median")
        state = (
            F.when(F.col("bar_no") < 30, "N").when(calm, "C").when(up, "SU").when(down, "SD")
            .when(move > MOVED * F.col("_atr50"), "DU").when(move < -MOVED * F.col("_atr50"), "DD")
            .when((F.col("close") > F.max("high").over(last(15, including=False))) & busy, "BU")
            .when((F.col("close") < F.min("low").over(last(15, including=False))) & busy, "BD").otherwise("N")
        )
        return b.withColumn("state", state).drop("_median")

    return windowed(smoothed_atr(bars, out="_atr50"), build, back=volume_n).drop("_atr50")


def window_state(bars: DataFrame, ties: str = "larger") -> DataFrame:
    """State of the five bars before: the first rule that enough of them meet.

    Two displacements or more go to the side that has more of them, up if equal. For single ones ``ties`` says whether the side that has more
    ('larger') or the upper side ('first') wins.
    """

    def build(b: DataFrame) -> DataFrame:
        n = {s: F.sum((F.col("state") == s).cast("int")).over(last(5, including=False)) for s in ("C", "SU", "SD", "DU", "DD")}
        moved = F.when(n["DU"] >= n["DD"], "DU").otherwise("DD")
        swept = F.when(n["SU"] >= n["SD"], "SU").otherwise("SD") if ties == "larger" else F.when(n["SU"] >= 1, "SU").otherwise("SD")
        state = F.when(F.greatest(n["DU"], n["DD"]) >= 2, moved)
        state = reduce(lambda c, s: c.when(n[s] >= 3, s), ("SU", "SD", "C"), state)
        return b.withColumn("window_state", state.when(n["DU"] + n["DD"] >= 1, moved).when(n["SU"] + n["SD"] >= 1, swept).otherwise("N"))

    return windowed(bars, build, back=5)


def pre_displacement(bars: DataFrame, within: int = 1) -> DataFrame:
    """pre_disp: one of the last ``within`` bars before was C and this stretch saw a sweep; flagged at the next bar."""

    def build(b: DataFrame) -> DataFrame:
        calm = F.max((F.col("state") == "C").cast("int")).over(last(within + 1)) == 1
        swept = F.col("state").isin("SU", "SD")
        b = b.withColumn("_hit", calm & swept)
        return b.withColumn("pre_disp", F.coalesce(F.lag("_hit").over(by_chunk()), F.lit(False))).drop("_hit")

    return windowed(bars, build, back=within + 2)


def opening_range(bars: DataFrame, start: int = 570, minutes: int = 30) -> DataFrame:
    """or_high, or_low and or_done of each New York day: the range of the window, shown once it has ended; in_or during it."""
    out = bars.withColumn("_ny", local("ts")).withColumn("_day", F.to_date("_ny"))
    minute = minute_of_day(F.col("_ny"))
    inside = (minute >= start) & (minute < start + minutes)
    day = out.where(inside).groupBy("symbol", "_day").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    out = out.join(day, ["symbol", "_day"], "left").withColumn("in_or", inside)
    done = (minute >= start + minutes) & F.col("_h").isNotNull()
    return out.withColumn("or_done", done).withColumn("or_high", F.when(done, F.col("_h"))).withColumn("or_low", F.when(done, F.col("_l"))).drop("_ny", "_day", "_h", "_l")


def period_bars(bars: DataFrame, unit: str, zone: str | None = None) -> DataFrame:
    """(symbol, period, open, high, low, close) of calendar days, weeks or months, in a zone if given."""
    when = local("ts", zone) if zone else F.col("ts")
    return bars.groupBy("symbol", F.date_trunc(unit, when).alias("period")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close")
    )


def previous_levels(bars: DataFrame, units: tuple[str, ...] = ("day", "week", "month")) -> DataFrame:
    """prev_{unit}_high and prev_{unit}_low: the extremes of the period before the bar's own."""
    by_symbol = Window.partitionBy("symbol").orderBy("period")
    for unit in units:
        of = period_bars(bars, unit)
        of = of.select("symbol", F.col("period").alias("_p"), F.lag("high").over(by_symbol).alias(f"prev_{unit}_high"), F.lag("low").over(by_symbol).alias(f"prev_{unit}_low"))
        bars = bars.withColumn("_p", F.date_trunc(unit, "ts")).join(of, ["symbol", "_p"], "left").drop("_p")
    return bars


def inside_day(bars: DataFrame, strict: bool = False) -> DataFrame:
    """inside_day, inside_high, inside_low, inside_break_up, inside_break_down.

    True on a day if the day before lies within the one before that; the outer day's extremes are the targets, and a close
    beyond the inner day's breaks out.
    """
    by_symbol = Window.partitionBy("symbol").orderBy("period")
    day = period_bars(bars, "day")
    for k in (1, 2):
        day = day.withColumn(f"_h{k}", F.lag("high", k).over(by_symbol)).withColumn(f"_l{k}", F.lag("low", k).over(by_symbol))
    within = (F.col("_h1") < F.col("_h2")) & (F.col("_l1") > F.col("_l2")) if strict else (F.col("_h1") <= F.col("_h2")) & (F.col("_l1") >= F.col("_l2"))
    day = day.select("symbol", F.col("period").alias("_p"), flag(within).alias("inside_day"), "_h1", "_l1", "_h2", "_l2")
    out = bars.withColumn("_p", F.date_trunc("day", "ts")).join(day, ["symbol", "_p"], "left")
    on = F.col("inside_day")
    out = out.withColumn("inside_high", F.when(on, F.col("_h2"))).withColumn("inside_low", F.when(on, F.col("_l2")))
    out = out.withColumn("inside_break_up", on & flag(F.col("close") > F.col("_h1"))).withColumn("inside_break_down", on & flag(F.col("close") < F.col("_l1")))
    return out.drop("_p", "_h1", "_l1", "_h2", "_l2")


def opening_gaps(bars: DataFrame, unit: str = "day", least: float = 0.0) -> DataFrame:
    """(symbol, period, gap_top, gap_bottom, gap_mid, gap_size, direction) between a period's open and the close before it."""
    by_symbol = Window.partitionBy("symbol").orderBy("period")
    p = period_bars(bars, unit).withColumn("_before", F.lag("close").over(by_symbol)).where("_before is not null")
    top, bottom = F.greatest("open", "_before"), F.least("open", "_before")
    out = p.select("symbol", "period", top.alias("gap_top"), bottom.alias("gap_bottom"), ((top + bottom) / 2).alias("gap_mid"), (top - bottom).alias("gap_size"), F.signum(F.col("open") - F.col("_before")).cast("int").alias("direction"))
    return out.where(F.col("gap_size") > least)


def settlements(bars: DataFrame, hour: int = 15, zone: str = CHICAGO) -> DataFrame:
    """Bars whose local hour first reaches ``hour`` that day; their close is the settlement (columns as of bars)."""
    clock = F.hour(local("ts", zone))

    def build(b: DataFrame) -> DataFrame:
        return b.withColumn("_cross", flag((clock >= hour) & (F.lag(clock).over(by_chunk()) < hour)))

    return windowed(bars, build, back=1).where("_cross").drop("_cross")


def zone_age(bars: DataFrame, birth: str, out: str = "zone_age") -> DataFrame:
    """Bars since the last birth; null before the first."""
    born = keyed(bars).withColumn("_born", F.when(F.col(birth), F.col("bar_no")))
    return carried(born, {"_last": "_born"}).withColumn(out, F.col("bar_no") - F.col("_last")).drop("_born", "_last")


def regime_masks(bars: DataFrame, n: int = 60, part: float = 0.2, history: int = 500, share: float = 0.66) -> DataFrame:
    """trending: the close lies in the outer ``part`` of the range of the n bars before; volatility: their deviation; high_volatility: it lies above the ``share``
    quantile of the volatilities of the ``history`` bars before."""

    def build(b: DataFrame) -> DataFrame:
        frame = last(n, including=False)
        lo, hi = F.min("low").over(frame), F.max("high").over(frame)
        place = F.try_divide(F.col("close") - lo, hi - lo)
        return b.withColumn("volatility", F.round(F.stddev_pop("close").over(frame), 9)).withColumn("trending", flag((place <= part) | (place >= 1 - part)))

    def above(b: DataFrame) -> DataFrame:
        return b.withColumn("high_volatility", flag(F.col("volatility") > F.percentile("volatility", F.lit(share)).over(last(history, including=False))))

    return windowed(windowed(bars, build, back=n), above, back=history)


def ou_half_life(bars: DataFrame, n: int = 60, max_half_life: float = 30.0, critical: float = -2.91) -> DataFrame:
    """Mean reversion by a rolling AR(1) of ``n`` closes: ou_half_life, ou_mean_level, ou_mean_rev_speed, null until n are there, and flags.

    ou_is_stationary: the t value of the slope of the moves over the levels lies below ``critical`` (5 % for a unit root). ou_bull_passes and
    ou_bear_passes: stationary, the half-life is at most ``max_half_life``, and the close lies below or above the mean.
    """

    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_x", F.lag("close").over(by_chunk())).withColumn("_d", F.col("close") - F.col("_x"))
        frame = last(n - 1)
        full = F.count("_d").over(frame) == n - 1
        b = b.withColumn("_vx", F.var_pop("_x").over(frame)).withColumn("_vd", F.var_pop("_d").over(frame)).withColumn("_c", F.covar_pop("_x", "_d").over(frame))
        b = b.withColumn("_b", F.when(full, F.try_divide("_c", "_vx"))).withColumn("_a", F.avg("_d").over(frame) - F.col("_b") * F.avg("_x").over(frame))
        rest = F.greatest(F.col("_vd") - F.col("_b") * F.col("_c"), F.lit(0.0)) / (n - 3)  # variance of the residuals, times n - 1, by their freedom
        return b.withColumn("_t", F.try_divide("_b", F.sqrt(F.try_divide(rest, F.col("_vx"))))).drop("_d", "_x", "_vx", "_vd", "_c")

    out = windowed(bars, build, back=n + 1)
    back = (F.col("_b") < 0) & (F.col("_b") > -1)
    out = out.withColumn("ou_mean_rev_speed", -F.col("_b")).withColumn("ou_mean_level", F.when(F.col("_b") < 0, -F.col("_a") / F.col("_b")))
    out = out.withColumn("ou_half_life", F.when(back, F.lit(-0.6931471805599453) / F.log1p("_b"))).withColumn("ou_is_stationary", flag((F.col("_b") < 0) & (F.col("_t") < critical)))
    fast = F.col("ou_is_stationary") & (F.col("ou_half_life") <= max_half_life)
    out = out.withColumn("ou_bull_passes", flag(fast & (F.col("close") < F.col("ou_mean_level")))).withColumn("ou_bear_passes", flag(fast & (F.col("close") > F.col("ou_mean_level"))))
    return out.drop("_a", "_b", "_t")


def _body() -> Column:
    """Signed share of the body in the range of a bar; 0 without a range."""
    span = F.col("high") - F.col("low")
    return F.coalesce((F.col("close") - F.col("open")) / F.when(span > 0, span), F.lit(0.0))


def hawkes_decay(bars: DataFrame, half_life: int = 5, least: float = 0.1, body: float = 0.25, counter: int = 3) -> DataFrame:
    """Excitation by strong bodies of either side that fades by half in ``half_life`` bars: hawkes_{side}_excitation, _active, _passes and hawkes_decay_{side}.

    Bodies below ``body`` of the range (dojis) excite nothing. A side is active from ``least`` on, decays once the last ``counter`` bars all
    close against it, and passes while it is active and does not decay.
    """
    sides = (("bull", 1), ("bear", -1))

    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_body", _body())
        for side, sign in sides:
            against = F.sum((F.col("_body") * sign < 0).cast("int")).over(last(counter))
            b = b.withColumn(f"_{side}_push", F.when(F.col("_body") * sign >= body, F.abs("_body")).otherwise(0.0)).withColumn(f"hawkes_decay_{side}", flag(against == counter))
        return b.drop("_body")

    out = recursion(windowed(bars, build, back=counter), {f"hawkes_{side}_excitation": f"_{side}_push" for side in SIDES}, 0.5 ** (1 / half_life))
    for side in SIDES:
        out = out.withColumn(f"hawkes_{side}_active", F.col(f"hawkes_{side}_excitation") >= least)
        out = out.withColumn(f"hawkes_{side}_passes", F.col(f"hawkes_{side}_active") & ~F.col(f"hawkes_decay_{side}"))
    return out.drop("_bull_push", "_bear_push")


def order_flow(bars: DataFrame, fast: int = 3, times: int = 5, least: float = 0.0, by_volume: bool = False) -> DataFrame:
    """Imbalance by signed bodies: ofi_raw, ofi_fast, ofi_slow (null until the window of ``times`` * ``fast`` bars is full), ofi_signal (-1, 0, 1) and passes.

    ``by_volume``: bodies weigh by volume over its mean in the slow window. A side passes if both means lie on it by more than ``least``.
    """
    slow = fast * times

    def build(b: DataFrame) -> DataFrame:
        weight = F.coalesce(F.try_divide(F.col("volume"), F.avg("volume").over(last(slow))), F.lit(1.0)) if by_volume else F.lit(1.0)
        b = b.withColumn("ofi_raw", _body() * weight)
        b = b.withColumn("ofi_fast", F.when(F.count("ofi_raw").over(last(fast)) == fast, F.avg("ofi_raw").over(last(fast))))
        return b.withColumn("ofi_slow", F.when(F.count("ofi_raw").over(last(slow)) == slow, F.avg("ofi_raw").over(last(slow))))

    out = windowed(bars, build, back=2 * slow)
    up, down = flag(F.least("ofi_fast", "ofi_slow") > least) & F.col("ofi_slow").isNotNull(), flag(F.greatest("ofi_fast", "ofi_slow") < -least) & F.col("ofi_slow").isNotNull()
    out = out.withColumn("ofi_bull_passes", up).withColumn("ofi_bear_passes", down)
    return out.withColumn("ofi_signal", F.when(F.col("ofi_bull_passes"), 1).when(F.col("ofi_bear_passes"), -1).otherwise(0))
