"""Zone episodes and what becomes of them.

Both sides are handled in one coordinate: prices of bear zones are negated, so for either side price enters a zone from above
through ``entry`` and breaks it at ``far``. An episode is the birth bar and all bars up to the side's next birth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import local, session_map
from .frames import carried, flag
from .joins import asof, forward_join
from .signals import SIDES

HORIZONS = (15, 30, 60, 120)


def zone_bars(bars: DataFrame, prefix: str = "fvg", context: str | None = None) -> DataFrame:
    """Bars after the birth of a zone, per side: symbol, side, zone_id, bar_no, ts, born_no, born_ts, entry, far, lo, hi, px (close).

    ``bars`` has the birth flags, the number of zones so far and the last zone ({prefix}_bull_zone: born, ts, high, low) of ``prefix``, so this moves no rows; where there is no such
    column, zones are carried along from the bounds at their birth, chunk by chunk. ``context`` is one more flag to carry.
    """
    if f"{prefix}_bull_zone" not in bars.columns:
        born = {f"_{side}_born": F.when(F.col(f"{prefix}_{side}"), F.struct(F.col("bar_no").alias("born"), "ts", F.col(f"{prefix}_{side}_high").alias("high"), F.col(f"{prefix}_{side}_low").alias("low"))) for side in SIDES}
        bars = carried(bars.withColumns(born), {f"{prefix}_{side}_zone": f"_{side}_born" for side in SIDES})
    sides = []
    for side, sign, up, down in (("bull", 1, "high", "low"), ("bear", -1, "low", "high")):
        name = f"{prefix}_{side}"
        sides.append(F.struct(
            F.lit(side).alias("side"), F.col(f"{name}_id").alias("zone_id"), (F.col(down) * sign).alias("lo"), (F.col(up) * sign).alias("hi"), (F.col("close") * sign).alias("px"),
            F.col(name).alias("birth"), F.col(f"{name}_zone.born").alias("born_no"), F.col(f"{name}_zone.ts").alias("born_ts"), (F.col(f"{name}_zone")[up] * sign).alias("entry"), (F.col(f"{name}_zone")[down] * sign).alias("far"),
        ))
    kept = ["symbol", "bar_no", "chunk", "chunk_len", "ts", *([F.col(context).alias("context")] if context else [])]
    return bars.select(*kept, F.inline(F.array(*sides))).where("born_no is not null")


def episodes(zones: DataFrame) -> DataFrame:
    """One row per zone: bounds, birth, touch_no, fill_no, fill_ts, deepest (lowest price up to the fill bar) and any context."""
    later = F.col("bar_no") > F.col("born_no")
    fill = later & (F.col("lo") <= F.col("far"))
    out = zones.groupBy("symbol", "side", "zone_id").agg(
        F.first("entry").alias("entry"), F.first("far").alias("far"), F.first("born_no").alias("born_no"), F.first("born_ts").alias("born_ts"),
        F.min(F.when(later & (F.col("lo") <= F.col("entry")), F.col("bar_no"))).alias("touch_no"),
        F.min(F.when(fill, F.col("bar_no"))).alias("fill_no"), F.min(F.when(fill, F.col("ts"))).alias("fill_ts"),
        F.min_by("lo", F.when(fill, F.col("bar_no"))).alias("_at_fill"), F.min(F.when(later, F.col("lo"))).alias("_lowest"),
        *([F.max("context").alias("context")] if "context" in zones.columns else []),
    )
    return out.withColumn("deepest", F.when(F.col("fill_no").isNotNull(), F.col("_at_fill")).otherwise(F.col("_lowest"))).drop("_at_fill", "_lowest")


def outcomes(zones: DataFrame) -> DataFrame:
    """Per symbol and side: zones, no_touch, touches, bounce, through, depth of penetration in points and per cent, and its bands."""
    e = episodes(zones).withColumn("depth", F.when(F.col("touch_no").isNotNull(), F.col("entry") - F.col("deepest")))
    e = e.withColumn("pct", F.col("depth") / F.when(F.col("entry") > F.col("far"), F.col("entry") - F.col("far")) * 100)
    touched, filled = F.col("touch_no").isNotNull(), F.col("fill_no").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return e.groupBy("symbol", "side").agg(
        F.count("*").alias("zones"), n(~touched).alias("no_touch"), n(touched).alias("touches"), n(touched & ~filled).alias("bounce"), n(touched & filled).alias("through"),
        F.round(F.median("depth"), 6).alias("depth_median"), F.round(F.median("pct"), 6).alias("pct_median"),
        n(F.col("pct") < 25).alias("below_25"), n((F.col("pct") >= 25) & (F.col("pct") < 50)).alias("below_50"),
        n((F.col("pct") >= 50) & (F.col("pct") < 75)).alias("below_75"), n((F.col("pct") >= 75) & (F.col("pct") < 100)).alias("below_100"), n(F.col("pct") >= 100).alias("beyond"),
    )


def gap_outcomes(bars: DataFrame) -> DataFrame:
    """``outcomes`` of the gap zones (prefix ``fvg``) of bars that have them."""
    return outcomes(zone_bars(bars))


def returns(zones: DataFrame, bars: DataFrame, horizon: int = 120) -> DataFrame:
    """Episodes with ``back_after``: bars from the fill bar until price is back at the far edge (null: not within ``horizon``),
    and ``excursion``: how far price went beyond the far edge from the fill bar until then."""
    e = episodes(zones)
    filled = e.where("fill_no is not null").select("symbol", "side", "zone_id", "far", "fill_no")
    steps = forward_join(filled, bars, horizon, ["high", "low"], at="fill_no", including=True)
    bull = F.col("side") == "bull"
    step = F.struct("step", F.when(bull, F.col("high")).otherwise(-F.col("low")).alias("hi"), (F.col("far") - F.when(bull, F.col("low")).otherwise(-F.col("high"))).alias("beyond"))
    path = steps.groupBy("symbol", "side", "zone_id").agg(F.first("far").alias("far"), F.collect_list(step).alias("p"))  # as long as the horizon
    back = F.array_min(F.transform(F.filter("p", lambda s: (s["step"] > 0) & (s["hi"] >= F.col("far"))), lambda s: s["step"]))
    path = path.select("symbol", "side", "zone_id", back.alias("back_after"), "p")
    far = path.select("symbol", "side", "zone_id", "back_after", F.array_max(F.transform(F.filter("p", lambda s: F.col("back_after").isNull() | (s["step"] <= F.col("back_after"))), lambda s: s["beyond"])).alias("excursion"))
    return e.join(far, ["symbol", "side", "zone_id"], "left")


def return_shares(zones: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Per symbol and side: broken zones and how many of them price came back to within each horizon."""
    r = returns(zones, bars, max(horizons)).where("fill_no is not null")
    return r.groupBy("symbol", "side").agg(F.count("*").alias("through"), *[F.count(F.when(F.col("back_after") <= h, 1)).alias(f"back_{h}") for h in horizons])


def break_class(back_after: str = "back_after", within: int = 60) -> Column:
    """hold (never filled), fakeout (back within the window) or break."""
    return F.when(F.col("fill_no").isNull(), "hold").when(F.col(back_after) <= within, "fakeout").otherwise("break")


def break_profile(zones: DataFrame, bars: DataFrame, by: str = "hour", within: int = 60) -> DataFrame:
    """Zones per symbol, side, class and ``by``: New York hour (of the birth for holds, else of the fill), birth session, or context."""
    r = returns(zones, bars, max(within, 1)).withColumn("class", break_class(within=within))
    if by == "hour":
        key = F.hour(local(F.coalesce("fill_ts", "born_ts")))
    elif by == "session":
        key = session_map(local("born_ts"), "seven")
    else:
        key = F.col("context").cast("int")
    return r.groupBy("symbol", "side", "class", key.alias(by)).agg(F.count("*").alias("zones"))


def break_duration(zones: DataFrame, bars: DataFrame, horizon: int = 120) -> DataFrame:
    """Broken zones per symbol, side and band of bars until price is back; 'out' if it is not within the horizon."""
    r = returns(zones, bars, horizon).where("fill_no is not null")
    d = F.col("back_after")
    band = F.when(d.isNull(), "out").when(d <= 5, "1-5").when(d <= 15, "6-15").when(d <= 30, "16-30").when(d <= 60, "31-60").otherwise("61-120")
    return r.groupBy("symbol", "side", band.alias("band")).agg(F.count("*").alias("zones"), F.median("back_after").cast("int").alias("median_bars"))


def bounce_depth(zones: DataFrame) -> DataFrame:
    """Depth of zones that were touched but never filled, in per cent of the zone (100 at most), per symbol, side and band."""
    e = episodes(zones).where("touch_no is not null and fill_no is null and entry > far")
    pct = F.least(F.lit(100.0), (F.col("entry") - F.col("deepest")) / (F.col("entry") - F.col("far")) * 100)
    e = e.withColumn("pct", pct).where("pct > 0")
    band = F.when(F.col("pct") <= 10, "0-10").when(F.col("pct") <= 25, "10-25").when(F.col("pct") <= 50, "25-50").when(F.col("pct") <= 75, "50-75").otherwise("75-100")
    return e.groupBy("symbol", "side", band.alias("band")).agg(F.count("*").alias("zones"), F.round(F.median("pct"), 6).alias("pct_median"))


def excursions(zones: DataFrame, bars: DataFrame, horizon: int = 120) -> DataFrame:
    """Quantiles of the excursion beyond the far edge of the zones that price came back to."""
    r = returns(zones, bars, horizon).where("back_after is not null")
    q = F.percentile("excursion", F.array(*map(F.lit, (0.5, 0.75, 0.8, 0.9))))
    out = r.groupBy("symbol", "side").agg(F.count("*").alias("zones"), q.alias("q"))
    return out.select("symbol", "side", "zones", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p75", "p80", "p90"))])


def visits(zones: DataFrame, most: int = 3) -> DataFrame:
    """Runs of bars in touch with the zone, per episode: visit, first_no, last_no, bars and result.

    The first bar after a run decides: above the zone bounce, below break, inside or no bar unclear.
    """
    later = zones.where("bar_no > born_no").withColumn("inside", flag((F.col("lo") <= F.col("entry")) & (F.col("hi") >= F.col("far"))))
    # within an episode bars follow each other, so a run's bars minus their rank among the run's bars is constant
    runs = _runs(later)
    ends = runs.groupBy("symbol", "side", "zone_id", "run").agg(F.min("bar_no").alias("first_no"), F.max("bar_no").alias("last_no"), F.count("*").alias("bars"), F.first("entry").alias("entry"), F.first("far").alias("far"))
    after = later.select("symbol", "side", "zone_id", (F.col("bar_no") - 1).alias("last_no"), F.col("px").alias("_next"))
    out = ends.join(after, ["symbol", "side", "zone_id", "last_no"], "left")
    result = F.when(F.col("_next") > F.col("entry"), "bounce").when(F.col("_next") < F.col("far"), "break").otherwise("unclear")
    return out.withColumn("visit", F.col("run")).withColumn("result", result).where(F.col("visit") <= most).drop("run", "_next", "entry", "far")


def _runs(later: DataFrame) -> DataFrame:
    """Bars inside a zone with ``run``, the number of their run within the episode."""
    key = ["symbol", "side", "zone_id"]
    inside = later.where("inside")
    before = inside.select(*key, (F.col("bar_no") + 1).alias("bar_no"), F.lit(True).alias("_was"))
    starts = inside.join(before, [*key, "bar_no"], "left").withColumn("_start", F.when(F.col("_was").isNull(), 1).otherwise(0))
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    left = starts.groupBy(*key, "chunk").agg(F.sum("_start").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    order = Window.partitionBy(*key, "chunk").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn("_within", F.sum("_start").over(order)).join(left, [*key, "chunk"]).withColumn("run", F.col("_before") + F.col("_within")).drop("_was", "_start", "_before", "_within")


def visit_summary(zones: DataFrame, most: int = 3) -> DataFrame:
    v = visits(zones, most)
    return v.groupBy("symbol", "side", "visit", "result").agg(F.count("*").alias("n"), F.sum("bars").alias("bars"))


def mid_touches(bars: DataFrame, prefix: str = "fvg", *extra: str) -> DataFrame:
    """First bar after its birth that holds the middle of an active zone, per side: symbol, side, zone_id, bar_no, ts, close, mid, zone_high, zone_low, held, the
    other side's active zone at that bar (other_high, other_low) and ``extra`` columns of the bar.

    ``held``: the close lies on the far side of the middle (below it for bull zones, above it for bear zones), which the original counts as a bounce.
    """
    sides = []
    for side, other in (("bull", "bear"), ("bear", "bull")):
        sides.append(F.struct(
            F.lit(side).alias("side"), F.col(f"{prefix}_{side}_id").alias("zone_id"), F.col(f"{prefix}_{side}").alias("birth"), F.col(f"{prefix}_{side}_mid").alias("mid"),
            F.col(f"{prefix}_{side}_high").alias("zone_high"), F.col(f"{prefix}_{side}_low").alias("zone_low"), F.col(f"{prefix}_{other}_high").alias("other_high"), F.col(f"{prefix}_{other}_low").alias("other_low"),
        ))
    every = bars.select("symbol", "bar_no", "ts", "low", "high", "close", *extra, F.inline(F.array(*sides)))
    hits = every.where(~F.col("birth") & flag((F.col("low") <= F.col("mid")) & (F.col("high") >= F.col("mid"))))
    kept = ["bar_no", "ts", "close", "mid", "zone_high", "zone_low", "other_high", "other_low", *extra]
    first = hits.groupBy("symbol", "side", "zone_id").agg(F.min_by(F.struct(*kept), "bar_no").alias("t")).select("symbol", "side", "zone_id", "t.*")
    return first.withColumn("held", F.when(F.col("side") == "bull", F.col("close") < F.col("mid")).otherwise(F.col("close") > F.col("mid")))


def _held(touches: DataFrame, by: Column, name: str) -> DataFrame:
    return touches.groupBy("symbol", "side", by.cast("int").alias(name)).agg(F.count("*").alias("touches"), F.count_if("held").alias("bounce"), F.count_if(~F.col("held")).alias("through"))


def overlap_outcomes(bars: DataFrame, prefix: str = "fvg") -> DataFrame:
    """At the first touch of each zone's middle, per side: does the other side's active zone overlap it; touches, bounces and the rest. A zone of the same side can't, there is one at a time."""
    over = flag((F.col("zone_high") >= F.col("other_low")) & (F.col("other_high") >= F.col("zone_low")))
    return _held(mid_touches(bars, prefix), over, "overlap")


def near_level(bars: DataFrame, level: str, prefix: str = "fvg", distance: float = 20.0) -> DataFrame:
    """First touch of each active zone's middle, per side: touches near (``distance`` at most) and away from a level, bounces and the rest."""
    return _held(mid_touches(bars, prefix, level), flag(F.abs(F.col(level) - F.col("mid")) <= distance), "near")


def nested_zones(lower: DataFrame, higher: DataFrame, prefix: str = "fvg", nesting: str = "contained") -> DataFrame:
    """First touches of the middles of the higher frame's zones, per side: is a zone of the same side active in the lower frame at its first bar at or after the touch's time, and contained in
    the touched one (``nesting`` 'overlap': or overlapping it); touches, bounces and the rest."""
    bounds = [f"{prefix}_{side}_{edge}" for side in ("bull", "bear") for edge in ("high", "low")]
    touches = mid_touches(higher, prefix).select("symbol", "ts", "side", "zone_high", "zone_low", "held")
    met = asof(touches, lower.select("symbol", "ts", *bounds), bounds, forward=True)
    bull = F.col("side") == "bull"
    high, low = (F.when(bull, F.col(f"{prefix}_bull_{edge}")).otherwise(F.col(f"{prefix}_bear_{edge}")) for edge in ("high", "low"))
    inside = (F.col("zone_low") <= low) & (high <= F.col("zone_high"))
    over = (F.col("zone_high") >= low) & (high >= F.col("zone_low"))
    return _held(met, flag({"contained": inside, "overlap": over}[nesting]), "nested")


def visit_durations(zones: DataFrame, most: int = 4, within: int = 120) -> DataFrame:
    """Per symbol, side and visit: number, median bars inside, median bars outside before it (first: 0), exits by result, and of those that
    break how many are touched again within ``within`` bars of the episode."""
    order = Window.partitionBy("symbol", "side", "zone_id").orderBy("visit")
    v = visits(zones, most + 1).withColumn("_outside", F.coalesce(F.col("first_no") - F.lag("last_no").over(order) - 1, F.lit(0)))
    v = v.withColumn("_again", F.lead("first_no").over(order) - F.col("last_no")).where(F.col("visit") <= most)
    broke = F.col("result") == "break"
    return v.groupBy("symbol", "side", "visit").agg(
        F.count("*").alias("n"), F.median("bars").alias("inside"), F.median("_outside").alias("outside"),
        *[F.count_if(F.col("result") == r).alias(r) for r in ("bounce", "break", "unclear")], F.count_if(broke & flag(F.col("_again") <= within)).alias("touched_again"),
    )
