"""Patterns built from several signals: components, proximity flags, bounces, order blocks, aligned frames, zone entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import keyed
from .chains import ARROW, chained
from .frames import by_chunk, carried, flag, last, windowed
from .joins import carry_higher_frame
from .signals import efficiency_ratio, fair_value_gap, opening_gaps, previous_levels, settlements, smoothed_atr, zone_age
from .zones import _runs, episodes

COMPONENTS = ("only_compression", "only_sweep", "only_rejection", "compression_sweep", "full", "chain", "full_chain")
#: Fixed value: the chain of states that the component study looks for.
CHAIN = ARROW.join(("SU", "SU", "DD"))


def component_flags(bars: DataFrame, compress: float = 0.5, floor: float = 1.5, sweep_add: float = 1.5, sweep_volume: float = 1.5, wick: float = 0.35) -> DataFrame:
    """COMPONENTS as flags at the bar after; ``bars`` has ``state``.

    Compression: the five ranges before average below half a smoothed ATR (``floor`` points at least). Sweep: beyond the
    ten bars before on high volume. Rejection: the close has left the swept end by ``wick`` of the range; it needs a
    sweep, so only_rejection never holds. ``chain``: the three states before are CHAIN.
    """

    def build(b: DataFrame) -> DataFrame:
        span = F.col("high") - F.col("low")
        b = b.withColumn("_median", F.percentile("volume", F.lit(0.5)).over(last(100, including=False)))
        ready, loud = F.col("bar_no") >= 30, F.col("volume") > sweep_volume * F.col("_median")
        calm = F.col("_atr50").isNotNull() & (F.avg(span).over(last(5, including=False)) < F.greatest(compress * F.col("_atr50"), F.lit(floor)))
        up = (F.col("high") > F.max("high").over(last(10, including=False)) + sweep_add) & loud
        down = (F.col("low") < F.min("low").over(last(10, including=False)) - sweep_add) & loud
        width = F.when(span > 0, span)
        back = (flag(up) & ((F.col("high") - F.col("close")) / width > wick)) | (flag(down) & ((F.col("close") - F.col("low")) / width > wick))
        b = b.withColumn("_c", flag(ready & calm)).withColumn("_s", flag(ready & (flag(up) | flag(down)))).withColumn("_r", flag(ready & back))
        return b.drop("_median")

    b = windowed(smoothed_atr(bars, out="_atr50"), build, back=100)
    c, s, r = F.col("_c"), F.col("_s"), F.col("_r")
    now = {"only_compression": c & ~s, "only_sweep": s & ~c & ~r, "only_rejection": r & ~s & ~c, "compression_sweep": c & s & ~r, "full": c & s & r}
    before = lambda x: flag(F.lag(x).over(by_chunk()))
    b = windowed(b, lambda x: x.select("*", *[before(v).alias(n) for n, v in now.items()]), back=1).drop("_c", "_s", "_r", "_atr50")
    b = chained(b).withColumn("chain", flag(F.col("chain_3") == CHAIN)).drop("chain_1", "chain_2", "chain_3")
    return b.withColumn("full_chain", F.col("full") & F.col("chain"))


def proximity_flags(bars: DataFrame, day_bars: int = 24, wide: float = 20.0, near: float = 15.0, close_by: float = 10.0, settle_bars: int = 15, gap_bars: int = 30, zone_age_max: int = 15) -> DataFrame:
    """Flags of the close's place: near_24h, near_day, near_week, near_settlement, in_opening_gap, in_gap_zone.

    Extremes are those of the ``day_bars`` bars before and of the previous day and week, so none looks ahead. The last settlement
    counts for ``settle_bars`` bars, an opening gap of more than ``close_by`` points for the first ``gap_bars`` bars of its
    day, a gap zone until ``zone_age_max`` bars after its birth.
    """
    bars = keyed(bars)
    px = F.col("close")
    within = lambda c, d: F.abs(px - F.col(c)) <= d
    b = windowed(bars, lambda x: x.withColumn("_hi", F.max("high").over(last(day_bars, including=False))).withColumn("_lo", F.min("low").over(last(day_bars, including=False))), back=day_bars)
    b = previous_levels(b, ("day", "week"))
    settled = settlements(bars).select("symbol", "bar_no", F.struct(F.col("close").alias("price"), F.col("bar_no").alias("no")).alias("_settled"))
    b = carried(b.join(settled, ["symbol", "bar_no"], "left"), {"_last_settled": "_settled"})
    gaps = opening_gaps(bars).select("symbol", F.col("period").alias("_day"), "gap_top", "gap_bottom", "gap_size")
    first = bars.groupBy("symbol", F.date_trunc("day", "ts").alias("_day")).agg(F.min("bar_no").alias("_first"))
    b = b.withColumn("_day", F.date_trunc("day", "ts")).join(first.join(gaps, ["symbol", "_day"]), ["symbol", "_day"], "left")
    zones = zone_age(fair_value_gap(bars), "fvg_bull").select(
        "symbol", "bar_no", flag(F.col("fvg_bull_active") & (F.col("zone_age") <= zone_age_max) & px.between(F.col("fvg_bull_low"), F.col("fvg_bull_high"))).alias("in_gap_zone")
    )
    b = b.join(zones, ["symbol", "bar_no"])
    in_gap = (F.col("gap_size") > close_by) & (F.col("bar_no") - F.col("_first") < gap_bars) & px.between(F.col("gap_bottom"), F.col("gap_top"))
    b = (
        b.withColumn("near_24h", flag(within("_hi", wide)) | flag(within("_lo", wide)))
        .withColumn("near_day", flag(within("prev_day_high", near)) | flag(within("prev_day_low", near)))
        .withColumn("near_week", flag(within("prev_week_high", near)) | flag(within("prev_week_low", near)))
        .withColumn("near_settlement", flag((F.col("bar_no") - F.col("_last_settled.no") <= settle_bars) & within("_last_settled.price", close_by)))
        .withColumn("in_opening_gap", flag(in_gap))
    )
    extra = ["prev_day_high", "prev_day_low", "prev_week_high", "prev_week_low", "gap_top", "gap_bottom", "gap_size"]
    return b.drop("_hi", "_lo", "_settled", "_last_settled", "_day", "_first", *extra)


def gap_level_bounce(bars: DataFrame, keep: int = 5, tolerance: float = 2.0) -> DataFrame:
    """bounce_level, bounce_bull, bounce_bear: levels lie halfway between neighbouring opening gaps.

    The last ``keep`` gaps are sorted by their middle; a level is the mean of one gap's top and the next one's bottom, and the
    nearest to the close counts (the lower one if two are). Bull: the low comes within ``tolerance`` (inclusive) and the
    close lies above. Needs two gaps; days that open without a gap have no level.
    """
    recent = Window.partitionBy("symbol").orderBy("period").rowsBetween(1 - keep, 0)
    g = opening_gaps(bars).withColumn("_g", F.array_sort(F.collect_list(F.struct(F.col("gap_mid").alias("mid"), F.col("gap_top").alias("top"), F.col("gap_bottom").alias("bottom"))).over(recent)))
    levels = F.expr("IF(size(_g) > 1, transform(sequence(0, size(_g) - 2), i -> (_g[i].top + _g[i + 1].bottom) / 2), cast(array() AS array<double>))")
    g = g.select("symbol", F.col("period").alias("_day"), levels.alias("_levels"))
    b = bars.withColumn("_day", F.date_trunc("day", "ts")).join(g, ["symbol", "_day"], "left")
    nearest = F.array_min(F.transform("_levels", lambda x: F.struct(F.abs(x - F.col("close")).alias("d"), x.alias("x"))))
    b = b.withColumn("bounce_level", nearest["x"]).drop("_day", "_levels")
    level, px = F.col("bounce_level"), F.col("close")
    return b.withColumn("bounce_bull", flag((F.col("low") <= level + tolerance) & (px > level))).withColumn("bounce_bear", flag((F.col("high") >= level - tolerance) & (px < level)))


def order_blocks(bars: DataFrame, low_level: str, high_level: str, distance: float = 5.0, body_share: float = 0.40) -> DataFrame:
    """ob_bull, ob_bear and the last block of the day so far: ob_high, ob_low (bodies only), ob_mid.

    A bull block is a falling bar with a body of ``body_share`` of its range or more, just before a three-bar swing low within
    ``distance`` of ``low_level``; it is known one bar after the swing. Bear blocks mirror this. Blocks end with the day.
    """

    def build(b: DataFrame) -> DataFrame:
        at = lambda c, k: F.lag(c, k).over(by_chunk())
        body = at("close", 2) - at("open", 2)
        span = at("high", 2) - at("low", 2)
        firm = F.abs(body) / F.when(span > 0, span) >= body_share
        low = (at("low", 1) < at("low", 2)) & (at("low", 1) < F.col("low")) & (F.abs(at("low", 1) - F.col(low_level)) <= distance)
        high = (at("high", 1) > at("high", 2)) & (at("high", 1) > F.col("high")) & (F.abs(at("high", 1) - F.col(high_level)) <= distance)
        b = b.withColumn("ob_bull", flag(firm & (body < 0) & low)).withColumn("ob_bear", flag(firm & (body > 0) & high))
        zone = F.struct(F.greatest(at("open", 2), at("close", 2)).alias("high"), F.least(at("open", 2), at("close", 2)).alias("low"))
        return b.withColumn("_zone", F.when(F.col("ob_bull") | F.col("ob_bear"), zone))

    day = Window.partitionBy("symbol", "_day").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    b = windowed(bars, build, back=2).withColumn("_day", F.date_trunc("day", "ts")).withColumn("_zone", F.last("_zone", ignorenulls=True).over(day))
    b = b.withColumn("ob_high", F.col("_zone.high")).withColumn("ob_low", F.col("_zone.low")).withColumn("ob_mid", (F.col("_zone.high") + F.col("_zone.low")) / 2)
    return b.drop("_zone", "_day")


def frame_alignment(bars: DataFrame, higher: DataFrame, seconds: int, depths: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """mtf_active, mtf_direction (-1, 0, 1), mtf_depth (0..1), mtf_strength (zone size over the close, in per cent), mtf_passes.

    Gap zones of the last closed bar of the higher frame; an active bull zone goes before a bear zone. Depth is how far the close
    has come into the zone; it passes within ``depths``. Zones need three bars of the higher frame.
    """
    z = fair_value_gap(keyed(higher))
    names = [f"fvg_{s}_{c}" for s in ("bull", "bear") for c in ("active", "high", "low")]
    b = carry_higher_frame(bars, z.select("symbol", "ts", *names), names, seconds)
    bull, bear = flag(F.col("fvg_bull_active")), flag(F.col("fvg_bear_active"))
    top, bottom = (F.when(bull, F.col(f"fvg_bull_{c}")).when(bear, F.col(f"fvg_bear_{c}")) for c in ("high", "low"))
    width = F.when(top > bottom, top - bottom)
    into = F.when(bull, (top - F.col("close")) / width).otherwise((F.col("close") - bottom) / width)
    b = b.withColumn("mtf_active", bull | bear).withColumn("mtf_direction", F.when(bull, 1).when(bear, -1).otherwise(0))
    b = b.withColumn("mtf_depth", F.coalesce(F.least(F.greatest(into, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    b = b.withColumn("mtf_strength", F.coalesce(width / F.when(F.col("close") > 0, F.col("close")) * 100, F.lit(0.0)))
    return b.withColumn("mtf_passes", F.col("mtf_active") & F.col("mtf_depth").between(*depths)).drop(*names)


def regime_gate(bars: DataFrame, n: int = 20, least: float = 0.3) -> DataFrame:
    """regime_gate: the efficiency ratio of ``n`` bars is at least ``least``; false until the window is full."""
    return efficiency_ratio(bars, n, "_ker").withColumn("regime_gate", flag(F.col("_ker") >= least)).drop("_ker")


def zone_entries(zones: DataFrame) -> DataFrame:
    """Per zone the bars of three entries: touch_no (first touch), disp_no (first flagged bar in the zone; ``zones`` has context
    for it) and half_no (second visit that reaches the middle)."""
    key = ["symbol", "side", "zone_id"]
    later = zones.where("bar_no > born_no").withColumn("inside", flag((F.col("lo") <= F.col("entry")) & (F.col("hi") >= F.col("far"))))
    strong = later.where(F.col("inside") & flag(F.col("context"))).groupBy(*key).agg(F.min("bar_no").alias("disp_no"))
    half = _runs(later).where((F.col("run") == 2) & (F.col("lo") <= (F.col("entry") + F.col("far")) / 2)).groupBy(*key).agg(F.min("bar_no").alias("half_no"))
    return episodes(zones).select(*key, "born_no", "touch_no").join(strong, key, "left").join(half, key, "left")


def rescaled_range(x: np.ndarray, longest: int) -> float | None:
    """Hurst exponent: slope of log(mean R/S) over log(length) for lengths from 8 up in steps of a quarter octave; None if undefined."""
    sizes, values = [], []
    for n in np.unique(np.round(8 * 2 ** (np.arange(64) / 4)).astype(int)):
        if n > min(longest, len(x) // 2):
            break
        parts = x[: len(x) // n * n].reshape(-1, n)
        path = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        spread, deviation = path.max(axis=1) - path.min(axis=1), parts.std(axis=1, ddof=1)
        if (deviation > 0).any():
            sizes.append(n)
            values.append((spread[deviation > 0] / deviation[deviation > 0]).mean())
    return float(np.polyfit(np.log(sizes), np.log(values), 1)[0]) if len(sizes) > 2 and min(values) > 0 else None


def range_hurst(bars: DataFrame, size: int = 256, step: int = 200, longest: int = 128) -> DataFrame:
    """(symbol, window, n, hurst, dimension) of the close-to-close moves in overlapping windows; each is one small group."""
    moves = windowed(bars, lambda b: b.withColumn("move", F.col("close") - F.lag("close").over(by_chunk())), back=1).where("move is not null")
    first = F.expr(f"greatest(0L, (bar_no - {size}) div {step} + IF(bar_no >= {size}, 1, 0))")
    rows = moves.select("symbol", "bar_no", "move", F.explode(F.sequence(first, F.expr(f"bar_no div {step}"))).alias("window"))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        h = rescaled_range(group.sort_values("bar_no")["move"].to_numpy(), longest)
        return pd.DataFrame([(group["symbol"].iloc[0], int(group["window"].iloc[0]), len(group), h)], columns=["symbol", "window", "n", "hurst"])

    out = rows.groupBy("symbol", "window").applyInPandas(measure, "symbol string, window long, n long, hurst double")
    return out.where(f"n >= {size - 1}").withColumn("dimension", 2 - F.col("hurst"))
