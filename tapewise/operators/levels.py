"""Price levels: touch episodes, bounces, distances and what follows a fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import CHICAGO, local, session_map, trading_weekday
from ..sources.store import stage
from .frames import by_chunk, windowed
from .joins import forward_join


def level_rows(bars: DataFrame, levels: list[str]) -> DataFrame:
    """Bars x levels in long form: symbol, level, price, and the bar; rows without a price are dropped."""
    names = ", ".join(f"'{c}', `{c}`" for c in levels)
    keep = ["symbol", "bar_no", "chunk", "chunk_len", "ts", "high", "low", "close", "_before"]
    with_before = windowed(bars, lambda b: b.withColumn("_before", F.lag("close").over(by_chunk())), back=1)
    long = with_before.select(*keep, F.expr(f"stack({len(levels)}, {names}) AS (level, price)"))
    return long.where("price is not null")


def touches(bars: DataFrame, levels: list[str], threshold: float = 0.0) -> DataFrame:
    """First touch of each level episode (stretch of an unchanged price): symbol, level, price, bar_no, ts, side, bounced, wick.

    A bar touches if its range, widened by ``threshold``, holds the price. ``side``: where price came from, by the close
    before (on a level's first bar by whether the low is at or above it). ``bounced``: the bar closes back on that side.
    ``wick``: how far it went through the level.
    """
    long = stage(level_rows(bars, levels), "levels")
    was = long.select("symbol", "level", (F.col("bar_no") + 1).alias("bar_no"), F.col("price").alias("_was"))
    long = long.join(was, ["symbol", "level", "bar_no"], "left").withColumn("_new", F.when(F.col("_was").eqNullSafe(F.col("price")), 0).otherwise(1))
    long = stage(long, "levels")
    # episodes are numbered over months, then over the months' totals
    long = long.withColumn("_month", F.date_trunc("month", "ts"))
    before = Window.partitionBy("symbol", "level").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.groupBy("symbol", "level", "_month").agg(F.sum("_new").alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy("symbol", "level", "_month").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("_i", F.sum("_new").over(within)).join(offsets, ["symbol", "level", "_month"]).withColumn("episode", F.col("_o") + F.col("_i"))
    hit = long.where((F.col("low") <= F.col("price") + threshold) & (F.col("high") >= F.col("price") - threshold))
    row = F.struct("bar_no", "ts", "high", "low", "close", "_before", "_new", "price")
    first = hit.groupBy("symbol", "level", "episode").agg(F.min_by(row, "bar_no").alias("r")).select("symbol", "level", "episode", "r.*")
    above = F.when((F.col("_new") == 1) | F.col("_before").isNull(), F.col("low") >= F.col("price")).otherwise(F.col("_before") > F.col("price"))
    first = first.withColumn("side", F.when(above, "above").otherwise("below"))
    up = F.col("side") == "above"
    first = first.withColumn("bounced", F.when(up, F.col("close") > F.col("price")).otherwise(F.col("close") < F.col("price")))
    wick = F.when(up, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price"))
    return first.withColumn("wick", F.greatest(wick, F.lit(0.0))).select("symbol", "level", "episode", "price", "bar_no", "ts", "side", "bounced", "wick")


def summary(touched: DataFrame, *by) -> DataFrame:
    """Touches, bounces, breaks and the bounce share per group."""
    out = touched.groupBy(*by).agg(F.count("*").alias("touches"), F.count_if("bounced").alias("bounces"))
    return out.withColumn("through", F.col("touches") - F.col("bounces")).withColumn("bounce_pct", F.round(F.col("bounces") / F.col("touches") * 100, 1))


def by_visit(touched: DataFrame) -> DataFrame:
    """Summary by the how manieth touch of the same price it is: 1st, 2nd, 3rd+."""
    w = Window.partitionBy("symbol", "level", "price").orderBy("bar_no")
    n = F.row_number().over(w)
    return summary(touched.withColumn("visit", F.when(n == 1, "1st").when(n == 2, "2nd").otherwise("3rd+")), "symbol", "level", "visit")


def by_clock(touched: DataFrame) -> DataFrame:
    """Summary by trading weekday and session of the touch; touches outside of any session are dropped."""
    ny = local("ts")
    t = touched.withColumn("weekday", trading_weekday(ny)).withColumn("session", session_map(ny, "level"))
    return summary(t.where("session is not null and weekday < 5"), "symbol", "level", "weekday", "session", "side")


def confluence(touched: DataFrame, bars: DataFrame, levels: list[str], distance: float = 10.0) -> DataFrame:
    """Summary by whether another level lies within ``distance`` of the touched one at that bar."""
    others = bars.select("symbol", "bar_no", F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("at")) for c in levels]).alias("_all"))
    t = touched.join(others, ["symbol", "bar_no"])
    near = F.expr(f"exists(_all, x -> x.name <> level and coalesce(abs(x.at - price) <= {distance}, false))")
    return summary(t.withColumn("place", F.when(near, "nearby").otherwise("alone")), "symbol", "level", "place")


def distance_profile(bars: DataFrame, level: str, bands: tuple[float, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Per symbol and New York hour: bars and how many close within each band of the level."""
    d = F.abs(F.col("close") - F.col(level))
    return bars.where(F.col(level).isNotNull()).groupBy("symbol", F.hour(local("ts")).alias("hour")).agg(
        F.count("*").alias("bars"), *[F.count(F.when(d <= b, 1)).alias(f"within_{b:g}") for b in bands]
    )


def settlement_bias(bars: DataFrame, hour: int = 15) -> DataFrame:
    """Days per symbol by whether the day opens above the last settlement (close at the hour in Chicago) and closes above its open."""
    chi = local("ts", CHICAGO)
    day = F.to_date(chi)
    daily = bars.groupBy("symbol", day.alias("day")).agg(
        F.min_by("open", "bar_no").alias("open"), F.max_by("close", "bar_no").alias("close"), F.min_by("close", F.when(F.hour(chi) >= hour, F.col("bar_no"))).alias("settle")
    )
    w = Window.partitionBy("symbol").orderBy("day")
    daily = daily.withColumn("before", F.lag("settle").over(w)).where("before is not null")
    return daily.groupBy("symbol", F.when(F.col("open") > F.col("before"), "above").otherwise("below").alias("opened")).agg(
        F.count("*").alias("days"), F.count_if(F.col("close") > F.col("open")).alias("up_days"), F.round(F.avg(F.col("close") - F.col("open")), 6).alias("mean_move")
    )


def gap_fills(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    """Opening gaps per symbol and direction: how many are closed again the same day, and after how many bars (median)."""
    day = bars.withColumn("period", F.date_trunc("day", "ts"))
    target = F.when(F.col("direction") > 0, F.col("gap_bottom")).otherwise(F.col("gap_top"))
    g = gaps.withColumn("_to", target)
    met = g.join(day.select("symbol", "period", "bar_no", "high", "low"), ["symbol", "period"])
    reach = F.when(F.col("direction") > 0, F.col("low") <= F.col("_to")).otherwise(F.col("high") >= F.col("_to"))
    per = met.groupBy("symbol", "period", "direction").agg(F.min("bar_no").alias("_first"), F.min(F.when(reach, F.col("bar_no"))).alias("_fill"))
    per = per.withColumn("_bars", F.col("_fill") - F.col("_first"))
    return per.groupBy("symbol", "direction").agg(F.count("*").alias("gaps"), F.count("_fill").alias("filled"), F.median("_bars").cast("int").alias("median_bars"))


def level_life(levels: DataFrame, bars: DataFrame, horizon: int = 240) -> DataFrame:
    """(symbol, bar_no, price) levels with the side of the first close off the level and ``filled_after``: bars until a close
    on the other side, within ``horizon`` bars."""
    steps = forward_join(levels.select("symbol", "bar_no", "price"), bars, horizon, ["close"])
    off = steps.where("close <> price").withColumn("_s", F.signum(F.col("close") - F.col("price")))
    first = off.groupBy("symbol", "bar_no", "price").agg(F.min_by("_s", "step").alias("side"))
    crossed = off.join(first, ["symbol", "bar_no", "price"]).where("_s <> side").groupBy("symbol", "bar_no").agg(F.min("step").alias("filled_after"))
    return levels.select("symbol", "bar_no", "price").join(first.drop("price"), ["symbol", "bar_no"], "left").join(crossed, ["symbol", "bar_no"], "left")


def momentum_after(fills: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    """Run beyond and against the direction of fills (symbol, bar_no, price, direction) within each horizon: mfe_n and mae_n."""
    steps = forward_join(fills, bars, max(horizons), ["high", "low"])
    up = F.col("direction") > 0
    out = steps.groupBy(*fills.columns).agg(
        *[F.max(F.when(F.col("step") <= h, F.when(up, F.col("high") - F.col("price")).otherwise(F.col("price") - F.col("low")))).alias(f"mfe_{h}") for h in horizons],
        *[F.max(F.when(F.col("step") <= h, F.when(up, F.col("price") - F.col("low")).otherwise(F.col("high") - F.col("price")))).alias(f"mae_{h}") for h in horizons],
    )
    return out


