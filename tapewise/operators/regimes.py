"""Time-of-day, phase, regime and distribution statistics over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import bucket_label, local
from .frames import by_chunk, flag, islands, next_, windowed


def unpivot(bars: DataFrame, columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    """(symbol, bar_no, ts, name, value) of several columns of one type."""
    return bars.select("symbol", "bar_no", "ts", F.expr(f"stack({len(columns)}, {', '.join(f'{c!r}, `{c}`' for c in columns)}) AS (`{name}`, `{value}`)"))


def describe(bars: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, sample deviation and quantiles of each column per symbol; nulls don't count."""
    q = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    out = unpivot(bars, columns).groupBy("symbol", "column").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), q.alias("q"))
    return out.select("symbol", "column", "n", "mean", "std", *[F.round(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((25, 50, 75, 90, 95))])


def count_by_window(bars: DataFrame, flags: list[str], minutes: int = 60) -> DataFrame:
    """True bars per symbol, flag and New York time window, and per trading day (days of the whole symbol)."""
    ny = local("ts")
    days = bars.groupBy("symbol").agg(F.count_distinct(F.to_date(ny)).alias("_days"))
    counts = unpivot(bars, flags, "flag", "on").where("on").groupBy("symbol", "flag", bucket_label(ny, minutes).alias("window")).agg(F.count("*").alias("n"))
    return counts.join(days, "symbol").withColumn("per_day", F.round(F.col("n") / F.col("_days"), 6)).drop("_days")


def heat_map(bars: DataFrame, condition: str, minutes: int = 60) -> DataFrame:
    """True bars per symbol and time window, one column for each weekday (0 Monday)."""
    ny = local("ts")
    return bars.where(condition).groupBy("symbol", bucket_label(ny, minutes).alias("window")).agg(*[F.count_if(F.weekday(ny) == d).alias(f"d{d}") for d in range(7)])


def fire_rates(bars: DataFrame, flags: list[str]) -> DataFrame:
    """Share of true bars of each flag over all symbols, and whether it never fires; one pass."""
    one = bars.agg(F.count("*").alias("_n"), *[F.count_if(f).alias(f) for f in flags])
    long = one.select("_n", F.expr(f"stack({len(flags)}, {', '.join(f'{c!r}, `{c}`' for c in flags)}) AS (flag, fires)"))
    return long.select("flag", "fires", F.round(F.try_divide("fires", "_n"), 6).alias("rate"), (F.col("fires") == 0).alias("dead"))


def run_profile(bars: DataFrame, column: str) -> DataFrame:
    """Runs of a true flag per symbol and New York hour of their start: runs, bars, share that rises, mean net move."""
    runs = islands(bars, column, "_run").where("_run is not null")
    per = runs.groupBy("symbol", "_run").agg(F.min("ts").alias("ts"), F.count("*").alias("bars"), (F.max_by("close", "bar_no") - F.min_by("open", "bar_no")).alias("net"))
    return per.groupBy("symbol", F.hour(local("ts")).alias("hour")).agg(
        F.count("*").alias("runs"), F.sum("bars").alias("bars"), F.count_if(F.col("net") > 0).alias("up"), F.round(F.avg("net"), 6).alias("mean_net")
    )


def phases(bars: DataFrame, column: str, window: int = 30) -> DataFrame:
    """Phase of each bar relative to the runs of a flag: during, before (a run starts within the window), after, else neutral."""
    runs = islands(bars, column, "_run")

    def build(b: DataFrame) -> DataFrame:
        on = F.col("_run").isNotNull()
        before, after = F.lag("_run").over(by_chunk()), F.lead("_run").over(by_chunk())
        b = b.withColumn("_start", flag(on & ~before.eqNullSafe(F.col("_run")))).withColumn("_end", flag(on & ~after.eqNullSafe(F.col("_run"))))
        soon = F.max(F.col("_start").cast("int")).over(next_(window)) == 1
        just = F.max(F.col("_end").cast("int")).over(by_chunk().rowsBetween(1 - window, 0)) == 1
        return b.withColumn("phase", F.when(on, "during").when(soon, "before").when(just, "after").otherwise("neutral")).drop("_start", "_end", "_run")

    return windowed(runs, build, back=window + 1, ahead=window + 1)


def phase_summary(bars: DataFrame, column: str, window: int = 30) -> DataFrame:
    p = phases(bars, column, window)
    return p.groupBy("symbol", "phase").agg(
        F.count("*").alias("bars"), F.round(F.avg(F.col("high") - F.col("low")), 6).alias("mean_range"), F.count_if(F.col("close") > F.col("open")).alias("up"), F.count_if(F.col("close") < F.col("open")).alias("down")
    )


def quarters(bars: DataFrame, atr: str = "atr", adx: str = "adx") -> DataFrame:
    """Per symbol and calendar period (quarter): bars, mean and deviation of the ATR, mean of the ADX."""
    return bars.groupBy("symbol", F.date_trunc("quarter", "ts").alias("quarter")).agg(
        F.count("*").alias("bars"), F.avg(atr).alias("atr_mean"), F.stddev_samp(atr).alias("atr_std"), F.avg(adx).alias("adx_mean")
    )


def regime_shift(by_quarter: DataFrame, high: float = 1.4, low: float = 0.7) -> DataFrame:
    """Per symbol with three quarters or more: the last one's ATR over the median of those before, and whether it is out of bounds."""
    newest = Window.partitionBy("symbol").orderBy(F.col("quarter").desc())
    q = by_quarter.withColumn("_n", F.row_number().over(newest))
    out = q.groupBy("symbol").agg(F.count("*").alias("quarters"), F.max(F.when(F.col("_n") == 1, F.col("atr_mean"))).alias("last"), F.median(F.when(F.col("_n") > 1, F.col("atr_mean"))).alias("usual"))
    ratio = F.try_divide("last", "usual")
    return out.where("quarters >= 3").select("symbol", "quarters", F.round(ratio, 6).alias("ratio"), ((ratio > high) | (ratio < low)).alias("shifted"))


def forward_regimes(bars: DataFrame, regime: str, horizons: tuple[int, ...] = (15, 30, 60)) -> DataFrame:
    """Where the regime changes: median net move and efficiency of the next bars per symbol, new regime and horizon."""

    def build(b: DataFrame) -> DataFrame:
        b = b.withColumn("_d", F.abs(F.lead("close").over(by_chunk()) - F.col("close")))
        for h in horizons:
            net = F.lead("close", h).over(by_chunk()) - F.col("close")
            path = F.sum("_d").over(by_chunk().rowsBetween(0, h - 1))
            b = b.withColumn(f"_n{h}", net).withColumn(f"_k{h}", F.try_divide(F.abs(net), path))
        return b.withColumn("_change", flag(F.col(regime) != F.lag(regime).over(by_chunk()))).drop("_d")

    b = windowed(bars, build, back=1, ahead=max(horizons)).where("_change")
    long = b.select("symbol", F.col(regime).alias("regime"), F.expr(f"stack({len(horizons)}, {', '.join(f'{h}, _n{h}, _k{h}' for h in horizons)}) AS (horizon, net, ker)")).where("net is not null")
    return long.groupBy("symbol", "regime", "horizon").agg(F.count("*").alias("changes"), F.round(F.median("net"), 6).alias("net"), F.round(F.median("ker"), 6).alias("ker"))


def day_bias(bars: DataFrame, condition: str, first: int = 9, end: int = 16) -> DataFrame:
    """New York days with and without a flagged bar: days, mean and population deviation of the move from first to last close of the session."""
    ny = local("ts")
    inside = (F.hour(ny) >= first) & (F.hour(ny) < end)
    day = bars.groupBy("symbol", F.to_date(ny).alias("day")).agg(
        F.max(F.expr(f"cast(coalesce({condition}, false) AS int)")).alias("flagged"),
        (F.max_by("close", F.when(inside, F.col("bar_no"))) - F.min_by("close", F.when(inside, F.col("bar_no")))).alias("move"),
    )
    return day.where("move is not null").groupBy("symbol", "flagged").agg(
        F.count("*").alias("days"), F.round(F.avg("move"), 6).alias("mean"), F.round(F.stddev_pop("move"), 6).alias("std"), F.count_if(F.col("move") < 0).alias("down"), F.count_if(F.col("move") > 0).alias("up")
    )


def cube_quality(events: DataFrame, dims: list[Column | str], mfe: str = "mfe_up", mae: str = "mae_up") -> DataFrame:
    """Events and total excursions for every combination of the dimensions and all their margins (null: all)."""
    return events.cube(*dims).agg(F.count("*").alias("events"), F.round(F.sum(mfe), 4).alias("mfe"), F.round(F.sum(mae), 4).alias("mae"))
