"""Bars from files and from ticks, and the keys that every bar operator needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stage

#: Least bars of a symbol that one task handles together, and the most chunks of a symbol; window operators copy a few rows over each cut.
CHUNK, MOST_CHUNKS = 10_000, 4096
REQUIRED = ("symbol", "ts", "open", "high", "low", "close")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Clock arithmetic is done in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(df: DataFrame) -> DataFrame:
    """Lower-case column names; fails if a required column of bars is missing (metadata only, no scan)."""
    out = df.select([F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    if missing := [c for c in REQUIRED if c not in out.columns]:
        raise ValueError(f"bars need the columns {', '.join(missing)}")
    return out


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from Parquet with start <= ts < end; the bounds reach the scan."""
    return clip(fold_case(spark.read.parquet(path)), start, end)


def read_bars_csv(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Bars from CSV with a header, and of each symbol only the ``last`` ones if asked for."""
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"
    bars = spark.read.csv(path, header=True, schema=schema)
    if last is None:
        return bars
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")


def clip(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= ts < end, either bound optional (holdout lock)."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return bars


def ohlc(rows: DataFrame, groups: list[Column | str], price: str, volume: Column, tie: str) -> DataFrame:
    """Open, high, low, close and volume of ``price`` per group; first and last by (ts, tie)."""
    order = F.struct("ts", tie)
    return rows.groupBy(*groups).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.alias("volume")
    )


def bars_from_ticks(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Ticks (symbol, ts, tick_id, price) to bars of a calendar unit; empty buckets make no bar."""
    return ohlc(ticks, ["symbol", F.date_trunc(unit, "ts").alias("bucket")], "price", F.count("*"), "tick_id").withColumnRenamed("bucket", "ts")


def resample(bars: DataFrame, size: str) -> DataFrame:
    """Bars to a higher frame, labelled by the start of the bucket, empty buckets dropped."""
    order = F.col("ts")
    out = bars.groupBy("symbol", F.window("ts", size).alias("w")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def resample_rows(bars: DataFrame, period: int) -> DataFrame:
    """Every ``period`` bars of a symbol become one; an incomplete tail is dropped."""
    numbered = keyed(bars)
    order = F.col("bar_no")
    out = numbered.groupBy("symbol", F.expr(f"bar_no div {period}").alias("bucket")).agg(
        F.min("ts").alias("ts"), F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )
    return out.where(F.col("n") == period).drop("n")


def keyed(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``bar_no`` (from 0 per symbol, by ts), ``chunk_len`` and ``chunk`` = bar_no div chunk_len.

    A chunk has ``chunk`` bars, or more where a symbol would have more than MOST_CHUNKS of them. Numbering runs within calendar months, whose counts give the offsets, so no task sorts a whole symbol.
    """
    if "bar_no" in bars.columns:
        return bars
    month = bars.withColumn("_month", F.date_trunc("month", "ts"))
    before = Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = month.groupBy("symbol", "_month").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.withColumn("_bars", F.sum("_n").over(Window.partitionBy("symbol"))).drop("_n")
    in_month = Window.partitionBy("symbol", "_month").orderBy("ts")
    numbered = month.withColumn("_at", F.row_number().over(in_month)).join(offsets, ["symbol", "_month"])
    numbered = numbered.withColumn("bar_no", (F.col("_offset") + F.col("_at") - 1).cast("long"))
    length = F.greatest(F.lit(chunk), F.ceil(F.col("_bars") / MOST_CHUNKS)).cast("long")
    return numbered.withColumn("chunk_len", length).withColumn("chunk", F.expr("bar_no div chunk_len")).drop("_month", "_at", "_offset", "_bars")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the ``events`` ticks; the event type is the symbol."""
    events = read_table(spark, sf_dir, "events")
    ticks = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"))
    return bars_from_ticks(ticks, "hour")


def keyed_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events`` as a stored table with its keys, which is what bar operators read."""
    return stage(keyed(event_bars(spark, sf_dir)), "bars")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``orders``; the priority is the symbol."""
    orders = read_table(spark, sf_dir, "orders")
    ticks = orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("tick_id"), F.col("o_totalprice").alias("price"))
    return bars_from_ticks(ticks, "day")
