"""As-of, interval, forward-horizon and fuzzy joins over keys that Spark can shuffle on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import keyed


def forward_join(events: DataFrame, bars: DataFrame, n: int, values: list[str], at: str = "bar_no", including: bool = False) -> DataFrame:
    """Each event with the next ``n`` bars of its symbol: the event's columns, ``step`` (1..n; 0 is the event's bar) and ``values``.

    Bars and events meet on (symbol, block of n bars); an event looks into two blocks, so nothing grows with the
    length of a symbol.
    """
    bars = keyed(bars).select("symbol", F.col("bar_no").alias("_no"), *[F.col(v).alias(f"_v_{v}") for v in values])
    blocks = bars.withColumn("_block", F.expr(f"_no div {n}"))
    looking = events.withColumn("_block", F.explode(F.array(F.expr(f"`{at}` div {n}"), F.expr(f"`{at}` div {n} + 1"))))
    met = looking.join(blocks, ["symbol", "_block"]).withColumn("step", F.col("_no") - F.col(at))
    met = met.where(F.col("step").between(0 if including else 1, n))
    return met.select(*events.columns, "step", *[F.col(f"_v_{v}").alias(v) for v in values])


def asof(left: DataFrame, right: DataFrame, values: list[str], forward: bool = False) -> DataFrame:
    """Each row of ``left`` (symbol, ts, ...) with ``values`` of the last row of ``right`` at or before it, or the first at or after.

    Both sides are merged into one series per symbol and values are carried along it month by month, so a long
    symbol is not sorted in one task. No match gives nulls; ``right`` should have one row per (symbol, ts).
    """
    names = [c for c in left.columns if c not in values]
    a = left.select(F.struct(*names).alias("_row"), "symbol", "ts", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(1 if not forward else 0).alias("_side"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "symbol", "ts", *values, F.lit(0 if not forward else 1).alias("_side"))
    both = a.unionByName(b).withColumn("chunk", F.date_trunc("month", "ts"))
    if forward:
        both = both.withColumn("chunk", F.expr("-unix_seconds(chunk)")).withColumn("_key", F.struct((-F.unix_micros("ts")).alias("t"), (1 - F.col("_side")).alias("s")))
    else:
        both = both.withColumn("_key", F.struct(F.unix_micros("ts").alias("t"), F.col("_side").alias("s")))
    within = Window.partitionBy("symbol", "chunk").orderBy("_key")
    packed = both.withColumn("_v", F.when(F.col("_row").isNull(), F.struct(*values)))
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    left_over = packed.groupBy("symbol", "chunk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_key"))).alias("_l"))
    left_over = left_over.withColumn("_b", F.last("_l", ignorenulls=True).over(before)).drop("_l")
    found = packed.withColumn("_w", F.last("_v", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).join(left_over, ["symbol", "chunk"])
    found = found.where("_row is not null").withColumn("_v", F.coalesce("_w", "_b"))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_v.{v}").alias(v) for v in values])


def near_events(bars: DataFrame, events: DataFrame, minutes: int = 5) -> DataFrame:
    """Bars within ``minutes`` (inclusive) of an event time ``event_ts``, each once.

    Events are posted to their minute bucket and its neighbours; bars look into their own.
    """
    width = max(1, minutes) * 60
    spread = events.select("event_ts").distinct().withColumn("_b", F.explode(F.sequence(F.expr(f"unix_seconds(event_ts) div {width} - 1"), F.expr(f"unix_seconds(event_ts) div {width} + 1"))))
    near = F.abs(F.unix_micros("ts") - F.unix_micros("event_ts")) <= minutes * 60_000_000
    keyed_bars = bars.withColumn("_b", F.expr(f"unix_seconds(ts) div {width}"))
    return keyed_bars.join(spread, (keyed_bars["_b"] == spread["_b"]) & near, "left_semi").drop("_b")


def events_between(events: DataFrame, start: Column, end: Column, days: int = 0) -> DataFrame:
    """Events (event_ts) from ``days`` days before ``start`` to ``days`` days after ``end``, both days included."""
    return events.where((F.to_date("event_ts") >= F.date_sub(start, days)) & (F.to_date("event_ts") <= F.date_add(end, days)))


def carry_higher_frame(bars: DataFrame, higher: DataFrame, values: list[str], seconds: int) -> DataFrame:
    """Values of the last *closed* bar of a higher frame at each bar; ``higher`` is labelled by the start of its buckets."""
    closed = higher.withColumn("ts", (F.col("ts").cast("long") + seconds).cast("timestamp"))
    return asof(bars, closed, values)


def fuzzy_duplicates(rows: DataFrame, key: str, words: Column, share: float = 0.8, apart: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, whose word sets share ``share`` of the smaller set and differ in size by ``apart`` at most.

    A pair must share a word among the rarest ones of either set, as many as leave less than ``share`` of it; only such
    pairs are compared.
    """
    sets = rows.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(words)).alias("w")).where("size(w) > 0")
    one = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    often = one.groupBy("word").agg(F.count("*").alias("_often"))
    order = Window.partitionBy("id").orderBy("_often", "word")
    # the smaller set's overlap is at least ceil(share * n); the larger one has up to n + apart words
    posts = one.join(often, "word").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("n") + 1 - F.ceil(F.lit(share) * F.greatest(F.col("n") - apart, F.lit(1))))
    a, b = posts.select("word", F.col("id").alias("a"), F.col("n").alias("na")), posts.select("word", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "word").where((F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= apart)).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    enough = F.size(F.array_intersect("wa", "wb")) >= F.lit(share) * F.least(F.size("wa"), F.size("wb"))
    return pairs.where(enough).select("a", "b")

