"""Streams of ticks: bars, sliding counts, sessions of activity, incremental gap zones, calendar windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import shared_dir


def tick_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Ticks (symbol, ts, tick_id, price) from a growing set of Parquet files of the ``events`` layout."""
    schema = spark.read.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"))


def stream_bars(ticks: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Bars over tumbling windows. A tick that comes twice counts once; later than the watermark it is dropped."""
    order = F.struct("ts", "tick_id")
    once = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "tick_id"])
    bars = once.groupBy("symbol", F.window("ts", size).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_counts(ticks: DataFrame, size: str = "6 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Ticks per symbol in overlapping windows."""
    counts = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("symbol", F.col("w.start").alias("ts"), "n")


def activity_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Stretches of ticks of a symbol with no pause longer than ``gap``."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("till"), "n")


def near_calendar(bars: DataFrame, calendar: DataFrame, minutes: int = 5) -> DataFrame:
    """Streamed bars near events of a static calendar (event_ts), posted to their bucket and its neighbours."""
    width = max(1, minutes) * 60
    posts = calendar.select("event_ts").distinct().withColumn("_b", F.explode(F.sequence(F.expr(f"unix_seconds(event_ts) div {width} - 1"), F.expr(f"unix_seconds(event_ts) div {width} + 1"))))
    near = F.abs(F.unix_micros("ts") - F.unix_micros("event_ts")) <= minutes * 60_000_000
    keyed = bars.withColumn("_b", F.expr(f"unix_seconds(ts) div {width}"))
    return keyed.join(posts, (keyed["_b"] == posts["_b"]) & near, "left_semi").drop("_b")


_ZONES = "symbol string, at long, new boolean, active boolean, filled boolean, zone_low double, zone_high double"
_MARKED = "symbol string, at long, state string, chain_1 string, chain_2 string, chain_3 string"


class InOrder(StatefulProcessor):
    """Bars of a symbol in order of time, however they arrive: they wait in a list until the watermark has passed them, then ``advance`` takes them one by one.

    Times are microseconds (column ``at``). ``kind`` are the bars' columns after it, ``told`` is the schema of the result, ``memory`` is the schema of what ``advance`` keeps, ``start`` its first value. A bar that is not later than the last one
    released is dropped. A symbol without bars for ``idle`` milliseconds of event time is forgotten. A symbol's state is its memory and the bars of the time that the watermark lags behind.
    """

    def __init__(self, kind: str, told: str, memory: str, start: tuple, advance: Callable[[tuple, Row], tuple[tuple, tuple]], idle: int):
        self.kind, self.memory_kind, self.start, self.advance, self.idle = kind, memory, start, advance, idle
        self.told = [c.split()[0] for c in told.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.kind}")
        self.memory = handle.getValueState("memory", f"till long, {self.memory_kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = ["at", *[c.split()[0] for c in self.kind.split(", ")]]
        till = self.memory.get()[0] if self.memory.exists() else None
        new = [tuple(row[f] for f in fields) for row in rows if till is None or row["at"] > till]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        bars = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [b for b in bars if b[0] // 1000 <= passed]
        memory = tuple(self.memory.get()) if self.memory.exists() else (None, *self.start)
        out = []
        for bar in due:
            kept, values = self.advance(memory[1:], bar[1:])
            memory = (bar[0], *kept)
            out.append(Row(*self.told)(*key, bar[0], *values))
        if due:
            self.memory.update(memory)
            self.waiting.put(bars[len(due) :]) if len(bars) > len(due) else self.waiting.clear()
        if len(bars) > len(due):
            self.handle.registerTimer(bars[len(due)][0] // 1000)
        elif memory[0] is not None:
            end = memory[0] // 1000 + self.idle
            if end <= passed:
                self.memory.clear()
            else:
                self.handle.registerTimer(end)
        return iter(out)

    def close(self) -> None:
        pass


def _next_zone(memory: tuple, bar: tuple, max_age: int) -> tuple[tuple, tuple]:
    """Two highs and the active zone after a bar (high, low), and what is told of the bar."""
    (h2, h1, top, bottom, age), (high, low) = memory, bar
    filled = bottom is not None and low <= bottom
    if filled or (bottom is not None and max_age and age >= max_age):
        top = bottom = None
    new = h2 is not None and low > h2
    top, bottom, age = (low, h2, 0) if new else (top, bottom, age + 1)
    return (h1, high, top, bottom, age), (new, bottom is not None, filled, bottom, top)


def gap_zone_stream(bars: DataFrame, max_age: int = 0, late: str = "1 day", idle_days: int = 365) -> DataFrame:
    """Bull gap zones bar by bar, as the batch operator gives them, for bars (symbol, ts, high, low) that arrive in any order: each is told of once the watermark has passed it.

    The state of a symbol is two highs, the active zone and the bars that wait; it is dropped after ``idle_days`` of event time without bars. Needs a state store that knows
    timers (see ``drain``).
    """
    follow = InOrder("high double, low double", _ZONES, "h2 double, h1 double, top double, bottom double, age long", (None, None, None, None, 0), lambda memory, bar: _next_zone(memory, bar, max_age), idle_days * 86_400_000)
    return _followed(bars.select("symbol", "ts", "high", "low"), follow, _ZONES, late)


def _followed(bars: DataFrame, follow: InOrder, told: str, late: str) -> DataFrame:
    """``told`` of a stream of bars, with ts for at."""
    out = bars.withWatermark("ts", late).withColumn("at", F.unix_micros("ts")).groupBy("symbol").transformWithState(follow, told, "Append", "EventTime")
    return out.select("symbol", F.timestamp_micros("at").alias("ts"), *out.columns[2:])


#: The store that keeps lists and timers.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drain(stream: DataFrame, mode: str = "append", tag: str = "stream", store: Mapping[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there now, into a Parquet table in the shared folder, and return the table.

    In append mode the table holds the windows that the watermark has closed, and state is dropped with them. In complete mode each run of
    the query replaces the table (through foreachBatch); for small results only. ``store``: settings of the state store, for this run only.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    before = {k: spark.conf.get(k) for k in store or {}}
    for k, v in (store or {}).items():
        spark.conf.set(k, v)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", f"{base}/table").start()
        else:
            query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/table")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def _next_states(memory: tuple, bar: tuple) -> tuple[tuple, tuple]:
    """The last three states after a bar (state), and the chains of one to three states before it."""
    before = [s for s in memory if s]
    chains = ["→".join(before[-k:]) if len(before) >= k else None for k in (1, 2, 3)]
    after = [*before, bar[0]][-3:]
    return tuple([None] * (3 - len(after)) + after), (bar[0], *chains)


def watch_chains(bars: DataFrame, lifts: DataFrame, late: str = "1 day", idle_days: int = 365) -> DataFrame:
    """Streamed bars (symbol, ts, state) with the lift of the longest known chain before them, and its grade, as the batch operator gives them.

    The state of a symbol is its last three states and the bars that wait for the watermark, so bars may arrive in any order; ``lifts`` is a static table
    (symbol, length, chain, lift). A symbol's state is dropped after ``idle_days`` without bars. Needs a state store that knows timers (see ``drain``).
    """
    follow = InOrder("state string", _MARKED, "s3 string, s2 string, s1 string", (None, None, None), _next_states, idle_days * 86_400_000)
    out = _followed(bars.select("symbol", "ts", "state"), follow, _MARKED, late)
    for k in (3, 2, 1):
        table = lifts.where(F.col("length") == k).select("symbol", F.col("chain").alias(f"chain_{k}"), F.col("lift").alias(f"_l{k}"))
        out = out.join(table, ["symbol", f"chain_{k}"], "left")
    lift = F.coalesce("_l3", "_l2", "_l1")
    grade = F.when(lift >= 3, "A").when(lift >= 2, "B").when(lift >= 1, "C").otherwise("D")
    return out.select("symbol", "ts", "state", lift.alias("lift"), grade.alias("grade"))


def ended(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """A table of bars (symbol, ts, ...) to be streamed to its end: with a mark, null but for symbol and ts, whose time moves the watermark past the last bar.

    Every bar is thus released; the mark itself, being later than the watermark, never is. It must arrive with the last bars.
    """
    mark = bars.agg(F.min("symbol").alias("symbol"), (F.max("ts") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 SECOND")).alias("ts")).where("ts is not null")  # one row
    return bars.unionByName(mark, allowMissingColumns=True)


def near_calendar_stream(bars: DataFrame, calendar: DataFrame, minutes: int = 5, late: str = "1 day", calendar_late: str = "1 day") -> DataFrame:
    """Streamed bars near events of a calendar that is a stream too (event_ts), each bar once, whichever of the two comes first.

    A bar waits for events until the calendar's watermark has passed it by ``minutes``, and an event waits for bars likewise; then both leave the state. What comes later than its
    watermark is dropped. Bars and events meet on a bucket of time, to which an event is posted together with its neighbours.
    """
    width = max(1, minutes) * 60
    bucket = lambda c: F.expr(f"unix_seconds({c}) div {width}")
    posts = calendar.select("event_ts").withWatermark("event_ts", calendar_late).withColumn("_eb", F.explode(F.sequence(bucket("event_ts") - 1, bucket("event_ts") + 1)))
    keyed = bars.withWatermark("ts", late).withColumn("_b", bucket("ts"))
    near = (F.col("event_ts") >= F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("event_ts") <= F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return keyed.join(posts, (F.col("_b") == F.col("_eb")) & near, "left_semi").drop("_b")
