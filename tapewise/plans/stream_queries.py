"""Streaming queries, run over the events that are there; results equal those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import stamp
from ..operators import chains
from ..sources.bars import event_bars, read_table
from ..sources.store import stage
from ..streaming import bars as streams
from .registry import query
from .research_queries import _CHAINED, _LIFTS, _moved, _states


def _folder(table: DataFrame) -> str:
    """The folder of a staged table."""
    return table.inputFiles()[0].rsplit("/", 1)[0]


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return streams.tick_stream(spark, f"{sf_dir}/event[s].parquet")


#: Windows that the watermark has closed: they end a day before the last tick at the latest.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(f"SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.stream_bars(_ticks(spark, sf_dir))).withColumn("ts", stamp("ts"))


@query(f"""SELECT event_type AS symbol, strftime(date_trunc('hour', ts) - INTERVAL 1 HOUR * k, '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n FROM events, (SELECT unnest(range(6)) AS k)
    WHERE date_trunc('hour', ts) - INTERVAL 1 HOUR * k + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY 1, 2""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.sliding_counts(_ticks(spark, sf_dir))).withColumn("ts", stamp("ts"))


@query(f"""SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS s FROM (
            SELECT event_type AS symbol, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY symbol, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.activity_sessions(_ticks(spark, sf_dir))).select("symbol", stamp("ts").alias("ts"), "n")


@query("""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, bull AS new, b IS NOT NULL AS active, was AS filled, b AS zone_low, t AS zone_high FROM (
        SELECT g.*, g.ts AS ts_, CASE WHEN z.fill_no IS NULL OR g.bar_no < z.fill_no THEN z.far END AS b, CASE WHEN z.fill_no IS NULL OR g.bar_no < z.fill_no THEN z.entry END AS t, p.fill_no IS NOT NULL AS was
        FROM gap_ids g LEFT JOIN fills z ON z.symbol = g.symbol AND z.zone_id = g.bull_id LEFT JOIN fills p ON p.symbol = g.symbol AND p.zone_id = g.bull_id - g.bull::INT AND p.fill_no = g.bar_no) WHERE ts_ <= (SELECT max(ts) - INTERVAL 1 DAY FROM bars)""",
    fills="SELECT b.symbol, b.zone_id, b.entry, b.far, min(z.bar_no) AS fill_no FROM born b LEFT JOIN zone_all z ON z.symbol = b.symbol AND z.side = b.side AND z.bar_no > b.born_no AND z.zone_id - z.birth::INT = b.zone_id AND z.lo <= b.far WHERE b.side = 'bull' GROUP BY ALL")
def stream_gap_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stage(event_bars(spark, sf_dir).select("symbol", "ts", "high", "low"), "bars")
    stream = spark.readStream.schema(bars.schema).parquet(_folder(bars))
    return streams.drain(streams.gap_zone_stream(stream), store=streams.ROCKS).withColumn("ts", stamp("ts"))


@query("""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM bars b WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.value > 150 AND abs(epoch_us(e.ts) - epoch_us(b.ts)) <= 300000000)""")
def stream_news_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stage(event_bars(spark, sf_dir).select("symbol", "ts"), "bars")
    stream = spark.readStream.schema(bars.schema).parquet(_folder(bars))
    news = read_table(spark, sf_dir, "events").where("event_type = 'error' and value > 150").select(F.col("ts").cast("timestamp").alias("event_ts"))
    return streams.drain(streams.near_calendar(stream, news)).withColumn("ts", stamp("ts"))


@query("""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, state, lift, CASE WHEN lift >= 3 THEN 'A' WHEN lift >= 2 THEN 'B' WHEN lift >= 1 THEN 'C' ELSE 'D' END AS grade FROM (
        SELECT s.symbol, s.bar_no, s.ts, s.state, arg_max(l.lift, c.length) FILTER (l.lift IS NOT NULL) AS lift FROM states s LEFT JOIN chained c USING (symbol, bar_no) LEFT JOIN lifts l ON l.symbol = s.symbol AND l.length = c.length AND l.chain = c.chain GROUP BY 1, 2, 3, 4)""", chained=_CHAINED, lifts=_LIFTS)
def stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar is told of: the stream's end is marked."""
    states = _states(spark, sf_dir)
    lifts = stage(chains.chain_lift(states, _moved()), "lifts")
    bars = stage(streams.ended(states.select("symbol", "ts", "state")), "bars")
    stream = spark.readStream.schema(bars.schema).parquet(_folder(bars))
    return streams.drain(streams.watch_chains(stream, lifts), store=streams.ROCKS).withColumn("ts", stamp("ts"))


@query("""SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM bars b WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.value > 150 AND abs(epoch_us(e.ts) - epoch_us(b.ts)) <= 300000000)""")
def stream_news_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar is a stream of its own; every bar is there, as nothing comes later than its watermark."""
    bars = stage(event_bars(spark, sf_dir).select("symbol", "ts"), "bars")
    news = stage(read_table(spark, sf_dir, "events").where("event_type = 'error' and value > 150").select(F.col("ts").cast("timestamp").alias("event_ts")), "news")
    left, right = (spark.readStream.schema(t.schema).parquet(_folder(t)) for t in (bars, news))
    return streams.drain(streams.near_calendar_stream(left, right)).withColumn("ts", stamp("ts"))
