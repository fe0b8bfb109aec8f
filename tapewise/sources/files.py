"""Signal shards, trade tables, calendars, reports and exports as files that Spark reads and writes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of the signal shards of a store.
BUCKETS = 64
CALENDAR = "date string, time_et string, impact string, title string"
TRADES = "run_id string, symbol string, entry_time timestamp, exit_time timestamp, direction int, entry_price double, exit_price double, pnl_points double"


def write_signals(bars: DataFrame, path: str, name: str, known: tuple[str, ...]) -> None:
    """One shard of a signal: its new boolean and floating columns by symbol and month; only partitions that come are replaced."""
    new = [f.name for f in bars.schema if f.name not in known and isinstance(f.dataType, (T.BooleanType, T.DoubleType, T.FloatType))]
    out = bars.select("symbol", "ts", *new, F.date_format("ts", "yyyy-MM").alias("month"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(f"{path}/{name}")


def read_signals(spark: SparkSession, path: str, names: list[str], since: str | None = None) -> DataFrame:
    """Shards side by side on (symbol, ts); of columns that come twice the first shard's stays. ``since``: first month read."""
    out = None
    for name in names:
        shard = spark.read.parquet(f"{path}/{name}")
        shard = (shard.where(F.col("month") >= since) if since else shard).drop("month")
        out = shard if out is None else out.join(shard.drop(*[c for c in shard.columns if c in out.columns and c not in ("symbol", "ts")]), ["symbol", "ts"], "full_outer")
    return out


def _shard(path: str, name: str) -> str:
    """Name of a bucketed shard in the session's catalogue."""
    return f"signals_{hashlib.md5(f'{path}/{name}'.encode()).hexdigest()}"


def write_signal_buckets(bars: DataFrame, path: str, name: str, known: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """One shard of a signal as ``write_signals`` has it, in ``buckets`` of (symbol, ts), each sorted: shards of as many buckets meet without a shuffle."""
    new = [f.name for f in bars.schema if f.name not in known and isinstance(f.dataType, (T.BooleanType, T.DoubleType, T.FloatType))]
    out = bars.select("symbol", "ts", *new).repartition(buckets, "symbol", "ts")  # one file for each bucket
    out.write.mode("overwrite").bucketBy(buckets, "symbol", "ts").sortBy("symbol", "ts").option("path", f"{path}/{name}").saveAsTable(_shard(path, name))


def read_signal_buckets(spark: SparkSession, path: str, names: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Bucketed shards side by side on (symbol, ts), in any session; of columns that come twice the first shard's stays."""
    out = None
    for name in names:
        shard = _shard(path, name)
        if not spark.catalog.tableExists(shard):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
            spark.sql(f"CREATE TABLE {shard} ({columns}) USING parquet CLUSTERED BY (symbol, ts) SORTED BY (symbol, ts) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        table = spark.table(shard)
        out = table if out is None else out.join(table.drop(*[c for c in table.columns if c in out.columns and c not in ("symbol", "ts")]), ["symbol", "ts"], "full_outer")
    return out


def stale_signals(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Wanted shards (signal, params_hash, input_id, code_version) that the manifest does not hold in just this form."""
    return wanted.join(manifest, ["signal", "params_hash", "input_id", "code_version"], "left_anti")


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """All trade files of a folder; an empty table of the right form where the folder holds none."""
    return spark.read.schema(TRADES).option("ignoreMissingFiles", True).parquet(path)


def write_trades(trades: DataFrame, path: str, buckets: int = 64) -> None:
    """Trades by a hash bucket of their run, so that runs neither share one file nor make one each."""
    b = F.pmod(F.xxhash64("run_id"), buckets)
    trades.withColumn("bucket", b).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_calendar(spark: SparkSession, path: str, impact: str = "HIGH") -> DataFrame:
    """Dated events of one impact with their UTC time ``event_ts``; the file has New York wall time."""
    rows = spark.read.csv(path, header=True, schema=CALENDAR).where(F.upper("impact") == impact)
    local = F.try_to_timestamp(F.concat_ws(" ", "date", "time_et"), F.lit("yyyy-MM-dd HH:mm"))
    return rows.withColumn("event_ts", F.to_utc_timestamp(local, "America/New_York")).where("event_ts is not null")


def export_registry(runs: DataFrame, results: DataFrame, path: str, compression: str = "none") -> None:
    """Runs as CSV by tier, and one JSON document for each run with its results in order of rank; ``compression`` of the JSON files, say gzip. ``runs`` is read twice."""
    runs.write.mode("overwrite").partitionBy("tier").option("header", True).csv(f"{path}/csv")
    nested = results.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in results.columns if c not in ("run_id", "rank")]))).alias("results"))
    runs.join(nested, "run_id", "left").write.mode("overwrite").option("compression", compression).json(f"{path}/json")


def back_fill(results: DataFrame, runs: DataFrame, other_runs: DataFrame, other_results: DataFrame) -> DataFrame:
    """Results plus those of another registry for runs without any, matched by idea text; its latest run of an idea counts."""
    gaps = runs.join(results, "run_id", "left_anti").select("run_id", F.lower(F.trim("idea")).alias("_idea"))
    latest = Window.partitionBy("_idea").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    source = other_runs.withColumn("_idea", F.lower(F.trim("idea"))).withColumn("_k", F.row_number().over(latest)).where("_k = 1").select("_idea", F.col("run_id").alias("_from"))
    found = gaps.join(source, "_idea").select("run_id", "_from")
    new = other_results.withColumnRenamed("run_id", "_from").join(found, "_from").drop("_from")
    return results.unionByName(new.select(*results.columns))


def pack_reports(reports: DataFrame, path: str) -> None:
    """Texts of reports (value) as records of a few files, a JSON line each, so that many reports don't make as many files."""
    reports.select("value").write.json(path)


def parse_reports(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Run reports (one text file each, or ``packed``) to registry rows: idea, tier, pf and trades from their labelled lines."""
    text = spark.read.schema("value string").json(path) if packed else spark.read.text(path, wholetext=True)
    part = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return text.select(
        part(r"(?mi)^#\s*(.+?)\s*$").alias("idea"), part(r"(?mi)^\W*tier\W+([A-Z])\b").alias("tier"),
        part(r"(?mi)\bpf\W+([0-9]+(?:\.[0-9]+)?)").try_cast("double").alias("pf"), part(r"(?mi)\btrades\W+([0-9]+)").try_cast("int").alias("num_trades"),
    )


def file_counts(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Rows of each expected file (``file``, its name or the end of its path): null where it is missing, and whether it is fine (has rows)."""
    depth = expected.agg(F.coalesce(F.max(F.size(F.split("file", "/"))), F.lit(1))).first()[0]
    name = F.array_join(F.slice(F.split("_metadata.file_path", "/"), -depth, depth), "/")
    found = spark.read.parquet(path).groupBy(name.alias("file")).agg(F.count("*").alias("rows"))
    return expected.join(found, "file", "left").withColumn("fine", F.coalesce(F.col("rows") > 0, F.lit(False)))
