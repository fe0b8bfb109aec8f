"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, hash_bucket, quoted, rank_in_groups, seeded_hash, unboxed

FRACTION_BUCKETS = 4096


def stratified_shards(rows: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", seed: int = 17) -> DataFrame:
    """Deal ``rows`` into ``shards`` shards whose row counts differ by one at most and that all match the mixture.

    Rows are shuffled by a seeded hash and ranked within their stratum; the fractional rank
    (2k+1)/(2n) orders all strata together, and equal cuts of that order are the shards. Adds ``shard`` (int)
    and ``slot`` (long, gapless from 0 in each shard). Null strata form one stratum, null keys and repeated
    rows are kept (equal rows are interchangeable), empty input gives empty output. Columns named like the
    two results are replaced; other columns may have any names.
    """
    rows = rows.drop("shard", "slot")
    stratum_text = F.coalesce(F.concat(F.lit("="), F.col(quoted(stratum)).cast("string")), F.lit(""))
    spread = rows.select(stratum_text.alias("_stratum"), F.col(quoted(key)).alias("_key"), seeded_hash(seed, quoted(key)).alias("_hash"), boxed(rows).alias("_row"))
    ranked = rank_in_groups(spread, ["_stratum"], hash_bucket("_hash"), [F.col("_hash"), F.col("_key")], "_k", "_n")
    ranked = ranked.withColumn("_fraction", (2 * F.col("_k") + 1) / (2 * F.col("_n"))).withColumn("_all", F.lit(0))
    bucket = F.floor(F.col("_fraction") * FRACTION_BUCKETS)
    order = [F.col("_fraction"), F.col("_hash"), F.col("_stratum"), F.col("_key")]
    placed = rank_in_groups(ranked, ["_all"], bucket, order, "_position", "_total", FRACTION_BUCKETS)
    first = F.expr(f"((shard * _total) + {shards} - 1) div {shards}")
    placed = placed.withColumn("shard", F.expr(f"int((_position * {shards}) div _total)")).withColumn("slot", F.col("_position") - first)
    return placed.select(*unboxed("_row", rows.columns), "shard", "slot")
