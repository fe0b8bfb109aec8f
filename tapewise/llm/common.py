"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets into which a group is cut before its rows are numbered.
RANK_BUCKETS = 1024
#: Tasks over which a hot key's rows are spread; rows of one key beyond which a large value is copied to several tasks.
SALTS, SPREAD_ROWS = 64, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only in local mode a temporary one may stand in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


class Workspace:
    """Intermediate tables of one job, as Parquet in the shared folder: lineage ends with each, and lost executors don't matter."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing still to be computed reads."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back."""
    return Workspace(df.sparkSession, tag).write(df, "all")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for the small tables of iterative jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: inside it no name clashes with an operator's own columns; ``unboxed`` gives them back."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def unboxed(box: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(box).getField(c).alias(c) for c in columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    while name in df.columns:
        name = "_" + name
    return name


def _salted(df: DataFrame, by: str) -> tuple[DataFrame, str]:
    salt = fresh(df, "_salt")
    return df.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")), salt


def with_totals(df: DataFrame, keys: Sequence[str], by: str, totals: Mapping[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """``df`` with values of each group of ``keys``: {name: (aggregate of some rows, aggregate of such values)}.

    Rows meet in (keys, salt of ``by``), so a group that holds a third of all rows is spread over SALTS tasks; the parts' values, at
    most SALTS a group, are combined first. ``df`` is read twice. Keys must not be null.
    """
    (salted, salt), whole = _salted(df, by), Window.partitionBy(*keys)
    parts = salted.groupBy(*keys, salt).agg(*[part.alias(name) for name, (part, _) in totals.items()])
    parts = parts.select(*keys, salt, *[combine(F.col(name)).over(whole).alias(name) for name, (_, combine) in totals.items()])
    return salted.join(parts, [*keys, salt]).drop(salt)


def looked_up(df: DataFrame, values: DataFrame, keys: Sequence[str], by: str, how: str = "left") -> DataFrame:
    """``df`` joined with ``values``, which has one row per key. As in ``with_totals`` no key's rows meet in one task; ``df`` is read twice."""
    salted, salt = _salted(df, by)
    known = salted.select(*keys, salt).distinct().join(values, list(keys))
    return salted.join(known, [*keys, salt], how).drop(salt)


def dealt(df: DataFrame, keys: Sequence[str], by: str, deal: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` with a column ``deal``: a key with n rows is dealt over ceil(n / rows) places by ``by``."""
    sized = with_totals(df, keys, by, {deal: (F.count("*"), F.sum)})
    return sized.withColumn(deal, F.pmod(F.xxhash64(by), F.ceil(F.col(deal) / rows)))


def copied(values: DataFrame, df: DataFrame, keys: Sequence[str], deal: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """Large ``values``, one row per key, with a copy for each place over which ``dealt`` deals the key's rows."""
    fans = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("_fan"))
    return values.join(fans, list(keys)).withColumn(deal, F.explode(F.sequence(F.lit(0), F.col("_fan") - 1))).drop("_fan")


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    """63-bit hash of the columns under a seed, never negative; nulls hash too."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def rank_in_groups(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], rank: str, total: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Number the rows of each group from 0 (column ``rank``) and add the group's size (``total``).

    ``bucket`` maps a row to 0..buckets-1 and must not decrease in the sort order ``order``. Rows meet in
    (group, bucket), so a group that holds a third of all rows is still spread over ``buckets`` tasks; the
    buckets' offsets come from their counts. Group columns must not be null. Rows that tie in ``order`` get different
    ranks in any order.
    """
    keyed = df.withColumn("_bucket", bucket.cast("int"))
    at = [*groups, "_bucket"]
    of_group = Window.partitionBy(*groups).orderBy("_bucket")
    offsets = (
        keyed.groupBy(*at).agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(total, F.sum("_rows").over(Window.partitionBy(*groups)))
        .drop("_rows")
    )
    numbered = keyed.withColumn("_at", F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1)
    return numbered.join(offsets, at).withColumn(rank, F.col("_offset") + F.col("_at")).drop("_bucket", "_at", "_offset")


def hash_bucket(column: str, buckets: int = RANK_BUCKETS) -> Column:
    """Bucket of a 63-bit hash by its leading bits, so buckets follow the order of the hash."""
    return F.shiftright(F.col(column), 63 - (buckets - 1).bit_length())


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes, however many rounds that takes. A node with very many
    neighbours is spread over tasks. Nulls and loops are ignored. Nodes without an edge do not appear.
    """
    least = {"m": (F.min("b"), F.min)}
    links = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_totals(both, ["a"], "b", least).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = with_totals(large, ["a"], "b", least)
        links = cut(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
