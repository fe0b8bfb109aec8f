"""Windows over chunks of a symbol's bars, and values carried across chunks.

A symbol may be too long for one task. Operators that look back or ahead a bounded number of bars run
on chunks with copied edges (``windowed``); running counts and last known values are computed per chunk and joined
with what the chunks before leave behind (``running_sum``, ``carried``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.bars import keyed


def by_chunk() -> WindowSpec:
    """The bars of a chunk in order."""
    return Window.partitionBy("symbol", "chunk").orderBy("bar_no")


def last(n: int, including: bool = True) -> WindowSpec:
    """The last ``n`` bars, with the current one or before it."""
    return by_chunk().rowsBetween(1 - n, 0) if including else by_chunk().rowsBetween(-n, -1)


def next_(n: int, including: bool = False) -> WindowSpec:
    return by_chunk().rowsBetween(0 if including else 1, n)


def windowed(bars: DataFrame, build: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0) -> DataFrame:
    """``build(bars)`` with windows over by_chunk that reach ``back`` bars back and ``ahead`` bars ahead at most.

    Each chunk gets copies of the bars it needs from its neighbours; the copies are dropped afterwards. With
    chunks much longer than the reach, few rows are copied. Reaches may exceed the chunk length.
    """
    bars = keyed(bars)
    first = F.expr(f"greatest(bar_no - {ahead}, 0L) div chunk_len")
    final = F.expr(f"(bar_no + {back}) div chunk_len")
    copies = bars.withColumn("_home", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(first, final)))
    return build(copies).where("chunk = _home").drop("_home")


def running_sum(bars: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all bars of the symbol up to the current one."""
    return running_sums(bars, {out: value})


def running_sums(bars: DataFrame, values: dict[str, str]) -> DataFrame:
    """Sums over all bars of the symbol up to the current one, as {result: column}."""
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    left = bars.groupBy("symbol", "chunk").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in values.items()])
    left = left.select("symbol", "chunk", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in values])
    up_to = by_chunk().rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.select("*", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"_w_{o}") for o, c in values.items()]).join(left, ["symbol", "chunk"])
    return bars.select("*", *[(F.col(f"_b_{o}") + F.col(f"_w_{o}")).alias(o) for o in values]).drop(*[f"_{k}_{o}" for o in values for k in "wb"])


def carried(bars: DataFrame, values: dict[str, str], including: bool = True, before: str | None = None) -> DataFrame:
    """Last non-null value of each column, as {result: column}, up to the current bar or before it.

    With ``before`` both are added: up to the current bar under the result's name, before it under that name and this ending.
    """
    earlier = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    left = bars.groupBy("symbol", "chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_no"))).alias(f"_l_{o}") for o, c in values.items()])
    left = left.select("symbol", "chunk", *[F.last(f"_l_{o}", ignorenulls=True).over(earlier).alias(f"_b_{o}") for o in values])
    ends = {"": 0, before: -1} if before else {"": 0 if including else -1}
    frames = {end: by_chunk().rowsBetween(Window.unboundedPreceding, to) for end, to in ends.items()}
    within = [F.last(c, ignorenulls=True).over(frame).alias(f"_w_{o}{end}") for o, c in values.items() for end, frame in frames.items()]
    bars = bars.select("*", *within).join(left, ["symbol", "chunk"])
    out = bars.select("*", *[F.coalesce(f"_w_{o}{end}", f"_b_{o}").alias(f"{o}{end}") for o in values for end in ends])
    return out.drop(*[f"_w_{o}{end}" for o in values for end in ends], *[f"_b_{o}" for o in values])


def flag(condition: Column) -> Column:
    """A condition as a boolean that is never null."""
    return F.coalesce(condition, F.lit(False))


def rising(column: str) -> Column:
    """A flag that is true now and was not at the bar before (look-back 1)."""
    return F.col(column) & ~F.coalesce(F.lag(column).over(by_chunk()), F.lit(False))


def islands(bars: DataFrame, column: str, out: str) -> DataFrame:
    """Number of the current run of a true flag, from 1 per symbol; null outside of runs. The last run ends with the data."""
    starts = windowed(bars, lambda b: b.withColumn("_start", rising(column).cast("long")), back=1)
    return running_sum(starts, "_start", "_runs_so_far").withColumn(out, F.when(F.col(column), F.col("_runs_so_far"))).drop("_start", "_runs_so_far")


#: Bars whose part of a recursion is one weighted sum.
RECURSION_BLOCK = 64


def recursion(bars: DataFrame, values: dict[str, str], fade: float) -> DataFrame:
    """Exact recursions y = fade * (y of the bar before) + value over all bars of the symbol, 0 before the first; as {result: column}, nulls count as 0.

    Within a block of RECURSION_BLOCK bars y is a weighted running sum, of constant cost for each bar. A block maps what comes in to what goes out by y -> a * y + b; these maps are composed
    block by block within a chunk, and chunk by chunk within a symbol.
    """
    if not 1e-4 < fade < 1:
        raise ValueError("fade must lie between 0.0001 and 1")
    b = bars.withColumn("_block", F.expr(f"(bar_no - chunk * chunk_len) div {RECURSION_BLOCK}")).withColumn("_at", F.expr(f"(bar_no - chunk * chunk_len) % {RECURSION_BLOCK}"))
    up_to = Window.partitionBy("symbol", "chunk", "_block").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda n: F.pow(F.lit(fade), n)
    b = b.select("*", *[(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * power(-F.col("_at"))).over(up_to) * power(F.col("_at"))).alias(f"_y_{o}") for o, c in values.items()])
    ends = b.groupBy("symbol", "chunk", "_block").agg(F.count("*").alias("n"), *[F.max_by(f"_y_{o}", "bar_no").alias(o) for o in values])

    def composed(steps: DataFrame, keys: list[str], at: str) -> DataFrame:
        """Per group of ``keys`` the maps of its parts in order of ``at``: bars before each part and what comes in, if nothing comes into the group; the whole map under a null part."""
        lists = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, "n", *values))).alias("_p"))
        outs = ", ".join(f"s[size(s) - 1].`{o}` * pow({fade!r}D, p.n) + p.`{o}` AS `{o}`" for o in values)
        start = ", ".join(f"0D AS `{o}`" for o in values)
        fold = f"aggregate(_p, array(struct(0L AS before, {start})), (s, p) -> concat(s, array(struct(s[size(s) - 1].before + p.n AS before, {outs}))))"
        parts = lists.select(*keys, F.transform("_p", lambda p: p[at]).alias("_k"), F.expr(fold).alias("_s"))
        return parts.select(*keys, F.posexplode("_s").alias("_i", "_x"), "_k").select(*keys, F.expr("IF(_i < size(_k), _k[_i], NULL)").alias(at), "_x.*")

    blocks = composed(ends, ["symbol", "chunk"], "_block")
    chunks = composed(blocks.where("_block is null").drop("_block").withColumnRenamed("before", "n"), ["symbol"], "chunk").where("chunk is not null")
    into = blocks.where("_block is not null").join(chunks.select("symbol", "chunk", *[F.col(o).alias(f"_c_{o}") for o in values]), ["symbol", "chunk"])
    into = into.select("symbol", "chunk", "_block", *[(F.col(o) + F.col(f"_c_{o}") * power(F.col("before"))).alias(f"_i_{o}") for o in values])
    b = b.join(into, ["symbol", "chunk", "_block"])
    return b.select(*bars.columns, *[(F.col(f"_y_{o}") + F.col(f"_i_{o}") * power(F.col("_at") + 1)).alias(o) for o in values])
