"""Chains of bar states: counts, lift before an event, transitions, look-up with back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_chunk, windowed
from .joins import forward_join

ARROW = "→"


def chained(bars: DataFrame, state: str = "state", most: int = 3) -> DataFrame:
    """chain_1 .. chain_n: the last states before the bar, oldest first; null where the series is too short."""

    def build(b: DataFrame) -> DataFrame:
        for k in range(1, most + 1):
            parts = [F.lag(state, i).over(by_chunk()) for i in range(k, 0, -1)]
            b = b.withColumn(f"chain_{k}", F.when(parts[0].isNotNull(), F.concat_ws(ARROW, *parts)))
        return b

    return windowed(bars, build, back=most)


def chain_lift(bars: DataFrame, event: Column, least: int = 10, most: int = 3) -> DataFrame:
    """Per symbol, length and chain: hits before an event, hits before any bar, and lift = P(chain | event) / P(chain).

    The baseline is all bars; chains with fewer than ``least`` hits overall are dropped.
    """
    b = chained(bars, most=most).withColumn("_e", F.coalesce(event, F.lit(False)))
    long = b.select("symbol", "_e", F.expr(f"stack({most}, {', '.join(f'{k}, chain_{k}' for k in range(1, most + 1))}) AS (length, chain)")).where("chain is not null")
    counts = long.groupBy("symbol", "length", "chain").agg(F.count("*").alias("bars"), F.count_if("_e").alias("events"))
    of = Window.partitionBy("symbol", "length")
    counts = counts.withColumn("_b", F.sum("bars").over(of)).withColumn("_n", F.sum("events").over(of)).where(F.col("bars") >= least)
    lift = F.try_divide(F.try_divide("events", "_n"), F.col("bars") / F.col("_b"))
    return counts.select("symbol", "length", "chain", "bars", "events", F.round(lift, 6).alias("lift"))


def top_chains(lifts: DataFrame, n: int = 15) -> DataFrame:
    """The n most frequent chains before events, per symbol and length."""
    order = Window.partitionBy("symbol", "length").orderBy(F.col("events").desc(), "chain")
    return lifts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def transitions(bars: DataFrame, state: str = "state") -> DataFrame:
    """Per symbol: how often ``prev`` is followed by ``cur``, and the share among all that follows ``prev``."""
    pairs = windowed(bars, lambda b: b.withColumn("prev", F.lag(state).over(by_chunk())), back=1).where("prev is not null")
    counts = pairs.groupBy("symbol", "prev", F.col(state).alias("cur")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "prev")), 6))


def next_paths(matrix: DataFrame, latest: DataFrame, depth: int = 3, top: int = 3) -> DataFrame:
    """The most likely paths of ``depth`` states after each symbol's latest state (symbol, state), by products of shares."""
    paths = latest.select("symbol", F.col("state").alias("at"), F.lit("").alias("path"), F.lit(1.0).alias("p"))
    for _ in range(depth):
        step = matrix.select("symbol", F.col("prev").alias("at"), "cur", "share")
        paths = paths.join(step, ["symbol", "at"]).select(
            "symbol", F.col("cur").alias("at"), F.when(F.col("path") == "", F.col("cur")).otherwise(F.concat_ws(ARROW, "path", "cur")).alias("path"), (F.col("p") * F.col("share")).alias("p")
        )
    order = Window.partitionBy("symbol").orderBy(F.col("p").desc(), "path")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("symbol", "rank", "path", F.round("p", 6).alias("p"))


def grade(bars: DataFrame, lifts: DataFrame) -> DataFrame:
    """Lift of the longest chain that the lift table knows (3, then 2, then 1 steps), and a grade: A >= 3, B >= 2, C >= 1, else D."""
    b = chained(bars)
    for k in (3, 2, 1):
        table = lifts.where(F.col("length") == k).select("symbol", F.col("chain").alias(f"chain_{k}"), F.col("lift").alias(f"_l{k}"))
        b = b.join(table, ["symbol", f"chain_{k}"], "left")
    lift = F.coalesce("_l3", "_l2", "_l1")
    b = b.withColumn("lift", lift).withColumn("grade", F.when(lift >= 3, "A").when(lift >= 2, "B").when(lift >= 1, "C").otherwise("D"))
    return b.drop("_l1", "_l2", "_l3")


def split_lift(bars: DataFrame, chain: str, filters: dict[str, Column], event: Column, parts: tuple[float, float] = (0.7, 0.9), least: int = 5) -> DataFrame:
    """Lift of a chain under each filter on the first 70 %, the next 20 % and the last 10 % of each symbol's bars."""
    sizes = bars.groupBy("symbol").agg((F.max("bar_no") + 1).alias("_n"))
    b = chained(bars).join(sizes, "symbol").withColumn("_f", F.col("bar_no") / F.col("_n"))
    fold = F.when(F.col("_f") < parts[0], "train").when(F.col("_f") < parts[1], "valid").otherwise("blind")
    names = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in {"none": F.lit(True), **filters}.items()])
    b = b.withColumn("fold", fold).withColumn("filter", F.explode(F.array_compact(names))).withColumn("_e", F.coalesce(event, F.lit(False)))
    is_chain = F.coalesce(F.col(f"chain_{chain.count(ARROW) + 1}") == chain, F.lit(False))
    out = b.groupBy("symbol", "fold", "filter").agg(F.count("*").alias("bars"), F.count_if("_e").alias("events"), F.count_if(is_chain).alias("hits"), F.count_if(is_chain & F.col("_e")).alias("both"))
    lift = F.try_divide(F.try_divide("both", "hits"), F.try_divide("events", "bars"))
    return out.withColumn("lift", F.when(F.col("hits") >= least, F.round(lift, 6)))


def component_test(bars: DataFrame, flags: dict[str, Column], horizon: int = 15, multiples: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Per symbol and component: bars where it holds, and the shares of them that see moves of so many ATRs within the horizon."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    events = bars.where("atr is not null").withColumn("component", F.explode(names)).select("symbol", "bar_no", "component", "close", "atr")
    steps = forward_join(events, bars.select("symbol", "bar_no", "chunk", "chunk_len", "high", "low"), horizon, ["high", "low"])
    move = F.try_divide(F.greatest(F.col("high") - F.col("close"), F.col("close") - F.col("low")), F.col("atr"))
    per = steps.groupBy("symbol", "component", "bar_no").agg(F.max(move).alias("_m"))
    return per.groupBy("symbol", "component").agg(F.count("*").alias("events"), *[F.round(F.avg((F.col("_m") >= m).cast("int")), 6).alias(f"win_{m:g}") for m in multiples])


def lead_lag(bars: DataFrame, other: DataFrame, lags: int = 5) -> DataFrame:
    """Correlation of close-to-close returns of two series of a symbol for shifts of -lags..lags bars."""

    def returns(df: DataFrame, name: str) -> DataFrame:
        r = windowed(df, lambda b: b.withColumn(name, F.try_divide(F.col("close"), F.lag("close").over(by_chunk())) - 1), back=1)
        return r.select("symbol", "bar_no", name)

    a = returns(bars, "ra").withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("_to", F.col("bar_no") + F.col("lag"))
    b = returns(other, "rb").withColumnRenamed("bar_no", "_to")
    return a.join(b, ["symbol", "_to"]).groupBy("symbol", "lag").agg(F.count(F.col("ra") + F.col("rb")).alias("n"), F.round(F.corr("ra", "rb"), 6).alias("corr"))
