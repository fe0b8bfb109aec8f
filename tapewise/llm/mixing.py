"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, cut, hash_bucket, looked_up, quoted, rank_in_groups, seeded_hash, unboxed

#: Tables of at most so many narrow rows are sent to every task; larger ones are shuffled.
SENT_ROWS = 200_000
#: Slots that one fold fills before its result is put aside.
CHUNK = 512

# Fluid schedule within a cycle: blocks given out until the virtual time p / d, times d. ``steps`` are the cycle's steps: in step j of the
# sources of weight w, from j / w to (j + 1) / w, each of the m sources that still have rows gives one block.
_FLUID = "aggregate(steps, 0L, (t, u) -> t + u.m * least(greatest(({p}) * u.w - u.j * ({d}), 0L), {d}))"
# One lane for each weight: its blocks, the sources taking turns. The window of a block lies in that of the source's own block.
_LANES = f"""
    transform(array_sort(array_distinct(transform(steps, s -> s.w))), v -> flatten(transform(filter(steps, s -> s.w = v), s ->
        transform(sequence(0L, s.m - 1), i -> struct(
            ({_FLUID.format(p="s.j * s.m + i + 1", d="s.m * s.w")} + s.m * s.w - 1) div (s.m * s.w) AS deadline,
            {_FLUID.format(p="s.j * s.m + i", d="s.m * s.w")} div (s.m * s.w) AS release,
            s.w AS w, s.j AS j, i AS i)))))
"""
# Earliest deadline first: at each slot, among the lanes' next blocks, the released one with the first deadline.
_EDF = f"""
    aggregate(
        sequence(0, int((length - 1) div {CHUNK})),
        struct(transform(lanes, l -> 0) AS at, cast(array() AS array<array<struct<at: bigint, w: bigint, j: bigint, i: bigint>>>) AS parts),
        (s, c) -> transform(
            array(aggregate(
                sequence(c * {CHUNK}L, least(length, (c + 1) * {CHUNK}L) - 1),
                struct(s.at AS at, cast(array() AS array<struct<at: bigint, w: bigint, j: bigint, i: bigint>>) AS done),
                (q, t) -> transform(
                    array(array_min(filter(
                        transform(lanes, (l, k) -> struct(get(l, q.at[k]).deadline AS deadline, k AS lane, get(l, q.at[k]) AS block)),
                        x -> x.block.release <= t))),
                    x -> struct(transform(q.at, (p, k) -> p + IF(k = x.lane, 1, 0)) AS at,
                                concat(q.done, array(struct(t AS at, x.block.w AS w, x.block.j AS j, x.block.i AS i))) AS done))[0])),
            r -> struct(r.at AS at, concat(s.parts, array(r.done)) AS parts))[0],
        s -> flatten(s.parts))
"""


def _scale(cycle: str) -> str:
    """A key that grows with the cycle, exact up to 256 and then with nine leading bits: few rows cover any stretch of cycles."""
    bits = f"greatest(length(bin({cycle})) - 9, 0)"
    return f"int({bits} * 256 + shiftright({cycle}, {bits}))"


def _stretches(sources: DataFrame) -> DataFrame:
    """(lo, hi, base, length, steps): the stretches of equal cycles, each with the slots before it and the steps of a cycle.

    A cycle is one unit of virtual time: a source of weight w gives w blocks, or what is left. No block's window crosses a cycle.
    """
    ends = sources.select(F.explode(F.expr("array(0L, n div w, (n + w - 1) div w)")).alias("lo")).distinct()
    spans = ends.withColumn("hi", F.lead("lo").over(Window.orderBy("lo"))).where("hi is not null")
    classes = sources.select("w").distinct()
    asked = spans.crossJoin(F.broadcast(classes)).select("lo", "hi", "w", F.explode(F.expr("sequence(0L, w - 1)")).alias("j"))
    asked = asked.select("w", (F.col("lo") * F.col("w") + F.col("j")).alias("at"), F.lit(0).cast("long").alias("sources"), "lo", "hi", "j")
    none = F.lit(None).cast("long")
    held = sources.groupBy("w", F.col("n").alias("at")).agg(F.count("*").alias("sources")).select("*", none.alias("lo"), none.alias("hi"), none.alias("j"))
    more = Window.partitionBy("w").orderBy(F.desc("at"), F.col("sources") > 0).rowsBetween(Window.unboundedPreceding, 0)
    steps = asked.unionByName(held).withColumn("m", F.sum("sources").over(more)).where("lo is not null and m > 0")
    cycles = steps.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.struct("w", "j", "m"))).alias("steps"), F.sum("m").alias("length"))
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return cycles.withColumn("base", F.coalesce(F.sum(F.expr("(hi - lo) * length")).over(before), F.lit(0)).cast("long"))


def weight_of(source: Column, weights: Mapping[str, int], default: int) -> Column:
    found = F.lit(None).cast("long")
    if weights:
        found = F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), source)
    return F.coalesce(found, F.lit(default)).cast("long")


def _matched(rows: DataFrame, values: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.join(F.broadcast(values), keys) if n <= SENT_ROWS else looked_up(rows, values, keys, "_hash", "inner")


def pfair_mix(rows: DataFrame, weights: Mapping[str, int], default_weight: int = 1, source: str = "source", key: str = "doc_id", seed: int = 23) -> DataFrame:
    """Order all ``rows`` so that every prefix holds each source to within one block (row) of its target share.

    ``weights``: positive integers; a source's share is its weight over the weights of the sources that still
    have rows. Sources not named get ``default_weight``. Block k of a source with weight w is released at
    virtual time k/w and due at (k+1)/w, both turned into slots by the fluid schedule; earliest-deadline-first
    fills the slots. Sources of equal weight take turns in one lane, each turn's window lying in that of the source's block, so
    the schedule looks at as many lanes as there are weights, for any number of sources. Adds ``weight``, ``block`` (rank in
    the source after a seeded shuffle), ``release``, ``deadline`` and ``slot``, all long; slots run from 0 to rows-1 and
    release <= slot < deadline.

    Cycles with the same sources left have the same schedule, which is made once; there are at most twice as many such stretches
    as sources, and all schedules together have no more entries than there are rows. One task makes a schedule, which has as
    many entries as the sum of the weights of the sources left.

    Every row appears once: when a source runs out, the others share its slots by their weights. Null sources
    count as the source ''. Null keys, repeated rows and empty tables are fine; equal keys take ranks in any order. Columns
    named like the results are replaced; other columns may have any names.
    """
    if any(w < 1 for w in [*weights.values(), default_weight]):
        raise ValueError("weights are positive integers")
    rows = rows.drop("weight", "block", "release", "deadline", "slot")
    keyed = rows.select(
        F.coalesce(F.col(quoted(source)).cast("string"), F.lit("")).alias("_source"), F.col(quoted(key)).alias("_key"),
        seeded_hash(seed, quoted(key)).alias("_hash"), boxed(rows).alias("_row"),
    )
    counts = keyed.groupBy("_source").agg(F.count("*").alias("n")).withColumn("w", weight_of(F.col("_source"), weights, default_weight))
    # sources that have rows longer come first in their lane, so that those still there are the first m
    sources = cut(rank_in_groups(counts, ["w"], F.expr("64 - length(bin(n))"), [F.desc("n"), F.col("_source")], "i", "_m", 64).drop("_m"))
    stretches = cut(_stretches(sources))
    n_sources, (n_stretches, n_slots) = sources.count(), stretches.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    plan = (
        stretches.repartition("lo").withColumn("lanes", F.expr(_LANES))
        .select("lo", F.explode(F.expr(_EDF)).alias("x")).select(F.col("lo").alias("_lo"), "x.w", F.col("x.j").alias("_j"), "x.i", "x.at")
    )
    windows = stretches.select("lo", "steps", F.explode("steps").alias("s")).select(
        F.col("lo").alias("_lo"), "s.w", F.col("s.j").alias("_j"),
        F.expr(f"{_FLUID.format(p='s.j', d='s.w')} div s.w").alias("first"),
        F.expr(f"({_FLUID.format(p='s.j + 1', d='s.w')} + s.w - 1) div s.w").alias("last"),
    )
    plan = cut(plan.join(windows, ["_lo", "w", "_j"]))
    spans = stretches.selectExpr("lo AS _lo", "hi AS _hi", "base", "length", f"explode(sequence({_scale('lo')}, {_scale('hi - 1')})) AS _scale")
    ranked = rank_in_groups(keyed, ["_source"], hash_bucket("_hash"), [F.col("_hash"), F.col("_key")], "block", "_n")
    ranked = _matched(ranked, sources.drop("n"), ["_source"], n_sources).withColumn("_cycle", F.expr("block div w")).withColumn("_j", F.expr("block % w"))
    placed = _matched(ranked.withColumn("_scale", F.expr(_scale("_cycle"))), spans, ["_scale"], n_stretches).where("_cycle >= _lo and _cycle < _hi")
    placed = _matched(placed, plan, ["_lo", "w", "_j", "i"], n_slots)
    start = F.col("base") + (F.col("_cycle") - F.col("_lo")) * F.col("length")
    return placed.select(
        *unboxed("_row", rows.columns), F.col("w").alias("weight"), "block",
        (start + F.col("first")).alias("release"), (start + F.col("last")).alias("deadline"), (start + F.col("at")).alias("slot"),
    )
