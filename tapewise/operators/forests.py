"""Forests of rows of which many are alike: rows of equal features and label are one row with their number, and no tree meets them one by one.

A bootstrap sample takes each row a Poisson(1) number of times, so n equal rows a Poisson(n) number of times together: trees of counted rows follow the same law as trees of all rows.
All forests grow at once, level by level: tasks count their rows by node, feature, bin and label, a shuffle by tree adds the counts up and finds each node's split. The driver holds
splits and cuts, whose number the parameters bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn
from ..sources.store import stage

#: Most bins of a feature.
BINS = 32
#: Trees that a row of the bag tells of, so that a forest of few rows is many tasks.
BLOCK = 25
#: Gains below it are those of rounding.
LEAST_GAIN = 1e-12


def bagged(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """Rows (forest, x, y, n) that are equal as one, for each BLOCK of trees, with ``taken``: how often each tree of the block takes them, a Poisson(n) number drawn from forest, x and y."""

    @F.arrow_udf("array<array<bigint>>")
    def take(seeds: pa.Array, n: pa.Array) -> pa.Array:
        out = np.empty((len(seeds), trees), np.int64)
        for k, (s, m) in enumerate(zip(seeds.to_numpy(), n.to_numpy())):
            out[k] = np.random.RandomState(s).poisson(m, trees)
        first = np.arange(0, trees, BLOCK)
        starts = (np.arange(len(seeds))[:, None] * trees + first).ravel()
        inner = pa.ListArray.from_arrays(np.append(starts, out.size).astype(np.int32), out.ravel())
        return pa.ListArray.from_arrays(np.arange(0, len(starts) + 1, len(first), np.int32), inner)

    met = rows.groupBy("forest", "x", "y").agg(F.sum("n").alias("n"))
    met = met.select("*", F.posexplode(take(drawn(F.col("forest") + F.lit(seed), F.col("x"), "y"), F.col("n"))).alias("block", "taken"))
    met = met.repartitionByRange(2 * rows.sparkSession.sparkContext.defaultParallelism, "forest", "block", F.xxhash64("x", "y"))
    return stage(met.sortWithinPartitions("forest", "block"), "bagged")


def cuts(rows: DataFrame) -> DataFrame:
    """Where features of ``bagged`` rows may be split (forest, feature, cut): halfway between any two neighbouring values, or, of more than BINS values, where they leave bins of about equal numbers of rows."""
    values = rows.where("block = 0").select("forest", "n", F.posexplode("x").alias("feature", "v")).groupBy("forest", "feature", "v").agg(F.sum("n").alias("n"))
    every = Window.partitionBy("forest", "feature")
    order = every.orderBy("v")
    values = values.select("forest", "feature", "v", "n", F.lead("v").over(order).alias("next"), F.sum("n").over(order).alias("upto"), F.sum("n").over(every).alias("all"), F.count("*").over(every).alias("kinds"))
    bin_of = lambda n: F.floor(n * BINS / F.col("all"))
    kept = F.col("next").isNotNull() & ((F.col("kinds") <= BINS) | (bin_of(F.col("upto")) > bin_of(F.col("upto") - F.col("n"))))
    return values.where(kept).select("forest", "feature", ((F.col("v") + F.col("next")) / 2).alias("cut"))


def _tally(at: dict[int, list[np.ndarray]], split: dict[int, tuple[np.ndarray, np.ndarray]], tried: dict[int, np.ndarray], level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts rows by node of the level, feature tried there, bin and label; one row for each tree that the task's rows belong to."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def told(keys: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            for f, block in keys:
                met = [(block * BLOCK + t, c.tobytes()) for t, c in enumerate(sums.pop((f, block))) if c.any()]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(met), pa.int32()), pa.array([t for t, _ in met], pa.int32()), pa.array([c for _, c in met], pa.binary())], ["forest", "tree", "counts"])

        for b in filter(len, batches):
            of, blocks, ys = (b.column(c).to_numpy() for c in ("forest", "block", "y"))
            starts = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1])))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
                f, block = int(of[start]), int(blocks[start])
                xs, takes = (b.column(c).slice(start, end - start).flatten().to_numpy().reshape(end - start, -1) for c in ("x", "taken"))
                bins, y = np.stack([np.searchsorted(c, v) for c, v in zip(at[f], xs.T)], 1), ys[start:end].astype(np.int64)
                counts = sums.setdefault((f, block), np.zeros((takes.shape[1], (1 << level) * tried[f].shape[2] * BINS * 2)))
                for t, taken in enumerate(takes.T, block * BLOCK):
                    _count(counts[t - block * BLOCK], bins, y, taken, split[f][0][t], split[f][1][t], tried[f][t], level)
            yield from told([k for k in sums if k != (f, block)])  # a partition is sorted by forest and block
        yield from told(list(sums))

    return tally


def _count(counts: np.ndarray, bins: np.ndarray, y: np.ndarray, taken: np.ndarray, feature: np.ndarray, cut: np.ndarray, tried: np.ndarray, level: int) -> None:
    """Adds to a tree's counts the rows that reach the level."""
    rows = np.flatnonzero(taken)
    node = np.zeros(len(rows), np.int64)
    for _ in range(level):
        inner = feature[node] >= 0
        rows, node = rows[inner], node[inner]
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    node -= (1 << level) - 1
    k = tried.shape[1]
    spot = ((node[:, None] * k + np.arange(k)) * BINS + bins[rows[:, None], tried[node]]) * 2 + y[rows][:, None]
    counts += np.bincount(spot.ravel(), np.repeat(taken[rows], k), len(counts))


_FOUND = "forest int, tree int, node int, place int, bin int, gain double, share double, low double, high double"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _choose(weights: dict[int, tuple[float, float]], level: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best split of each node of a task's trees: place among the features tried (-1: a leaf), last bin that goes left, what it takes from the node's impurity times its weight,
    and the shares of class 1 in the node and on both sides."""
    impure = lambda c: c.prod(-1) * 2 / np.maximum(c.sum(-1), 1e-300)
    share = lambda c: c[..., 1] / np.maximum(c.sum(-1), 1e-300)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for f, tree, part in zip(*(b.column(c).to_pylist() for c in ("forest", "tree", "counts"))):
                sums[f, tree] = sums.get((f, tree), 0) + np.frombuffer(part)
        for (f, tree), counts in sums.items():
            counts = counts.reshape(1 << level, k, BINS, 2)
            nodes = np.flatnonzero(counts[:, 0].any((1, 2)))
            counts = counts[nodes]
            left = counts.cumsum(2)[:, :, :-1]
            right = counts.sum(2, keepdims=True) - left
            both = (left.sum(-1) > 0) & (right.sum(-1) > 0)
            left, right, whole = left * weights[f], right * weights[f], counts[:, 0].sum(1) * weights[f]
            gains = np.where(both, impure(whole)[:, None, None] - impure(left) - impure(right), -1.0).reshape(len(nodes), -1)
            gain, row, (place, cut) = gains.max(1), np.arange(len(nodes)), np.divmod(gains.argmax(1), BINS - 1)
            shares = share(whole), share(left[row, place, cut]), share(right[row, place, cut])
            place = np.where(gain > LEAST_GAIN * whole.sum(-1), place, -1)
            whose = [pa.array(np.full(len(nodes), v), pa.int32()) for v in (f, tree)]
            yield pa.RecordBatch.from_arrays([*whose, *(pa.array(v, pa.int32()) for v in (nodes + (1 << level) - 1, place, cut)), *map(pa.array, (gain, *shares))], _NAMES)

    return choose


def grow(rows: DataFrame, trees: int, depth: int, seed: int) -> tuple[DataFrame, dict[int, list[float]]]:
    """Forests of rows (forest, x, y, n: how many runs a row stands for), whose classes weigh the same in each: their nodes (forest, tree, id, feature, threshold, left, right, share)
    as ``learner.nodes_of`` has them, and by forest what each feature takes from the impurity, of 1.

    Each node tries the root of the number of features, drawn for it, and takes the best cut by Gini's impurity; leaves are pure, at ``depth``, or have no cut that gains.
    Leaves of one node that predict the same class are merged into it, as in Spark's forests.
    """
    spark, bag = rows.sparkSession, bagged(rows, trees, seed)
    totals = bag.where("block = 0").groupBy("forest").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good"), F.max(F.size("x")).alias("features")).collect()
    share = {r.forest: r.good / r.n for r in totals}
    weights = {f: (0.5 / max(1 - s, 1e-9), 0.5 / max(s, 1e-9)) for f, s in share.items()}
    features = max(r.features for r in totals)
    k = math.ceil(math.sqrt(features))
    at = {f: [[] for _ in range(features)] for f in share}
    for r in cuts(bag).collect():
        at[r.forest][r.feature].append(r.cut)
    at = {f: [np.sort(c) for c in by] for f, by in at.items()}
    most = (2 << depth) - 1  # nodes of a whole tree; the children of node i are 2 i + 1 and 2 i + 2
    split = {f: (np.full((trees, most), -1, np.int16), np.zeros((trees, most), np.int16)) for f in share}
    shares = {f: np.full((trees, most), 0.5) for f in share}
    gains = {f: np.zeros((trees, most)) for f in share}
    for level in range(depth):
        draws = {f: np.random.RandomState([seed, f, level]).random_sample((trees, 1 << level, features)) for f in share}
        tried = {f: np.sort(d.argsort(2)[:, :, :k], 2).astype(np.int16) for f, d in draws.items()}
        counts = bag.mapInArrow(_tally(at, split, tried, level), "forest int, tree int, counts binary")
        found = counts.repartition(spark.sparkContext.defaultParallelism, "forest", "tree").mapInArrow(_choose(weights, level, k), _FOUND).collect()
        for f, t, node, place, cut, gain, own, low, high in found:
            shares[f][t, node] = own
            if place >= 0:
                j = tried[f][t, node - (1 << level) + 1, place]
                split[f][0][t, node], split[f][1][t, node] = j, cut
                shares[f][t, 2 * node + 1], shares[f][t, 2 * node + 2] = low, high
                gains[f][t, node] = gain
        if not any(r.place >= 0 for r in found):
            break
    for f in share:
        _prune(split[f][0], shares[f], depth)
    nodes = pa.concat_tables([_nodes(f, at[f], *split[f], shares[f]) for f in share])
    taken = {f: np.stack([np.where(split[f][0] == j, gains[f], 0.0).sum(1) for j in range(features)], 1) for f in share}
    per = {f: g / np.maximum(g.sum(1, keepdims=True), 1e-300) for f, g in taken.items()}  # trees count the same
    return stage(spark.createDataFrame(nodes), "nodes"), {f: (g.sum(0) / max(g.sum(), 1e-300)).tolist() for f, g in per.items()}


def _prune(feature: np.ndarray, shares: np.ndarray, depth: int) -> None:
    """Nodes whose two children are leaves that predict the same class become leaves, from below."""
    for level in reversed(range(depth)):
        node = np.arange((1 << level) - 1, (2 << level) - 1)
        low, high = 2 * node + 1, 2 * node + 2
        alike = (shares[:, low] > 0.5) == (shares[:, high] > 0.5)
        feature[:, node] = np.where(alike & (feature[:, low] < 0) & (feature[:, high] < 0), -1, feature[:, node])


def _nodes(forest: int, at: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, shares: np.ndarray) -> pa.Table:
    """The nodes that a forest's trees have, numbered from 0 in each."""
    inner = feature >= 0
    there = np.ones_like(inner)
    there[:, 1:] = np.repeat(inner[:, : inner.shape[1] // 2], 2, 1)
    ids = there.cumsum(1) - 1
    tree, node = np.nonzero(there)
    inner = inner[tree, node]
    child = lambda side: np.where(inner, ids[tree, np.where(inner, 2 * node + side, 0)], -1)
    where = [float(at[j][b]) if j >= 0 else None for j, b in zip(feature[tree, node].tolist(), cut[tree, node].tolist())]
    columns = {"forest": np.full(len(tree), forest), "tree": tree, "id": ids[tree, node], "feature": feature[tree, node], "threshold": where, "left": child(1), "right": child(2), "share": shares[tree, node]}
    return pa.table({c: pa.array(v, pa.float64() if c in ("threshold", "share") else pa.int32()) for c, v in columns.items()})
