"""Near-duplicate embeddings by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components, looked_up, quoted

#: Least number of reference points, how their number grows with the cube root of the vectors, and the most there are.
PIVOTS, GROWTH, MOST_PIVOTS = 512, 50, 4096
#: How many nearest points describe a vector and how many two vectors must share: where a sample has no vector of a length, and what is tried on a sample.
NEAREST, SHARED = 7, 3
SCHEMES = ((7, 3), (10, 3), (12, 3), (14, 3), (5, 2), (6, 2), (8, 2), (10, 2), (14, 2))
#: Bound on the vectors that reference points are chosen from; points closer than one of these cosines aren't chosen together.
SAMPLE, APART = 8192, (0.5, 0.9)
#: Vectors of the sample on which schemes are tried (filled up to LEAST_TRIALS with random directions), the recall that one must reach there, and how many comparisons an entry of a list costs.
TRIALS, LEAST_TRIALS, RECALL, ENTRY_COST = 1000, 100, 0.96, 200
#: Rows of a block; longer lists are compared block by block, STRIP rows at a time.
BLOCK, STRIP = 4000, 512
LEAST = 0.93


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, dim: int, count: int = PIVOTS, apart: float = APART[0]) -> np.ndarray:
    """``count`` unit vectors, from the sample as long as they lie apart, then seeded random directions."""
    chosen = np.empty((0, dim))
    if len(sample):
        x = unit(sample)
        nearest = np.full(len(x), -1.0)
        for i in range(len(x)):
            if len(chosen) == count:
                break
            if nearest[i] < apart:
                chosen = np.vstack([chosen, x[i]])
                nearest = np.maximum(nearest, x @ x[i])
    if len(chosen) < count:
        chosen = np.vstack([chosen, unit(np.random.default_rng(dim).normal(size=(count - len(chosen), dim)))])
    return chosen


def permutation_prefix(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Indices of the nearest pivots of each row, in ascending order of the index."""
    nearest = min(nearest, len(pivots))
    return np.sort(np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :nearest], axis=1)


class Index(NamedTuple):
    """Reference points, how many nearest ones describe a vector, how many two vectors must share."""

    pivots: np.ndarray
    nearest: int
    shared: int


def fit_index(sample: np.ndarray, dim: int, rows: int, least: float, pivots: int | None = None) -> Index:
    """The cheapest index that finds partners at the threshold, by trial on a sample.

    Vectors that are no reference points get a partner each of a cosine just above ``least`` in a random direction. Among the schemes with a recall of RECALL the one with the
    fewest expected comparisons (pairs of the sample that share enough points) and list entries for ``rows`` vectors wins; if there is none, the one with the best recall.
    Vectors with a common mean or in clusters get points from their midst and stricter or looser schemes, where random ones would put all of them into the same lists.
    """
    trials, draw = min(TRIALS, len(sample) // 3), np.random.default_rng(dim)
    tried, base = (unit(sample[:trials]) if trials else np.empty((0, dim))), sample[trials:]
    if trials < LEAST_TRIALS:  # too few to tell: random directions beside them
        tried = np.vstack([tried, unit(draw.normal(size=(LEAST_TRIALS - trials, dim)))])
        trials = LEAST_TRIALS
    side = draw.normal(size=tried.shape)
    side = unit(side - (side * tried).sum(axis=1, keepdims=True) * tried) if dim > 1 else np.zeros_like(tried)
    cosine = draw.uniform(least, least + (1 - least) / 4, (trials, 1))
    partners = cosine * tried + np.sqrt(1 - cosine * cosine) * side
    count = pivots or min(MOST_PIVOTS, max(PIVOTS, int(GROWTH * rows ** (1 / 3))))
    found = []
    while True:
        for apart in APART:
            points = choose_pivots(base, dim, count, apart)
            near, near_partners = (np.argsort(-(x @ points.T), axis=1, kind="stable") for x in (tried, partners))
            for nearest, shared in (s for s in SCHEMES if s[0] <= count):
                flags, others = np.zeros((trials, count), np.float32), np.zeros((trials, count), np.float32)
                np.put_along_axis(flags, near[:, :nearest], 1, axis=1)
                np.put_along_axis(others, near_partners[:, :nearest], 1, axis=1)
                recall = float(((flags * others).sum(axis=1) >= shared).mean())
                common = np.rint(flags @ flags.T).astype(int)[np.triu_indices(trials, 1)]
                met = sum(comb(o, shared) * n for o, n in enumerate(np.bincount(common))) / len(common)
                cost = met * rows * rows / 2 + ENTRY_COST * comb(nearest, shared) * rows
                found.append((recall < RECALL, cost if recall >= RECALL else -recall, len(found), Index(points, nearest, shared)))
        best = min(found, key=lambda f: f[:3])
        if not best[0] or pivots or count < 8 * max(k for k, _ in SCHEMES):
            return best[3]
        count //= 8  # in few dimensions many points are too fine


def _list_keys(tops: np.ndarray, shared: int) -> np.ndarray:
    """A key for each combination of ``shared`` pivots of a row: rows with so many pivots in common share a key."""
    columns = list(combinations(range(tops.shape[1]), shared))
    keys = np.zeros((len(tops), len(columns)), np.int64)
    for j, picked in enumerate(columns):
        for c in picked:
            keys[:, j] = (keys[:, j] << (62 // shared)) | tops[:, c]
    return keys


def _compare(x: np.ndarray, block: np.ndarray, tops: np.ndarray, weight: np.ndarray, key: int, at: int, shared: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within one list, or between two blocks of it: the weight of each row's links, and the row that stands for its group.

    A pair that shares several lists counts in one of them: where the list's pivots are the first that the
    two share.
    """
    links, group, hits = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros((len(x), len(x)), bool)
    last = key & ((1 << (62 // shared)) - 1)
    # shared pivots up to the list's last one; the list's own are among them
    upto = np.zeros((len(x), last + 1), np.float32)
    r, c = np.nonzero(tops <= last)
    upto[r, tops[r, c]] = 1
    for i in range(0, len(x), STRIP):
        some = x[i : i + STRIP] @ x.T >= least
        some[np.arange(len(some)), np.arange(i, i + len(some))] = False
        if at // 100000 != at % 100000:  # two blocks; pairs within one are met elsewhere
            some &= block[i : i + STRIP, None] != block[None, :]
        if some.any():
            first = some & (np.rint(upto[i : i + STRIP] @ upto.T) == shared)
            links[i : i + STRIP] = first @ weight
            hits[i : i + STRIP] = some
    while True:
        near = [np.where(hits[i : i + STRIP], group[None, :], len(x)).min(axis=1) for i in range(0, len(x), STRIP)]
        new = np.minimum(group, np.concatenate(near))
        new = new[new]
        if (new == group).all():
            return links, group
        group = new


def _walk(shared: Mapping[int, int], least: float):
    """Compare the lists of a partition, which come sorted; a list may run over several batches."""
    columns = ["label", "dim", "key", "at"]

    def lists(parts):
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            new = (part[columns] != part[columns].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            rest = part.iloc[starts[-1] :]
            yield part.iloc[: starts[-1]], starts
        if rest is not None:
            yield rest, np.array([0, len(rest)])

    def walk(parts):
        for rows, starts in lists(parts):
            if not len(rows):
                continue
            ids, weight, block = rows["id"].to_numpy(), rows["size"].to_numpy(), rows["own"].to_numpy()
            keys, ats, dims = rows["key"].to_numpy(), rows["at"].to_numpy(), rows["dim"].to_numpy()
            out = []
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i > 1:
                    x = unit(np.stack(rows["vec"].iloc[i:j].to_numpy()))
                    tops = np.stack(rows["tops"].iloc[i:j].to_numpy())
                    links, group = _compare(x, block[i:j], tops, weight[i:j], int(keys[i]), int(ats[i]), shared.get(int(dims[i]), SHARED), least)
                    some = (links > 0) | (group != np.arange(j - i))
                    out.append((ids[i:j][some], links[some], ids[i:j][group[some]]))
            if out:
                yield pd.DataFrame(dict(zip(("id", "links", "low"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return walk


def _pairs_of(list_size: Column, block: Column) -> Column:
    """The block pairs that a member of a long list takes part in, as one number each."""
    blocks = F.ceil(list_size / BLOCK).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    return F.transform(others, lambda j: F.least(block, j) * 100000 + F.greatest(block, j))


def similar_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST,
    pivots: int | None = None,
) -> DataFrame:
    """One row per row of ``rows``: key, n_links, component_id (long) and kept (boolean).

    Two vectors are linked if their labels are equal and not null and their cosine is at least ``least``. Equal
    vectors of a label are one class from the start. Each class is described by its nearest reference points;
    inverted lists hold, for each combination of so many points, the classes that have them all, so classes meet when
    they share that many. Points and numbers come from ``fit_index`` for each length of vectors; ``pivots`` fixes the number of points. Every list is compared in full, long ones in blocks of BLOCK rows spread over tasks: a list of n rows is
    shuffled ceil(n / BLOCK) times. Links are found with a high but not full recall (see the tests); none is wrong.

    Null or zero vectors, and ones with null, NaN or infinite components, link with nothing; so do vectors without a
    label, and vectors of different lengths with each other. Rows without a key are alone: component null, kept true. Repeated rows are
    vectors of their own, linked with each other; other columns are left out; an empty table gives an empty one.
    """
    if pivots and pivots > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    key, vector, label = quoted(key), quoted(vector), quoted(label)
    space = Workspace(rows.sparkSession, "vectors")
    value = F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0))
    good = F.expr("size(vec) > 0 and forall(vec, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vec, v -> v <> 0)")
    table = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), value.alias("vec"))
    table = table.withColumn("good", F.coalesce(good & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    table = table.withColumn("h1", F.xxhash64(F.lit(1), "label", "vec")).withColumn("h2", F.xxhash64(F.lit(2), "label", "vec"))
    table = space.write(table, "vectors")
    classes = table.where("good").groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.count("*").alias("size"), F.min_by("label", "id").alias("label"), F.min_by("vec", "id").alias("vec")
    )
    classes = space.write(classes, "classes")
    some = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
    by_dim: dict[int, list] = {}
    for v in some:
        by_dim.setdefault(len(v), []).append(v)
    total = classes.count()
    indexes = {d: fit_index(np.array(vs, np.float64), d, total, least, pivots) for d, vs in by_dim.items()}

    def describe(parts):
        for part in parts:
            for d, of_dim in part.groupby(part["vec"].map(len)):
                index = indexes.get(d) or Index(choose_pivots(np.empty((0, d)), d), NEAREST, SHARED)
                tops = permutation_prefix(np.stack(of_dim["vec"].to_numpy()), index.pivots, index.nearest)
                out = of_dim[["id", "size", "label", "vec"]].copy()
                out["dim"], out["tops"], out["keys"] = d, list(tops), list(_list_keys(tops, index.shared))
                yield out

    kind = table.schema["label"].dataType.simpleString()
    described = classes.mapInPandas(describe, f"id long, size long, label {kind}, vec array<double>, dim int, tops array<int>, keys array<long>")
    described = space.write(described, "permutations")
    posts = described.select("label", "dim", "id", F.explode("keys").alias("key"))
    lists = posts.groupBy("label", "dim", "key").agg(F.count("*").alias("length")).where("length > 1")
    posts = looked_up(posts, lists, ["label", "dim", "key"], "id", "inner")
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    posts = posts.withColumn("own", F.when(blocks > 1, F.pmod(F.hash("id"), blocks)).otherwise(0)).withColumn("at", F.explode(_pairs_of(F.col("length"), F.col("own"))))
    members = posts.select("label", "dim", "key", "own", "at", "id").join(described.select("id", "size", "vec", "tops"), "id")

    by_list = ["label", "dim", "key", "at"]
    together = members.repartition(*by_list).sortWithinPartitions(*by_list)
    met = space.write(together.mapInPandas(_walk({d: index.shared for d, index in indexes.items()}, least), "id long, links long, low long"), "links")
    links = met.groupBy("id").agg(F.sum("links").alias("_links"))
    found = connected_components(met.select(F.col("id").alias("a"), F.col("low").alias("b")))
    of_class = (
        classes.select("id", "size", "h1", "h2").join(links, "id", "left").join(found, F.col("id") == F.col("node"), "left")
        .select("h1", "h2", (F.col("size") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    of_class = space.write(of_class, "found")
    space.drop("classes", "permutations", "links")
    narrow = table.select("id", "good", "h1", "h2")
    some = looked_up(narrow.where("good"), of_class, ["h1", "h2"], "id").select("id", "n_links", "component_id")
    result = some.unionByName(narrow.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return result.select(F.col("id").alias(key.strip("`")), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
