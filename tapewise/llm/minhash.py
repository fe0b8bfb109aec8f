"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, connected_components, copied, dealt, looked_up, quoted, with_totals

#: Words in a shingle; bands and rows of a band. At a similarity of 0.8 a pair escapes all bands with a
#: probability of (1 - 0.8**5)**32, about 3 in a million.
WORDS, BANDS, ROWS = 4, 32, 5
#: Least similarity in hundredths.
LEAST = 80
#: Rows of a shingle's list that meet in one task.
LIST_ROWS = 2000
#: Each bucket compares its members with up to four of them: the smallest id under each of these masks.
_MASKS = (0, 0x7FFFFFFFFFFFFFFF, 0x5555555555555555, 0x2AAAAAAAAAAAAAAA)

_U = np.uint64
_GOLDEN, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; A-Z count as a-z, white space is ASCII's."""
    hashed = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    if not hashed:
        return np.empty(0, np.uint64)
    h = np.array(hashed, np.uint64)
    n = len(h) - words + 1
    if n < 1:
        n, words = 1, len(h)
    x = np.full(n, words, np.uint64)
    for k in range(words):
        x = _mix(x * _GOLDEN + h[k : k + n])
    return np.unique(x)


def signature(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: each element walks its own random permutation of the m registers.

    Step j writes j + r to the element's j-th register, so ranks within an element are all different, which
    lowers the variance below that of independent minima. All elements take a step together; once every register
    holds a value below j + 1 later steps can't change any, and the walk stops.
    """
    low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n, row, order = len(elements), np.arange(len(elements)), None
    for j in range(m):
        x = _mix(elements + _U((j + 1) * int(_GOLDEN) % 2**64))
        k = j + ((x & _U(0xFFFFFF)) * _U(m - j) >> _U(24)).astype(np.int64)
        if order is None:
            at = k
        else:
            at = order[row, k].copy()
            order[row, k] = order[row, j]
        np.minimum.at(low, at, (_U(j) << _U(40)) | (x >> _U(24)))
        if int(low.max()) >> 40 <= j:
            break
        if order is None:  # the first step is enough for most texts
            order = np.tile(np.arange(m, dtype=np.uint16), (n, 1))
            order[row, k] = 0
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a signature; the same values in another band give another key."""
    x = np.arange(bands, dtype=np.uint64)
    parts = sig[: bands * rows].reshape(bands, rows)
    for k in range(rows):
        x = _mix(x * _GOLDEN + parts[:, k])
    return x.view(np.int64)


def _describe(words: int, bands: int, rows: int):
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingles(t, words)
            data = s.tobytes()
            one = xxhash.xxh3_128_intdigest(data)
            keys = band_keys(signature(s, bands * rows), bands, rows) if len(s) else None
            out.append((len(s), (one >> 64) - 2**63, (one & (2**64 - 1)) - 2**63, keys))
        return pd.DataFrame(out, columns=["n", "h1", "h2", "keys"])

    return F.pandas_udf(describe, "n long, h1 long, h2 long, keys array<long>")


def _sets(words: int):
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts])

    return F.pandas_udf(sets, "array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A set that very many pairs name is copied to several tasks."""
    left = copied(sets.select(F.col("node").alias("a"), F.col("items").alias("_a")), pairs, ["a"], "_at")
    right = copied(sets.select(F.col("node").alias("b"), F.col("items").alias("_b")), pairs, ["b"], "_to")
    both = dealt(dealt(pairs, ["a"], "b", "_at"), ["b"], "a", "_to").join(left, ["a", "_at"]).join(right, ["b", "_to"])
    close = f"100 * least(size(_a), size(_b)) >= {least} * greatest(size(_a), size(_b))"
    shared = "size(array_intersect(_a, _b))"
    return both.where(f"CASE WHEN {close} THEN 100 * {shared} >= {least} * (size(_a) + size(_b) - {shared}) ELSE false END").select("a", "b")


def _rest(posts: DataFrame, sets: DataFrame, least: int, space: Workspace) -> DataFrame:
    """Pairs of different components left to compare: those that share a shingle of their prefixes.

    Rare shingles come first. Of n shingles in this order, a set must share one of the first
    n - ceil(least * n / 100) + 1 with any similar set, and one of the first n - ceil(2 * least * n / (100 + least)) + 1
    with one that is not smaller. The first shingle that two sets share also leaves enough of both behind
    it: their overlap is 1 + min(n - i, m - j) at most. In each shingle's list only members outside its largest
    component are paired; a long list is dealt over tasks, and those members go to each of them.
    """
    items = posts.select("node", "label").distinct().join(sets, "node").select("node", "label", F.size("items").alias("n"), F.explode("items").alias("item"))
    counted = with_totals(items, ["item"], "node", {"_often": (F.count("*"), F.sum)})
    in_order = Window.partitionBy("node").orderBy("_often", "item")
    prefix = counted.withColumn("at", F.row_number().over(in_order))
    prefix = prefix.where(f"_often > 1 and at <= n - (({least} * n + 99) div 100) + 1").select("item", "node", "label", "n", "at")
    prefix = space.write(prefix, "prefixes")
    by_label = prefix.groupBy("item", "label").agg(F.count("*").alias("_n"))
    largest = by_label.groupBy("item").agg(F.max_by("label", F.struct("_n", "label")).alias("_top"), F.count("*").alias("_labels"), F.ceil(F.sum("_n") / LIST_ROWS).alias("_fan"))
    mixed = looked_up(prefix, largest.where("_labels > 1").drop("_labels"), ["item"], "node", "inner")
    mixed = space.write(mixed.withColumn("_deal", F.pmod(F.xxhash64("node"), F.col("_fan"))), "mixed")
    odd = mixed.where("label <> _top").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)))
    odd = odd.select("item", "_deal", *[F.col(c).alias(f"_{c}") for c in ("node", "label", "n", "at")])
    total = 100 + least
    short = f"at <= n - ((2 * {least} * n + {total - 1}) div {total}) + 1"
    _short = f"_at <= _n - ((2 * {least} * _n + {total - 1}) div {total}) + 1"
    pairs = odd.join(mixed, ["item", "_deal"]).where(f"""
        label <> _label and 100 * least(n, _n) >= {least} * greatest(n, _n)
        and CASE WHEN n < _n OR (n = _n AND node < _node) THEN {short} ELSE {_short} END
        and 1 + least(n - at, _n - _at) >= ({least} * (n + _n) + {total - 1}) div {total}""")
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (long) and kept (boolean).

    Documents are linked when 100 * |shared| >= least * |union| on their sets of distinct shingles; component_id is
    the smallest key reachable, kept marks it. Equal sets are one class from the start, represented by its smallest key; every class
    posts its band keys, and

    * each bucket compares its members with up to four of them, chosen by masks on the id;
    * components of these links are found, and buckets that still hold several are settled exactly through
      prefixes of their sets.

    All pairs that share a bucket are thus linked, known to be connected or ruled out. The rows of a bucket, of a class and of a set in many
    pairs are spread over tasks. Texts without words (and null texts)
    have no set and stay alone. Rows without a key are alone too: component null, kept true. Rows with the same
    key count as one document; if their texts differ, each belongs to the class of its own text, and the smallest text stands for the
    document when it is compared. Whole texts are read, however long. Other columns are left out; an empty table gives an empty one.
    """
    space = Workspace(docs.sparkSession, "near-duplicates")
    spark_key = F.col(quoted(key)).cast("long").alias("node")
    table = docs.select(spark_key, _describe(words, bands, rows)(F.col(quoted(text))).alias("d")).select("node", "d.*")
    table = space.write(table, "signatures")
    filled = "n > 0 and node is not null"
    classes = table.where(filled).groupBy("h1", "h2").agg(F.min("node").alias("rep"), F.min_by("keys", "node").alias("keys"))
    classes = space.write(classes, "classes")
    posts = classes.select(F.col("rep").alias("node"), F.explode("keys").alias("slot"))
    leaders = [F.min(F.col("node").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"_{i}") for i, m in enumerate(_MASKS)]
    slots = posts.groupBy("slot").agg(F.count("*").alias("_size"), *leaders).where("_size > 1")
    shared = looked_up(posts, slots, ["slot"], "node", "inner")
    shared = space.write(shared.select("slot", "_size", "node", F.array_distinct(F.array(*[f"_{i}" for i in range(len(_MASKS))])).alias("_leaders")), "buckets")
    pairs = shared.select("node", F.explode("_leaders").alias("_l")).where("node <> _l")
    pairs = space.write(pairs.select(F.least("node", "_l").alias("a"), F.greatest("node", "_l").alias("b")).distinct(), "pairs")
    named = shared.select("node").distinct()
    sets = docs.select(spark_key, F.col(quoted(text)).alias("_text")).join(named, "node", "left_semi").groupBy("node").agg(F.min("_text").alias("_text"))
    sets = space.write(sets.select("node", _sets(words)(F.col("_text")).alias("items")), "sets")
    links = space.write(_verified(pairs, sets, least), "links")
    found = space.write(connected_components(links), "components")

    # Buckets of more than three members that hold several components still have pairs that no leader covers.
    labels = shared.where("_size > 3").select("slot", "node").join(found, "node", "left").select("slot", "node", F.coalesce("component", "node").alias("label"))
    labels = space.write(labels, "labels")
    mixed = labels.groupBy("slot").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("slot")
    open_pairs = _rest(looked_up(labels, mixed, ["slot"], "node", "inner"), sets, least, space).join(pairs, ["a", "b"], "left_anti")
    more = space.write(_verified(space.write(open_pairs, "open"), sets, least), "more")
    if not more.isEmpty():
        found = space.write(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "settled")
    space.drop("buckets", "pairs", "sets", "links", "labels", "prefixes", "mixed", "open", "more")
    of_class = classes.select("h1", "h2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("_component"))
    some = looked_up(table.where(filled).drop("keys"), of_class, ["h1", "h2"], "node").select("node", "n", "_component")
    result = some.unionByName(table.where(f"not ({filled})").select("node", "n", F.col("node").alias("_component")))
    result = result.select(F.col("node").alias(key), F.col("n").alias("n_shingles"), F.col("_component").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(quoted(key)) == F.col("component_id"), F.lit(True)))


def brute_force(texts: dict[int, str | None], words: int = WORDS, least: int = LEAST) -> dict[int, int]:
    """component_id of each document by comparing all pairs; for tests on small inputs."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}
