"""Packing token sequences: exact-complement hashing on the histogram of lengths, then best fit."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RANK_BUCKETS, boxed, hash_bucket, quoted, rank_in_groups, seeded_hash, unboxed

CAPACITY, END_ID = 4096, 1
#: Entries in each of a worker's two caches; a full cache is emptied. SHORT: where other steps use the same workers, for which the caches are emptied after each task.
CACHE, SHORT = 600_000, 100_000
#: What the tokenizer's own splitting rule does within a chunk of printable Latin-1 text.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The settings of a tokenizer's file from which that rule follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def splits_as_expected(settings: dict) -> bool:
    """Whether a tokenizer's settings are those of the splitting rule, so that its ids are the joined ids of a text's words."""
    splitter = settings.get("pre_tokenizer") or {}
    return (
        settings.get("normalizer") == _NORMALIZER and settings.get("post_processor") is None and settings.get("truncation") is None
        and splitter.get("type") == "Sequence" and splitter["pretokenizers"][:1] == [_SPLITTER]
        and [x.get("type") for x in splitter["pretokenizers"][1:]] == ["ByteLevel"] and not splitter["pretokenizers"][1].get("add_prefix_space")
        and not splitter["pretokenizers"][1].get("use_regex", True) and all(x["content"].startswith("<|") and " " not in x["content"] for x in settings.get("added_tokens", []))
    )


class Coder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A tokenizer whose file has the expected settings never merges across white space or its own word boundaries, so ids are looked
    up chunk by chunk and word by word, and only new words are tokenized. Other characters than printable Latin-1 go
    to the tokenizer as they are, and so do whole texts if the file has other settings.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.chunks, self.words = Tokenizer.from_file(path), cache, {}, {}
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_as_expected(json.load(f))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.chunks) > self.cache:
            self.chunks = {}
        if len(self.words) > self.cache:
            self.words = {}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.chunks)
        plain, odd = {}, []
        for c in new:
            if _PLAIN.fullmatch(c) and "<|" not in c:
                plain[c] = _WORD.findall(c.lower())
            else:
                odd.append(c)
        self._learn(list({w for words in plain.values() for w in words}.difference(self.words)))
        known = self.words
        for c, words in plain.items():
            self.chunks[c] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        for c, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            self.chunks[c] = np.array(e.ids, "<u4").tobytes()
        found = self.chunks.__getitem__
        return [b"".join(map(found, chunks)) for chunks in split]

    def forget(self) -> None:
        """Empty both caches."""
        self.chunks, self.words = {}, {}

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 64):
            part = words[i : i + 64]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, at = np.array(e.ids, "<u4"), np.array(e.word_ids)
            cuts = np.searchsorted(at, np.arange(len(part) + 1)).tolist()
            data = ids.tobytes()
            if len(at) and at[-1] != len(part) - 1:
                raise ValueError("the tokenizer splits words otherwise than expected")
            for k, w in enumerate(part):
                self.words[w] = data[4 * cuts[k] : 4 * cuts[k + 1]]


_coders: dict[tuple[str, int], Coder] = {}


def coder(path: str, cache: int = CACHE) -> Coder:
    """This process's coder for a tokenizer file and a size of its caches."""
    if (path, cache) not in _coders:
        _coders[path, cache] = Coder(path, cache)
    return _coders[path, cache]


def cut_texts(parts: Iterator[pd.Series], c: Coder, capacity: int, end_id: int, with_ids: bool, forget: bool) -> Iterator[pd.Series]:
    """The texts' pieces, part by part; ``forget`` empties the coder's caches after the last."""
    last = int(end_id).to_bytes(4, "little")
    try:
        for texts in parts:
            out, values = [], [t or "" for t in texts]
            for i in range(0, len(values), 500):
                for data in c.encode(values[i : i + 500]):
                    data += last
                    cuts = [data[k : k + 4 * capacity] for k in range(0, len(data), 4 * capacity)]
                    rows = [{"piece": k, "start": k * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for k, p in enumerate(cuts)]
                    out.append([r | {"ids": p} for r, p in zip(rows, cuts, strict=True)] if with_ids else rows)
            yield pd.Series(out)
    finally:
        if forget:
            c.forget()


def token_pieces(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache: int | None = None) -> Column:
    """Array of a text's pieces: struct of piece (int), start, length, ids_crc32 (long) and, if asked for, ids (binary).

    The ids of the whole text and ``end_id`` are cut every ``capacity`` ids, however long it is; null and empty texts are just
    ``end_id``. Equal texts give equal pieces. Being a column expression, it leaves other columns alone. ``cache`` limits the
    entries of a worker's caches, which are then emptied after each task.
    """
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from cut_texts(parts, coder(path, cache or CACHE), capacity, end_id, with_ids, cache is not None)

    kind = "piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return F.pandas_udf(cut, f"array<struct<{kind.replace(' ', ':').replace(',:', ', ')}>>")(text)


class SumIndex:
    """Which one, two or three of the lengths that are left have a given sum.

    For every sum up to ``capacity`` the index holds one pair and, as a length beside the pair of the rest, one triple: those of which most
    copies were left when they were looked for. Counts only fall, so an entry is looked for again only when its copies are used
    up, and a sum that has none never gets one again.
    """

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n
        self.pairs, self.triples = np.zeros(capacity + 1, np.int64), np.full(capacity + 1, -1)
        for total in range(2, capacity + 1):
            self._find_pair(total)

    def take(self, items: tuple[int, ...], most: int) -> int:
        """Take as many copies of ``items`` as there are, up to ``most``."""
        lengths, times = np.unique(items, return_counts=True)
        k = int(min(most, (self.n[lengths] // times).min()))
        self.n[lengths] -= k * times
        return k

    def _left(self, items: tuple[int, ...]) -> bool:
        return all(self.n[x] >= items.count(x) for x in items)

    def _find_pair(self, total: int) -> None:
        half = total // 2
        low, high = self.n[1 : half + 1], self.n[total - 1 : total - half - 1 : -1]
        both = np.minimum(low, high)
        if 2 * half == total:
            both[-1] = low[-1] // 2
        k = int(both.argmax())
        self.pairs[total] = k + 1 if both[k] else 0

    def pair(self, total: int) -> tuple[int, ...] | None:
        if total < 2 or not self.pairs[total]:
            return None
        found = (total - int(self.pairs[total]), int(self.pairs[total]))
        if not self._left(found):
            self._find_pair(total)
            return self.pair(total)
        return found

    def _find_triple(self, total: int) -> None:
        """The length whose copies and whose pair's are most; pairs that are used up meanwhile are looked for again."""
        third = np.flatnonzero(self.n[1 : total - 1]) + 1
        third = third[self.pairs[total - third] > 0]
        small = self.pairs[total - third]
        left = np.minimum(self.n[third], np.minimum(self.n[small], self.n[total - third - small]))
        for c in third[np.argsort(-left, kind="stable")].tolist():
            rest = self.pair(total - c)
            if rest and self._left((*rest, c)):
                self.triples[total] = c
                return
        self.triples[total] = 0

    def triple(self, total: int) -> tuple[int, ...] | None:
        if total < 3 or self.triples[total] == 0:
            return None
        if self.triples[total] > 0:
            c = int(self.triples[total])
            rest = self.pair(total - c)
            if rest and self._left((*rest, c)):
                return (*rest, c)
        self._find_triple(total)
        c = int(self.triples[total])
        return (*self.pair(total - c), c) if c else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap`` exactly."""
        return (gap,) if self.n[gap] else self.pair(gap) or self.triple(gap)

    def largest(self, gap: int) -> int:
        found = np.flatnonzero(self.n[1 : gap + 1])
        return int(found[-1]) + 1 if len(found) else 0


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> Iterator[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences made so), together all of ``counts``: {length: how many}.

    From the longest length down, whole groups of equal sequences are filled: by a combination of one, two or
    three lengths that fits exactly as long as there is one, else by the longest length that fits. Each
    split of a group uses up a length, so there are at most twice as many lines as lengths, however many
    pieces there are.
    """
    stock = SumIndex(counts, capacity)
    for length in range(capacity, 0, -1):
        while left := int(stock.n[length]):
            times = min(capacity // length, left)
            many = stock.take((length,) * times, left // times)
            groups = [((length,) * times, capacity - times * length, many)]
            while groups:
                items, gap, many = groups.pop()
                fill = stock.complement(gap) if gap else None
                if gap and not fill and (x := stock.largest(gap)):
                    fill = (x,)
                if not fill:
                    yield items, many
                    continue
                k = stock.take(fill, many)
                if k < many:
                    groups.append((items, gap, many - k))
                groups.append((items + fill, gap - sum(fill), k))


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY, seed: int = 5) -> DataFrame:
    """Put every row of ``pieces`` into a sequence of at most ``capacity``: adds ``sequence_id`` and ``offset`` (long).

    Lengths must lie in 1..capacity. Only the histogram of lengths (at most ``capacity`` rows) comes to the
    driver; rows find their place by their rank within their length, in a shuffled order of ``keys``.
    Offsets are gapless from 0 in each sequence. ``pieces`` is read twice, so it should be a table. The plan that is sent to all tasks has
    at most twice as many lines as there are lengths, whatever the number of rows. Null keys and repeated rows are fine (equal rows
    take places of their length in any order), an empty table gives an empty one. Columns named like the two results are
    replaced, other columns may have any names.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(quoted(length)).count().collect()}
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for items, many in plan(counts, capacity):
        offset = 0
        for x in items:
            rows.append((x, used[x], used[x] + many, sequence, offset))
            used[x] += many
            offset += x
        sequence += many
    table = pd.DataFrame(np.array(rows, np.int64).reshape(-1, 5), columns=["_length", "from", "to", "sequence", "offset"])
    # a length's places in order of their ranks, so that a row's is found by bisection
    places = [(int(x), [tuple(map(int, r)) for r in of[["from", "to", "sequence", "offset"]].sort_values("from").to_numpy()]) for x, of in table.groupby("_length")]
    places = spark.createDataFrame(places, "_length long, places array<struct<from: long, to: long, sequence: long, offset: long>>")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*[F.col(quoted(c)) for c in names])
    hashed = pieces.select(
        boxed(pieces).alias("_row"), F.col(quoted(length)).cast("long").alias("_length"), seeded_hash(seed, *map(quoted, keys)).alias("_hash"), F.struct(*[F.col(quoted(k)) for k in keys]).alias("_keys")
    )
    ranked = rank_in_groups(hashed, ["_length"], hash_bucket("_hash"), [F.col("_hash"), F.col("_keys")], "_rank", "_n")
    bisect = """
        aggregate(sequence(1, length(bin(size(places)))), struct(0 AS lo, size(places) AS hi), (s, k) ->
            IF(s.hi - s.lo <= 1, s, IF(places[(s.lo + s.hi) div 2].from <= _rank, struct(int((s.lo + s.hi) div 2) AS lo, s.hi AS hi), struct(s.lo AS lo, int((s.lo + s.hi) div 2) AS hi))),
            s -> places[s.lo])
    """
    placed = ranked.join(F.broadcast(places), "_length").withColumn("_place", F.expr(bisect))
    return placed.select(*unboxed("_row", names), (F.col("_place.sequence") + F.col("_rank") - F.col("_place.from")).alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_in_order(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """As ``pack``, with sequences that follow the rows' order: by ``order``, two columns, (file, row number within it).

    The sequences of a line of the plan are spread evenly over time, each line from a start of its own; a length's rows take its places in their order. So row
    number r of n stands near r / n of all sequences, and with rows in mixture order every stretch of sequences holds the mixture. ``pieces`` is read
    several times, so it should be a table; rows of one file and number are one document's, in any order.
    """
    spark, (file, row) = pieces.sparkSession, order
    counts = {r[0]: r[1] for r in pieces.groupBy(quoted(length)).count().collect()}
    lines = [(k, many, list(map(int, items))) for k, (items, many) in enumerate(plan(counts, capacity))]
    lines = spark.createDataFrame(lines, "_line long, _many long, _items array<long>").repartition("_line")
    early = lambda c: F.least(F.floor(F.col(c) * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1))
    made = lines.select("_line", "_items", F.explode(F.expr("transform(sequence(0L, _many - 1), k -> (k + (_line * 0.6180339887498949D) % 1) / _many)")).alias("_time"))
    made = rank_in_groups(made, [], early("_time"), [F.col("_time"), F.col("_line")], "sequence_id", "_n")
    places = made.select("_time", "sequence_id", F.explode(F.expr("transform(_items, (x, i) -> struct(x AS length, aggregate(slice(_items, 1, i), 0L, (a, b) -> a + b) AS offset))")).alias("p"))
    places = places.select("_time", "sequence_id", "p.offset", F.col("p.length").alias("_length"))
    places = rank_in_groups(places, ["_length"], early("_time"), [F.col("sequence_id"), F.col("offset")], "_rank", "_n").select("_length", "_rank", "sequence_id", "offset")
    names = [c for c in pieces.columns if c not in (file, row, "sequence_id", "offset")]
    files = pieces.groupBy(F.col(file).alias("_file")).agg((F.max(row) + 1).alias("_rows"))
    files = files.select("_file", (F.sum("_rows").over(Window.orderBy("_file")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))  # one row for each file
    rows = pieces.select(boxed(pieces.select(*[F.col(quoted(c)) for c in names])).alias("_row"), F.col(quoted(length)).cast("long").alias("_length"), F.col(file).alias("_file"), F.col(row).alias("_at_row"))
    rows = rows.join(F.broadcast(files), "_file").withColumn("_at_all", F.col("_before") + F.col("_at_row")).withColumn("_time", F.col("_at_all") / F.col("_all"))
    ranked = rank_in_groups(rows.select("_row", "_length", "_at_all", "_time"), ["_length"], early("_time"), [F.col("_at_all"), F.col("_row")], "_rank", "_n")
    return ranked.join(places, ["_length", "_rank"]).select(*unboxed("_row", names), "sequence_id", "offset")
