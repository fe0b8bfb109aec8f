"""Periodic runs of words in a text, found by catching squares over dyadic blocks.

A square of period p with 2B <= p < 4B (B a power of two) has a completed block of B words in its first half and a copy of it p words later.
So at every level B a catcher stands on each completed block; each appended word completes a suffix of B words, which is compared with the
two blocks that began 2B..4B words before it. A hit is widened to both sides by comparing words, and the squares of one stretch are one run.
Comparisons of all appended words are one vector operation; periods up to SHORT need no blocks, their words are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest run in words, and the periods below the first level's.
LEAST, SHORT, FIRST_LEVEL = 12, 7, 2
#: Words that are handled together; a longer text is handled alone, with 8 bytes per word and level.
TOGETHER = 400_000

_SCHEMA = "starts array<bigint>, periods array<bigint>, lengths array<bigint>, collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: what stands between spaces and the control characters 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two neighbouring blocks."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and next-to-last positions of the stretches of true values."""
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    if len(equal) and equal[0]:
        edges = np.concatenate(([0], edges))
    if len(equal) and equal[-1]:
        edges = np.concatenate((edges, [len(equal)]))
    return edges[::2], edges[1::2]


def _caught(hashes: list[np.ndarray], level: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, period): words first..end-1 equal those ``period`` later, for all stretches that contain a block of this level."""
    size, now = 1 << level, hashes[level]
    block = np.repeat(now[::size], size)[: len(now)]  # of each word, the block in which it lies
    hits = [(np.flatnonzero(now[back * size :] == block[: max(len(now) - back * size, 0)]), back * size) for back in (2, 3)]
    caught = np.concatenate([at >> level << level for at, _ in hits])
    suffix = np.concatenate([at + back for at, back in hits])
    same = doc[caught] == doc[suffix]
    caught, period = caught[same], (suffix - caught)[same]
    order = np.lexsort((caught, period))
    caught, period = caught[order], period[order]
    follows = (np.diff(caught, prepend=-1) == size) & (np.diff(period, prepend=-1) == 0)  # the same stretch, a block further on
    first = caught[~follows]
    ends_here = np.append(~follows[1:], True) if len(follows) else follows
    end, period = caught[ends_here] + size, period[~follows]
    for low in range(level - 1, -1, -1):  # less than a block is left on either side
        step, h = 1 << low, hashes[low]
        left = np.maximum(first - step, 0)
        first = np.where((first >= step) & (h[left] == h[left + period]), left, first)
        right = end + period
        inside = right < len(h)
        end = np.where(inside & (h[end] == h[np.where(inside, right, 0)]), end + step, end)
    return first, end, period


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, period, length) of every run of each text, given as arrays of word numbers that are the same for equal words of a text.

    A run is a longest stretch with smallest period q of at least max(LEAST, 2 q) words. Sorted by start, then period.
    """
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))  # higher levels concern a prefix only
    sizes = np.array([len(texts[k]) for k in order], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.empty(offsets[-1], dtype=np.int64)
    doc = np.repeat(np.arange(len(order)), sizes + 1)
    for place, k in enumerate(order):
        ids[offsets[place] : offsets[place + 1] - 1] = texts[k]
    ids[offsets[1:] - 1] = -1 - np.arange(len(order))  # between two texts stands a word that occurs nowhere else
    found: list[np.ndarray] = []
    for q in range(1, SHORT + 1):
        s, e = _stretches(ids[q:] == ids[:-q]) if len(ids) > q else (ids[:0], ids[:0])
        long = e - s >= max(LEAST - q, q)
        found.append(np.stack([s[long], e[long] + q, np.full(np.count_nonzero(long), q)]))
    hashes, level = [_mixed(ids.astype(np.uint64), ids.astype(np.uint64))], 0
    while True:
        level += 1
        part = offsets[np.searchsorted(-sizes, -(4 << max(level, FIRST_LEVEL)), side="right")]  # texts with room for a square of this level
        if not part:
            break
        low, half = hashes[-1][:part], 1 << (level - 1)
        hashes.append(_mixed(low[: part - 2 * half + 1], low[half : part - half + 1]))
        if level >= FIRST_LEVEL:
            first, end, period = _caught(hashes, level, doc)
            square = end - first >= period
            found.append(np.stack([first[square], end[square] + period[square], period[square]]))
    runs = np.concatenate(found, axis=1)
    known: dict[tuple[int, int], int] = {}
    for s, e, p in runs[:, np.lexsort(runs[::-1])].T.tolist():
        if known.get((s, e), p + 1) <= p:  # multiples of the period tell of the same stretch
            continue
        for stretch in [(s, e)] if _holds(ids, s, e, p) else _scan(ids, offsets, doc, s, p):
            known[stretch] = min(known.get(stretch, p), p)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (s, e), p in known.items():
        place = int(doc[s])
        out[order[place]].append((s - int(offsets[place]), p, e - s))
    for runs_of_text in out:
        runs_of_text.sort()
    return out


def _holds(ids: np.ndarray, first: int, end: int, period: int) -> bool:
    """Whether the words really repeat: blocks were compared by hashes, and a false hit would show here."""
    return bool(np.array_equal(ids[first : end - period], ids[first + period : end]))


def _scan(ids: np.ndarray, offsets: np.ndarray, doc: np.ndarray, first: int, period: int) -> list[tuple[int, int]]:
    """All stretches of a period in the text of a false hit, word by word."""
    lo, hi = offsets[doc[first]], offsets[doc[first] + 1]
    s, e = _stretches(ids[lo + period : hi] == ids[lo : hi - period])
    long = e - s >= max(LEAST - period, period)
    return list(zip((s[long] + lo).tolist(), (e[long] + lo + period).tolist()))


def _together(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for text in texts:
        part.append(words_of(text))
        size += len(part[-1])
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, period, length in runs:
        kept[start + period : start + length] = False
    return b" ".join(compress(words, kept.tolist()))


def _runs(text: pd.Series) -> pd.DataFrame:
    rows = []
    for part in _together(text):
        known: dict[bytes, int] = {}
        numbers = count()
        coded = [np.fromiter(map(known.setdefault, words, numbers), np.int64, len(words)) for words in part]
        for words, runs in zip(part, find_runs(coded)):
            rows.append(([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], collapsed(words, runs).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(rows, columns=["starts", "periods", "lengths", "collapsed"])


def periodic_runs(text: Column) -> Column:
    """struct<starts, periods, lengths (arrays in order of start, then period), collapsed>: the runs of whole texts, however long.

    ``collapsed`` is the text's words joined by one space, without those that only repeat a run's first period. Null and empty texts, and texts without
    words, have no runs and collapse to the empty text. Equal texts get equal values; rows are handled on their own, so repeated rows and
    other columns don't matter.
    """
    return F.pandas_udf(_runs, _SCHEMA)(text)
