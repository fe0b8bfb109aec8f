"""Draws that depend on nothing but their arguments, so that runs, partitionings and engines agree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: MD5's sines, shifts and first state.
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Draws that numpy makes at once, so that they stay in a core's cache.
_AT_ONCE = 1 << 16
#: A Poisson(1) number is how many of these a draw from 0 to 1 reaches.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def _joined(*parts: Column | str | int) -> Column:
    return F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def drawn(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**32 - 1: the first eight hex digits of the MD5 of the parts, joined by '|'. Strings name columns."""
    return F.conv(F.substring(F.md5(_joined(*parts)), 1, 8), 16, 10).cast("long")


def drawn_odd(*parts: Column | str | int) -> Column:
    """Whether the number that ``drawn`` gives is odd; only its last digit is read."""
    return F.substring(F.md5(_joined(*parts)), 8, 1).isin(*"13579bdf")


def drawn_sql(*parts: str) -> str:
    """The same in DuckDB's SQL, of expressions."""
    return f"('0x' || left(md5(concat_ws('|', {', '.join(parts)})), 8))::BIGINT"


def drawn_poisson(first: Column, times: int, *parts: Column | str | int) -> Column:
    """Poisson(1) numbers of ``times`` draws of the parts and a last one that counts up from ``first``, as array<tinyint>.

    Each is how many of POISSON ``drawn(*parts, number) % 1000000 / 1000000`` reaches; MD5 is computed for many rows at once.
    """

    @F.arrow_udf("array<tinyint>")
    def weigh(texts: pa.Array, firsts: pa.Array) -> pa.Array:
        out = np.empty((len(texts), times), np.int8)
        heads, firsts = texts.cast(pa.binary()).to_pylist(), firsts.to_numpy()
        for start in np.unique(firsts):
            at = np.flatnonzero(firsts == start)
            for rows, numbers, draws in _draws([heads[i] for i in at], [b"%d" % k for k in range(start, start + times)]):
                u = draws % np.uint32(1_000_000) / 1_000_000.0
                weights = np.zeros(u.shape, np.int8)
                for cut in POISSON:
                    weights += u >= cut
                out[np.ix_(at[rows], numbers)] = weights.T
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, times, np.int32), out.ravel())

    return weigh(_joined(*parts, F.lit("")), first)


def _draws(heads: list[bytes], tails: list[bytes]):
    """What ``drawn`` gives for each head with each tail: places of some heads and some tails, and an array of (tails, heads); all pairs in the end."""
    sizes, ends = np.array([len(h) for h in heads]), np.array([len(t) for t in tails])
    for size in np.unique(sizes):
        same, blocks = np.flatnonzero(sizes == size), (size + ends + 72) // 64
        for n in np.unique(blocks):
            numbers = np.flatnonzero(blocks == n)
            step = max(1, _AT_ONCE // len(numbers))
            for k in range(0, len(same), step):
                rows = same[k : k + step]
                yield rows, numbers, _first_words([heads[i] for i in rows], [tails[i] for i in numbers], int(n))


def _first_words(heads: list[bytes], tails: list[bytes], blocks: int) -> np.ndarray:
    """The first four bytes of the MD5 of each head with each tail, as numbers; heads have one length, and all texts fill as many blocks of 64 bytes."""
    size = len(heads[0])
    whole, rest = divmod(size, 4)
    room = 64 * blocks - 4 * whole - 8
    padded = [(bytes(rest) + t + b"\x80").ljust(room, b"\0") + (8 * (size + len(t))).to_bytes(8, "little") for t in tails]
    head = np.frombuffer(b"".join(h + bytes(-size % 4) for h in heads), "<u4").reshape(len(heads), -(-size // 4))
    tail = np.frombuffer(b"".join(padded), "<u4").reshape(len(tails), -1)
    words = [np.ascontiguousarray(head[:, j]) for j in range(whole)] + [t[:1] if (t == t[0]).all() else t[:, None] for t in tail.T]
    if rest:  # one word holds the end of a head and the begin of a tail
        words[whole] = words[whole] + head[:, whole]
    state = [np.full((1, len(heads)), x, np.uint32) for x in _START]
    for block in range(0, len(words), 16):
        state = _mixed(state, words[block : block + 16], len(tails), max(0, min(16, whole - block)))
    return state[0].byteswap()


def _mixed(state: list[np.ndarray], words: list[np.ndarray], tails: int, shared: int) -> list[np.ndarray]:
    """MD5's state after a block of 16 words; its first ``shared`` steps are the same for all tails if the state before is."""
    a, b, c, d = (x.copy() for x in state)
    f = np.empty_like(a)
    for i in range(64):
        if i == shared and len(a) < tails:
            a, b, c, d, f = (np.repeat(x, tails, axis=0) for x in (a, b, c, d, f))
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16] + np.uint32(_SINES[i])
        np.left_shift(a, np.uint32(_SHIFTS[i]), out=f)
        a >>= np.uint32(32 - _SHIFTS[i])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]
