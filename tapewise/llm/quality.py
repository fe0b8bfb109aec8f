"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that a model is fitted on; they are the ones with the smallest hash.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 80, 4, 64, 0.15, 10, 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_deviation", "longest_word", "distinct_words", "top_word", "distinct_pairs",
    "upper", "digit", "space", "other_ascii", "not_ascii", "exclamation", "symbol", "full_stop", "comma", "short_words", "newline",
    "repeated_lines", "line_length", "entropy", "long_words", "capital_words",
)
_SYMBOLS = np.frombuffer(b"#<>{}[]|\\/@$%^&*_=+~", np.uint8)


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text; a null text counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    by_word = Counter(words)
    lines = data.split(b"\n")
    share = count[count > 0] / n
    upper, digit, space, outside = count[65:91].sum(), count[48:58].sum(), count[[9, 10, 13, 32]].sum(), count[128:].sum()
    ascii_rest = len(data) - upper - digit - space - outside - count[97:123].sum()
    return [
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), lengths.std(), min(lengths.max(), 1000.0), len(by_word) / w,
        max(by_word.values(), default=0) / w, len(set(zip(words, words[1:], strict=False))) / w, upper / n, digit / n, space / n, ascii_rest / n, outside / n,
        count[33] / n, count[_SYMBOLS].sum() / n, count[46] / w, count[44] / w, (lengths <= 2).mean(), count[10] / n,
        1 - len(set(lines)) / len(lines), min(len(data) / len(lines), 1e5), -(share * np.log2(share)).sum(), (lengths > 15).mean(),
        sum(x[:1].isupper() for x in by_word) / w,
    ]


def table_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Complete binary trees in arrays: node i has the children 2i+1 and 2i+2; leaves hold log-odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x; all trees step down together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        out, inner = np.empty(len(x)), self.feature.shape[1]
        tree = np.arange(len(self.feature))
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            node, row = np.zeros((len(part), len(tree)), np.int64), np.arange(len(part))[:, None]
            while node[0, 0] < inner:
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[i : i + 4096] = self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-(self.base + out)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost TREES trees of DEPTH levels on histograms of at most BINS bins a feature, with logistic loss."""
    n, f = x.shape
    none = Trees(0.0, np.empty((0, 0), np.int64), np.empty((0, 0)), np.empty((0, 0)))
    if not n:
        return none
    p = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        none.base = base
        return none
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(f)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(f)], axis=1)
    inner, raw = 2**DEPTH - 1, np.full(n, base)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, 2**DEPTH))
    column = np.arange(f) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            cell = ((node[:, None] * f * BINS) + column + binned).ravel()
            hist = [np.bincount(cell, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS) for v in (grad, hess, np.ones(n))]
            left = [np.cumsum(h, axis=2)[:, :, :-1] for h in hist]
            whole = [h.sum(axis=2)[:, :, None] for h in hist]
            gain = left[0] ** 2 / (left[1] + L2) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + L2) - whole[0] ** 2 / (whole[1] + L2)
            gain[(left[2] < LEAST) | (whole[2] - left[2] < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            k, b = best // (BINS - 1), best % (BINS - 1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for i in np.flatnonzero(split):
                if b[i] < len(edges[k[i]]):
                    feature[t, first + i], threshold[t, first + i] = k[i], edges[k[i]][b[i]]
            go = x[np.arange(n), feature[t, first + node]] > threshold[t, first + node]
            node = 2 * node + go
        g, h = np.bincount(node, grad, 2**DEPTH), np.bincount(node, hess, 2**DEPTH)
        leaf[t] = RATE * g / (h + L2)
        raw += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def held_out(key: Column) -> Column:
    """One row in five, by the CRC-32 of its key as text, is never learnt from; a row without a key neither."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows that are not held out. Without any the model gives 0.5 to every text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    width = len(FEATURES)

    def measured(parts):
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["_label"], "x": list(table_of(part["text"]))})

    rows = texts.mapInPandas(measured, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, width)
    return fit(x, rows["label"].to_numpy(np.float64))


def quality_score(model: Trees, text: Column) -> Column:
    """Score of every whole text, 0 to 1; null and empty texts are scored as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(table_of(texts)))

    return score(text)
