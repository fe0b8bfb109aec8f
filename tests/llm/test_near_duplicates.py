import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tapewise.llm import minhash, vectors

DATA = "/root/testdata/sf0.001"


def group(base, n, most, seed):
    rng = random.Random(seed)
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_components_equal_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(70))
    texts = dict(enumerate(group(base, 80, 8, 1)))
    texts |= {200: None, 201: "", 202: "one two", 203: "ONE  two", 204: "one two three four five", 205: " \t\n", 206: "É a b c d", 207: "é a b c d"}
    texts |= {300 + k: "same words in every copy of this text" for k in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "0 AS n", "1 AS kept")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    want = minhash.brute_force(texts)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[200].n_shingles == 0 and got[202].n_shingles == 1 and got[204].n_shingles == 2 and got[203].component_id == 202


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = minhash.brute_force({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want


def test_keys_that_are_null_or_repeated(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (4, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 4, False), (5, 2, 4, False), (None, 2, None, True), (4, 2, 4, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def one_by_one(elements, m):
    """SuperMinHash as its paper states it, with the same draws."""
    low, most = [2**64 - 1] * m, (1 << 64) - 1
    for e in map(int, elements):
        p = list(range(m))
        for j in range(m):
            x = int(minhash._mix(np.array([(e + (j + 1) * int(minhash._GOLDEN)) & most], np.uint64))[0])
            k = j + (((x & 0xFFFFFF) * (m - j)) >> 24)
            p[j], p[k] = p[k], p[j]
            low[p[j]] = min(low[p[j]], (j << 40) | (x >> 24))
    return low


@pytest.mark.parametrize("n", [1, 3, 40, 500])
def test_signature_equals_the_sequential_one(n):
    elements = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    assert minhash.signature(elements, 24).tolist() == one_by_one(elements, 24)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(x[:200]), np.unique(x[50:250])
        errors.append((minhash.signature(a, 128) == minhash.signature(b, 128)).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def brute(rows, least=0.93):
    links, ok = {i: set() for i, _, _ in rows}, []
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append((i, np.array(v, np.float64), label))
    for i, v, a in ok:
        for j, w, b in ok:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= least:
                links[i].add(j)
    return links


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    close = base[:60] + 0.06 * rng.normal(size=(60, 16))
    rows = [(k, [float(np.float32(x)) for x in v], k % 2) for k, v in enumerate(np.vstack([base, close, close[:20], np.repeat(base[:1], 30, 0)]))]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS n_links")
    got = {r.vec_id: r for r in vectors.similar_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want) and all(got[k].n_links <= len(want[k]) for k in want)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(map(len, want.values()))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 906)) and got[907].component_id == 906


def test_vector_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(6)
    v = rng.normal(size=16) + 0.02 * rng.normal(size=(60, 16))
    rows = [(k, x.tolist(), "a") for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in vectors.similar_vectors(df).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: 59 for k in range(60)} and {r.component_id for r in got.values()} == {0}
    assert vectors.similar_vectors(df.limit(0)).count() == 0


def test_vector_keys_that_are_null_or_repeated(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (0, [1.0, 0.01], 0)]
    got = sorted(map(tuple, vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(1, 2, 0, False), (1, 2, 0, False), (None, 0, None, True), (0, 2, 0, True)], key=str)


def test_recall_next_to_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = vectors.unit(rng.normal(size=(1500, 64)))
    side = vectors.unit(rng.normal(size=base.shape))
    side = vectors.unit(side - (side * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.931, 0.95, (1500, 1))
    rows = [(k, v.tolist(), "a") for k, v in enumerate(np.vstack([base, c * base + np.sqrt(1 - c * c) * side]))]
    got = vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).toPandas().n_links.sum()
    assert 0.92 * 3000 <= got <= 3000


def exact_cosine(a, b):
    """Cosine of two vectors in exact arithmetic, but for the root."""
    a, b = ([Fraction(v) for v in x] for x in (a, b))
    dot, size = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(y * y for y in b)
    square = float(dot * dot / size) if size else 0.0
    return math.sqrt(square) * (1 if dot > 0 else -1)


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(12)
    vs = [[1e-200, 1e-203], [1e-203, 1e-200], [1e200, 2e200], [1e200, 2.1e200], [1e300, 1e-300], [1e300, 1e290], [5e-324, 0.0], [1.7e308, 1.7e308], [-1e-310, -1e-310], [1.0, 1.01], [1e-160, -1e-160]]
    vs += [(v * 10.0 ** int(e)).tolist() for v, e in zip(rng.normal(size=(40, 2)), rng.integers(-200, 200, 40))]
    rows = [(k, v, "a") for k, v in enumerate(vs)]
    got = {r.vec_id: r.n_links for r in vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    want = {i: sum(exact_cosine(a, b) >= 0.93 for j, b in enumerate(vs) if j != i) for i, a in enumerate(vs)}
    assert got[0] == want[0] and got[2] == want[2] > 0 and all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.9 * sum(want.values())


@pytest.mark.parametrize("shape", ["independent", "common mean", "clusters", "unequal axes"])
def test_index_of_skewed_vectors(shape):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(8000, 64))
    x = {"independent": x, "common mean": x + 1.5, "clusters": rng.normal(size=(50, 64))[rng.integers(0, 50, 8000)] + 0.7 * x, "unequal axes": x * np.exp(rng.normal(size=64))}[shape]
    index = vectors.fit_index(x[:4096], 64, 20_000, vectors.LEAST)
    u = vectors.unit(x[4096:])
    side = rng.normal(size=u.shape)
    side = vectors.unit(side - (side * u).sum(1, keepdims=True) * u)
    c = rng.uniform(0.931, 0.95, (len(u), 1))
    tops, partners = (vectors.permutation_prefix(v, index.pivots, index.nearest) for v in (u, c * u + np.sqrt(1 - c * c) * side))
    recall = np.mean([len(np.intersect1d(a, b)) >= index.shared for a, b in zip(tops, partners)])
    keys = vectors._list_keys(tops, index.shared)
    n = np.unique(keys, return_counts=True)[1].astype(float)
    assert recall >= 0.9 and (n * (n - 1)).sum() / len(u) ** 2 < 0.05


def test_recall_of_vectors_with_a_common_mean(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1200, 32)) + 1.0
    u = vectors.unit(x)
    side = rng.normal(size=u.shape)
    side = vectors.unit(side - (side * u).sum(1, keepdims=True) * u)
    both = np.vstack([u, 0.945 * u + np.sqrt(1 - 0.945**2) * side])
    rows = [(k, v.tolist(), "a") for k, v in enumerate(both)]
    got = vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).toPandas().n_links.sum()
    want = int((both @ both.T >= vectors.LEAST).sum()) - len(both)
    assert 0.9 * want <= got <= want + 2


def test_strips_and_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16)).repeat(15, 0) + 0.12 * rng.normal(size=(90, 16))
    df = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(base)], "vec_id long, embedding array<double>, label string")
    one = sorted(map(tuple, vectors.similar_vectors(df).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 11)
    monkeypatch.setattr(vectors, "STRIP", 4)
    assert sorted(map(tuple, vectors.similar_vectors(df).collect())) == one
    with pytest.raises(ValueError):
        vectors.similar_vectors(df, pivots=vectors.MOST_PIVOTS + 1)


def test_long_lists_and_hot_sets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_ROWS", 3)
    monkeypatch.setattr(minhash, "_MASKS", (0,))
    base = " ".join(f"w{i}" for i in range(50))
    texts = dict(enumerate([*group(base, 60, 4, 5), *group(base + " " + base[:60], 40, 9, 7)]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == minhash.brute_force(texts)
