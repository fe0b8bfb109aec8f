import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.llm import personal, squares, variants
from tapewise.llm.queries import op11_dyadic_runs, op12_spelling_variants, op13_personal_anchors

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [
    (1, ""), (2, None), (3, " \t\n"), (4, "a " * 40), (5, "x y z " * 8 + "x y"), (None, "b " * 15), (7, "é é é " * 9), (8, "one two three"), (4, "a " * 40),
    (9, "p q r s t u v w " * 3 + "p"), (10, "w " * 11), (11, ("a b " * 7 + "c ") * 5),
]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, q, size in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, q, size in runs), default=None)
    size, s, q = (-best[0], best[1], best[2]) if best else (None, None, None)
    lines = "".join(f"{s},{size},{q}\n" for s, q, size in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), s, size, q, best and 1000 * size // q, sha(lines), sha(kept))


def texts(tmp_path, spark, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("level_hash", ["given", "poor"])
def test_runs_equal_brute_force(level_hash, monkeypatch):
    if level_hash == "poor":  # blocks that differ often look alike: words decide
        given = squares._mixed
        monkeypatch.setattr(squares, "_mixed", lambda a, b: given(a, b) & np.uint64(7))
    draw = random.Random(level_hash)
    for _ in range(60):
        docs = []
        for _ in range(draw.randint(1, 6)):
            n, k = draw.choice([0, 1, 11, 12, 30, 80, 200]), draw.choice([1, 2, 3, 50])
            words = [draw.randrange(k) for _ in range(n)]
            if n > 20 and draw.random() < 0.6:
                a = draw.randrange(n)
                p = 1 + (n - a) // draw.randint(2, 9)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(np.array(words, dtype=np.int64))
        assert squares.find_runs(docs) == [brute_runs(list(d)) for d in docs]


def test_long_texts_of_few_words():
    assert squares.find_runs([np.zeros(300_000, dtype=np.int64)]) == [[(0, 1, 300_000)]]
    words = np.array(([0] * 100 + [1]) * 200)
    assert squares.find_runs([words])[0][:2] == [(0, 1, 100), (0, 101, 20_200)]


def test_runs_query(spark, tmp_path):
    planted = [k for k in range(1000, 1400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [*ODD, *((k, " ".join(f"w{i * 7 % 41}" for i in range(60))) for k in planted), (planted[0], ""), (planted[1], "a"), (planted[2], None)]
    got = op11_dyadic_runs(spark, texts(tmp_path, spark, rows))
    assert rows_of(got) == sorted((brute_row(*r) for r in rows), key=repr)


def test_runs_query_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 8000]
    got = {r[0]: tuple(r) for r in op11_dyadic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert all(got[k] == brute_row(k, t) for k, t in rows) and any(got[k][1] for k, _ in rows)


def test_empty_tables(spark, tmp_path):
    folder = texts(tmp_path, spark, [])
    assert [q(spark, folder).count() for q in (op11_dyadic_runs, op12_spelling_variants, op13_personal_anchors)] == [0, 0, 0]


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(out, key=repr)


def brute_counts(rows):
    counts = Counter()
    lower = str.maketrans(variants.UPPER, variants.LOWER)
    for doc_id, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            i = h % len(w)
            counts[w if h % 97 else w[:i] + w[i + 1 :]] += 1
    return counts


@pytest.mark.parametrize("limit", [160, 3])
def test_variants_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(variants, "LIST", limit)  # with short lists all are split to single places
    draw = random.Random(limit)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(5, 8))): draw.randint(3, 60) for _ in range(500)}
    counts |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "ÿÿÿÿÿ": 3, "×÷×÷×": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants.spelling_variants(words)) == brute_variants(counts)


def test_variants_query(spark, tmp_path):
    draw = random.Random(5)
    rows = [(k, " ".join(draw.choice(["Straße", "strasse", "straße,", "colour", "color", "COLOR", "colr", "Ärger", "ärger", "abcde", "abcdé"]) for _ in range(40))) for k in range(400)]
    rows += [(1, None), (None, "colour " * 5), (2, ""), (3, "colourz3colourz " * 4), (3, "colourz3colourz " * 4), (4, "x" * 20_000)]
    got = op12_spelling_variants(spark, texts(tmp_path, spark, rows))
    assert rows_of(got) == brute_variants(brute_counts(rows)) and got.count() > 10


def test_variants_query_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    counts = brute_counts(rows)
    got = {r.word: r for r in op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()}
    known = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert {w: r.n for w, r in got.items()} == known
    for w in sorted(known)[::23]:
        near = [v for v in known if abs(len(v) - len(w)) < 2 and is_near(w, v)]
        best = min(near, key=lambda v: (-known[v], v), default=None)
        assert (got[w].n_near, got[w].form) == (len(near), best if best and known[best] >= 2 * known[w] else None)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_base_spans_equal_patterns():
    draw = random.Random(3)
    pieces = [
        "@", "a", "b.c", ".", "..", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+1", " (", "555", ") ", "-", " ", "é", "😀", "x@y.z", "%",
        "_", "0", "00", "4465758382889437", "tel:+4930123456", "http://u:p@h.com", "\n", "٣", "１",
    ]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        assert [tuple(s) for s in personal.find_personal(text) if s.kind in personal.BASE] == brute_spans(text), text


def test_kinds_that_anchors_add():
    def found(text):
        return [(s.kind, text[s.start : s.end]) for s in personal.find_personal(text) if s.kind not in personal.BASE]

    assert found("IBAN: DE89 3704 0044 0532 0130 00, iban DE88370400440532013000 and IBAN GB82WEST12345698765432.") == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ]
    assert found("Account No. 1234567, account 1234567, Konto: 123 456 789; accounts: 12345678; cuenta #12") == [("account", "1234567"), ("account", "123 456 789")]
    assert found("SSN 123-45-6789, ssn: 000-12-3456, Social Security number 987-65-4321; social security 219-09-9999") == [("ssn", "123-45-6789"), ("ssn", "219-09-9999")]
    assert found("see https://bob:pw@h.example.com/x and https://h.example.com/a@b ftp://joe@10.0.0.1") == [("login", "https://bob:pw@h.example.com"), ("login", "ftp://joe@10.0.0.1")]
    assert found("tel:030-1234567. hotel:030-1234567 tel:+49(30)1234567)") == [("tel", "tel:030-1234567"), ("tel", "tel:+49(30)1234567")]


def test_personal_query(spark, tmp_path):
    long = "é 1.2.3.4 " * 20_000
    rows = [(1, "é x@y.zz, +1 (555) 555-0100"), (2, None), (3, ""), (4, "4465758382889437 4465758382889437"), (4, "4465758382889437"), (None, "a@b.c"), (5, long), (6, "SSN 123-45-6789 9.9.9.9")]
    got = {(r.doc_id, r.spans): r for r in op13_personal_anchors(spark, texts(tmp_path, spark, rows)).collect()}
    for doc_id, text in rows:
        base = brute_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        row = got[doc_id, joined + (",ssn:4:15" if doc_id == 6 else "")]
        assert row.base_sha256 == sha(joined) and [row[f"n_{k}"] for k in PATTERNS] == [sum(b[0] == k for b in base) for k in PATTERNS]


def test_personal_query_on_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_personal_anchors(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id: ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(r.text)) for r in rows}
    assert {k: r.spans for k, r in got.items()} == want and any(want.values())


def test_masked_texts(spark):
    df = spark.createDataFrame([("mail x@y.zz or +1 (555) 555-0100, https://bob:pw@h.example.com",), (None,), ("",), ("clean 1.2.3",)], "text string")
    out = [r.m for r in df.select(personal.masked(F.col("text")).alias("m")).collect()]
    assert out == ["mail <EMAIL> or <PHONE>, <LOGIN>", None, "", "clean 1.2.3"]
