import itertools
import shutil
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tapewise.llm import minhash, packing, secrets
from tapewise.llm.queries import OTHER_WEIGHT, TARGET_WEIGHTS

from .test_mixing_sharding import edf

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
ODD = ["", "Straße ÉÈ Œuvre naïve", "it's they'll 'sword ''s", "a<|endoftext|>b <| x", "tab\tnew\nline\r\n\x0b\x1c\x85\u2003wide", "e\u0301 ﬁ Ω K ſ ΣΑΣ µ ª", "123 4a5 !!!... $$ a-b_c", "日本語 😀 test", "x" * 5000, " lead  trail "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_cached_ids_equal_the_tokenizers(tokenizer):
    got = packing.Coder(PATH).encode(ODD * 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD * 2]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_cached_ids_of_any_text(tokenizer, text):
    assert np.frombuffer(packing.Coder(PATH).encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plan_uses_every_piece_once(counts):
    used = {}
    for items, many in packing.plan(counts, 64):
        assert sum(items) <= 64 and many > 0
        for x in items:
            used[x] = used.get(x, 0) + many
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=8))
def test_sums_equal_brute_force(counts):
    index = packing.SumIndex(counts, 64)
    for _ in range(3):
        pool = [x for x, n in counts.items() for _ in range(n)]
        for size, found in ((2, index.pair), (3, index.triple)):
            sums = {sum(c) for c in itertools.combinations(pool, size)}
            for total in range(1, 65):
                got = found(total)
                assert (got is not None) == (total in sums) and (got is None or (sum(got) == total and len(got) == size and index.take(got, 0) == 0))
        if not pool:
            break
        index.take((pool[0],), 1)  # entries are looked for again
        counts = {x: n - (x == pool[0]) for x, n in counts.items() if n > (x == pool[0])}


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, (rng.lognormal(6.5, 1, 20_000)).astype(int) + 1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    lines = list(packing.plan(counts))
    assert sum(m for _, m in lines) <= 1.002 * -(-int(lengths.sum()) // 4096)
    assert len(lines) <= 2 * 4096


def test_other_tokenizers_code_whole_texts(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.Coder(path).by_words and packing.Coder(PATH).by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Coder(path).encode(ODD)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ODD]


def test_short_caches_give_the_same_and_are_emptied():
    parts = [pd.Series([*ODD, None, " ".join(f"w{k} Word{k}." for k in range(n))]) for n in (700, 900)]
    short, usual = packing.Coder(PATH, 50), packing.Coder(PATH)
    cut = [list(itertools.chain(*packing.cut_texts(iter(parts), c, 64, 1, True, c is short))) for c in (short, usual)]
    assert cut[0] == cut[1]
    assert not short.chunks and not short.words and usual.chunks and usual.words


def test_packing_stage_leaves_no_cached_words_in_workers(spark):
    @F.pandas_udf("long")
    def cached(ids: pd.Series) -> pd.Series:
        left = sum(len(c.chunks) + len(c.words) for (_, cache), c in packing._coders.items() if cache == packing.SHORT)
        return pd.Series([left if any(cache == packing.SHORT for _, cache in packing._coders) else -1] * len(ids))

    corpus_pipeline.pack(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).collect()
    found = {r[0] for r in spark.range(0, 64, 1, 32).select(cached("id")).collect()}
    assert 0 in found and max(found) == 0


def test_packing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, 100 + k % 3, 1, 2, 3, 4) for k in range(90)], "doc_id long, length long, _hash int, _length int, _rank int, `a.b` int")
    got = packing.pack(df, ["doc_id"]).collect()
    assert len(got) == 90 and all((r["_hash"], r["_length"], r["_rank"], r["a.b"]) == (1, 2, 3, 4) for r in got)


def test_pack(spark, tokenizer):
    texts = [*ODD, None, "word " * 9000, *["short one"] * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.explode(packing.token_pieces(F.col("text"), PATH, with_ids=True)).alias("p")).select("doc_id", "p.*", F.lit(0).alias("offset"))
    got = packing.pack(df, ["doc_id", "piece"]).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole.get(r.doc_id, b"")) // 4 and zlib.crc32(r.ids) == r.ids_crc32 and r.length == len(r.ids) // 4
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    for k, t in enumerate(texts):
        assert np.frombuffer(whole[k], "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(df.limit(0), ["doc_id", "piece"]).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"s{len(list(tmp_path.iterdir()))}")
        stage(spark, docs, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        if stage is corpus_pipeline.keep_quality:
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            kept = labels.join(out, "doc_id", "left_semi").where("quality = 1").count()
            assert kept >= 0.97 * labels.where("quality = 1").count() and out.count() < docs.count()
        if stage is corpus_pipeline.drop_near_duplicates:
            want = minhash.brute_force({r.doc_id: r.text for r in docs.collect()}, words=5)
            assert {r.doc_id for r in out.collect()} == set(want.values())
        if stage is corpus_pipeline.redact_secrets:
            assert out.count() == docs.count() and secrets.find_secrets(out).where("size(live) > 0 and exists(live, s -> s.kind <> 'assign')").count() == 0
        if stage is corpus_pipeline.mix:
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
        if stage is corpus_pipeline.pack:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        else:
            assert out.columns == docs.columns
        docs = out


def test_pipeline_on_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path)


def small(spark):
    rows = [(k, f"word{k} text of source {k % 3}" * (1 + k % 5), "en", f"src{k % 3}" if k % 7 else None, 1) for k in range(60)]
    rows += [(100, None, "en", "src0", None), (101, "", None, "src1", 0), (None, "no key here at all", "en", "src0", 18), (5, *rows[5][1:]), (102, "long " * 6000, "en", "src2", 30000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 AS sequence_id", "8 AS `_hash`", "9 AS `a.b`")


def test_mixing_stage_equals_brute_force(spark):
    docs = small(spark)
    out = corpus_pipeline.mix(spark, docs, DATA)
    assert out.columns == docs.columns
    got = [r.source or "" for r in out.collect()]
    counts = Counter(r.source or "" for r in docs.collect())
    slots = edf(counts, {s: TARGET_WEIGHTS.get(s, OTHER_WEIGHT) for s in counts})
    assert got == [s for (s, _), _ in sorted(slots.items(), key=lambda x: x[1])]
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_packing_stage_equals_brute_force(spark, tokenizer):
    docs = small(spark)
    got = corpus_pipeline.pack(spark, docs, DATA).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r.doc_id, r.source, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.source, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(by) == -(-sum(r.length for r in got) // 4096)


def test_stages_with_odd_rows(spark, tmp_path):
    docs = small(spark)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert near.columns == docs.columns and {100, 101, None} <= {r.doc_id for r in near.collect()}
    red = corpus_pipeline.redact_secrets(spark, docs, DATA)
    assert sorted(map(str, red.collect())) == sorted(map(str, docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).collect()))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == docs.count()
