import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewise.llm import ogg, quality
from tapewise.llm.queries import op4_ogg_media, op8_quality_trees

DATA = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=30_000), st.integers(0, 6))
def test_payload_survives(data, times):
    payload = ogg.padded(data * (times + 1))
    back = ogg.read(ogg.write(payload))
    assert back["error"] == "" and back["payload"] == payload and back["streams"] == 2
    assert back["times"] == [i * ogg.PACKET / ogg.RATE for i in range(-(-len(payload) // ogg.PACKET))]


def test_page_checksum_is_the_unreflected_one():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.page_crc(data) == slow(data)


def page(serial, number, flags, granule, lacing, body):
    whole = ogg._HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing) + body
    return whole[:22] + ogg.page_crc(whole).to_bytes(4, "little") + whole[26:]


def test_packets_run_over_pages():
    payload = ogg.padded(bytes(range(256)) * 400)
    media = ogg.write(payload)
    flags, granules, at = [], [], 0
    while at < len(media):
        head = ogg._HEAD.unpack_from(media, at)
        flags.append(head[2])
        granules.append(head[3])
        at += 27 + head[7] + sum(media[at + 27 : at + 27 + head[7]])
    assert sum(f & 1 for f in flags) >= 5 and granules.count(-1) >= 1 and ogg.read(media)["payload"] == payload


def test_demux_of_any_ogg_file():
    a = [page(7, 0, 2, 0, [3], b"hea"), page(7, 1, 0, 5, [2, 2, 255], b"aabb" + b"c" * 255), page(7, 2, 1, -1, [255] * 3, b"c" * 765), page(7, 3, 5, 9, [0, 4], b"dddd")]
    b = [page(9, 0, 2, 0, [1], b"x"), page(9, 1, 4, 70, [255, 10], b"y" * 265)]
    streams, errors = ogg.demux(a[0] + b[0] + a[1] + b[1] + a[2] + a[3])
    assert errors == [] and [(s.serial, s.pages, s.ended) for s in streams] == [(7, 4, True), (9, 2, True)]
    assert streams[0].packets == [b"hea", b"aa", b"bb", b"c" * 1020, b"dddd"] and streams[0].granules == [0, None, 5, None, 9]
    assert streams[1].packets == [b"x", b"y" * 265] and streams[1].granules == [0, 70]
    chained, errors = ogg.demux(b"".join(a + b + a))
    assert errors == [] and [s.serial for s in chained] == [7, 9, 7] and chained[2].packets == streams[0].packets
    missing, errors = ogg.demux(a[0] + a[1] + a[3])
    assert errors and missing[0].packets == [b"hea", b"aa", b"bb", b"dddd"]  # the packet that is cut is left out
    turned, errors = ogg.demux(a[0] + a[2] + a[1] + a[3])
    assert errors and turned[0].packets[0] == b"hea" and b"c" * 1020 not in turned[0].packets
    broken = bytearray(b"".join(a))
    broken[len(a[0]) + 40] ^= 1
    assert ogg.demux(b"junk" + bytes(broken))[0][0].packets[0] == b"hea" and len(ogg.demux(b"junk" + bytes(broken))[1]) >= 2
    assert ogg.demux(b"") == ([], [])


def test_column_of_streams(spark):
    good = page(1, 0, 2, 0, [1], b"h") + page(1, 1, 4, 8, [2, 2], b"aabb")
    rows = spark.createDataFrame([(1, good), (2, good[:-1]), (3, None), (4, b"")], "id int, media binary").withColumn("s", ogg.ogg_streams(F.col("media"))).collect()
    got = {r.id: r.s for r in rows}
    assert [bytes(p) for p in got[1].streams[0].packets] == [b"h", b"aa", b"bb"] and got[1].streams[0].granules == [0, None, 8] and got[1].errors == []
    assert len(got[2].streams[0].packets) == 1 and got[2].errors and got[3].errors and got[4].streams == []


def test_damage_is_found():
    media = ogg.write(ogg.padded(bytes(range(256)) * 100))
    for at in (0, 30, 100, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        assert ogg.read(bytes(broken))["error"]
    assert ogg.read(media[:-10])["error"] and ogg.read(media[: len(media) // 3])["error"] and ogg.read(b"OggS")["error"]


def test_media_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op4_ogg_media(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        payload = ogg.padded(data)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and len(payload) % 64 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.error == ""


def test_media_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000)], "id int, text string").withColumn("parts", ogg.ogg_parts(ogg.ogg_of_text(F.col("text"))))
    got = {r.id: r.parts for r in df.collect()}
    assert bytes(got[1].payload) == bytes(got[2].payload) == bytes(64) and len(got[3].payload) == 300_032
    null = spark.range(1).select(ogg.ogg_parts(F.lit(None).cast("binary")).alias("p")).first().p
    assert null.error and bytes(null.payload) == b""


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = x[2000]
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(one[model.feature[t, node]] > model.threshold[t, node])
        total += model.leaf[t, node - model.feature.shape[1]]
    assert model.score(one[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_trees_without_labels_or_with_one_class():
    assert quality.fit(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((5, 3)), np.ones(5)).score(np.zeros((1, 3)))[0] > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = op8_quality_trees(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, None), (3, ""), (None, "x"), (1, "good words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = docs.withColumn("score", quality.quality_score(model, F.col("text"))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit_quality(docs.limit(0), labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_quality_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    learnt = sorted(k for k in labels if zlib.crc32(str(k).encode()) % 5 and k in docs)
    model = quality.fit(np.array([quality.statistics(docs[k]) for k in learnt]), np.array([float(labels[k]) for k in learnt]))
    for r in op8_quality_trees(spark, DATA).collect():
        x, total = quality.statistics(docs[r.doc_id]), model.base
        for features, cuts, leaves in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(features):
                node = 2 * node + (2 if x[features[node]] > cuts[node] else 1)
            total += leaves[node - len(features)]
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_quality_of_a_very_long_text():
    x = quality.statistics("some words, and more of them. " * 200_000)
    assert len(x) == len(quality.FEATURES) and all(np.isfinite(x))
