"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, minhash, mixing, ogg, packing, personal, quality, secrets, sharding, squares, urls, variants, vectors
from .common import materialise, table, text_or_empty

#: Target shares of the mixture: one large source is held to 20 parts, every other source gets 4.
TARGET_WEIGHTS, OTHER_WEIGHT = {"src0": 20}, 4
SHARDS = 24


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.pfair_mix(docs, TARGET_WEIGHTS, OTHER_WEIGHT)


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.stratified_shards(rows, SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    stored = docs.withColumn("media", ogg.ogg_of_text(F.col("text")))
    back = stored.withColumn("parts", ogg.ogg_parts(F.col("media")))
    payload = F.col("parts.payload")
    return back.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "parts.feature", F.concat(F.lit("seconds="), F.col("parts.seconds"))).alias("feature"),
        F.col("parts.pages").alias("pages"), F.col("parts.packets").alias("packets"), F.col("parts.error").alias("error"),
    )


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def tokenizer_path() -> str:
    """Where the public tokenizer's file lies; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, licenses.fit_licenses(spark))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.find_secrets(docs)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {i})) AS bigint)").alias(f"n_{k.name}") for i, k in enumerate(secrets.BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_text("spans", len(secrets.BASE)), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"),
        F.size("live").cast("long").alias("n_live"), (F.size("spans") - F.size("live")).cast("long").alias("n_example"),
    )


def op7_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = docs.select("doc_id", F.explode(packing.token_pieces(F.col("text"), tokenizer_path())).alias("p")).select("doc_id", "p.*")
    return packing.pack(materialise(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"])


def op9_url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def altered_words(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) with ``words``: in every tenth text by checksum of the id, all words from some place on repeat the first ones from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    altered = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    altered = altered.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    altered = altered.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a)")
    return altered.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.expr("slice(w, 1, a)"), again), " ")).alias("text"))


def op11_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = altered_words(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("found", squares.periodic_runs(F.col("text")))
    runs = F.arrays_zip(F.col("found.starts").alias("start"), F.col("found.lengths").alias("length"), F.col("found.periods").alias("period"))
    docs = docs.select("doc_id", "found.collapsed", runs.alias("runs"))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    docs = docs.withColumn("lines", lines).withColumn("best", F.when(F.size("runs") > 0, longest))
    length = -F.col("best.shorter")
    return docs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(-best.shorter * 1000) div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.word_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), "word").cast("binary")))
    at = F.col("h") % F.length("word")
    short = F.concat(F.expr("left(word, cast(h % length(word) AS int))"), F.col("word").substr((at + 2).cast("int"), F.length("word")))
    words = hashed.select(F.when(F.col("h") % 97 == 0, short).otherwise(F.col("word")).alias("word"))
    return variants.spelling_variants(materialise(variants.vocabulary(words), "vocabulary"))


def op13_personal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", personal.personal_spans(text_or_empty()).alias("spans"))
    counts = [F.size(F.filter("spans.kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in personal.BASE]
    spans = F.col("spans")
    return found.select("doc_id", *counts, F.sha2(personal.span_text(spans, personal.BASE), 256).alias("base_sha256"), personal.span_text(spans).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pfair_mix, op2_license_scan, op3_stratified_shards, op4_ogg_media, op5_superminhash, op6_secret_owners, op7_exact_complement_packing,
        op8_quality_trees, op9_url_links, op10_pivot_permutations, op11_dyadic_runs, op12_spelling_variants, op13_personal_anchors,
    )
}


def _secrets_sql() -> str:
    parts = []
    for i, k in enumerate(secrets.KINDS):
        p = k.pattern.replace("'", "''")
        parts.append(f"""
            SELECT doc_id, source, {i} AS rank, '{k.name}' AS kind, unnest(string_split_regex(text, '{p}')[:-2]) AS gap,
                   unnest(regexp_extract_all(text, '{p}')) AS found, unnest(regexp_extract_all(text, '{p}', {k.group})) AS value,
                   generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM documents WHERE text IS NOT NULL""")
    least = "[" + ", ".join(str(k.least) for k in secrets.KINDS) + "]"
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{k.name}" for i, k in enumerate(secrets.BASE))
    return f"""
    WITH raw AS ({" UNION ALL ".join(parts)}),
    placed AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM raw),
    spans AS MATERIALIZED (SELECT doc_id, source, rank, kind, CAST(e - length(found) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value
                           FROM placed WHERE length(value) >= {least}[rank + 1]),
    owners AS (SELECT value, owners >= {secrets.EXAMPLE_OWNERS} OR (owners > 1 AND repositories >= {secrets.EXAMPLE_REPOSITORIES}) AS copied
               FROM (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT doc_id) AS repositories FROM spans GROUP BY 1)),
    per_doc AS (SELECT doc_id, {counts}, sha256({joined.format(f" FILTER (rank < {len(secrets.BASE)})")}) AS base_sha256, {joined.format("")} AS spans,
                       count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_example
                FROM spans JOIN owners USING (value) GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM documents LEFT JOIN per_doc USING (doc_id)
    """


ORACLE_SQL: dict[str, str] = {"op6_secret_owners": _secrets_sql(), "op9_url_links": urls.oracle_sql()}
