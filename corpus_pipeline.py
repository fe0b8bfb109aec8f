"""Corpus pipeline over ``documents``: quality, near-duplicates, secrets, mixing, packing.

Every stage reads whole texts, however long, and keeps columns of any name beside those that it needs (the last one returns its own). An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm import minhash, mixing, packing, quality, secrets
from tapewise.llm.common import boxed, materialise, quoted, table, unboxed
from tapewise.llm.queries import OTHER_WEIGHT, TARGET_WEIGHTS, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees score at or above the threshold.

    Null and empty texts are scored as empty, so equal rows stay or go together. The trees are fitted on labels of documents that are not held out;
    without labels every text gets 0.5 and stays. Rows without a key are scored like others.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(model, F.col("text")) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts without words (null or empty) are like nothing and stay, and so do rows without a key. Rows with the same key are one document,
    which stays or goes as a whole.
    """
    groups = minhash.near_duplicates(docs, words=5)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking credentials are replaced by a placeholder, and n_chars is the new length (null texts keep theirs).

    Owners are sources, null ones one owner; repeated rows count as one repository and get the same text.
    """
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixture order: part files follow the slots, and so do the rows within each.

    Null sources are the source ''; null keys and repeated rows take slots of their own.
    """
    whole = docs.select("doc_id", "source", boxed(docs).alias("doc"))  # no column of docs can clash with the results
    slots = mixing.pfair_mix(whole, TARGET_WEIGHTS, OTHER_WEIGHT)
    return slots.repartitionByRange("slot").sortWithinPartitions("slot").select(*unboxed("doc", docs.columns))


def _order(docs: DataFrame) -> list[Column]:
    """File and row number of each row: a table's rows in the order in which they were written. Rows of no file have their partition instead."""
    try:
        found = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
        docs.select(*found).schema  # fails where the rows come from no Parquet file
        return found
    except AnalysisException:
        return [F.lpad(F.spark_partition_id().cast("string"), 9, "0"), F.monotonically_increasing_id() % (1 << 33)]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, each with its sequence and its place there; sequences follow the order of the documents, which is the mixture's.

    Null and empty texts are one piece, the end id alone; null keys and repeated rows are pieces of their own. Part files follow the sequences.
    """
    file, row = _order(docs)
    pieces = docs.select("doc_id", "source", file.alias("_of"), row.alias("_at"), F.explode(packing.token_pieces(F.col("text"), tokenizer_path(), cache=packing.SHORT)).alias("p"))
    pieces = materialise(pieces.select("doc_id", "source", "_of", "_at", "p.*"), "pieces")
    packed = packing.pack_in_order(pieces, ["_of", "_at"])
    return packed.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]
#: Trees and tokens are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline")
    return docs
