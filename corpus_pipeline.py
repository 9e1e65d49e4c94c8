"""Corpus pipeline: filter, deduplicate, decontaminate, scan and mix ``documents``.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps,
with the columns of ``documents``; the last one adds the mix.  Rows are told
apart by id and text, so rows that share an id are judged on their own.
Null texts are empty documents, further columns stay, and an empty table
goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import decontamination, mixing, near_dup, quality, secrets
from affinis.session import materialize, ship_package

_ROW = "_pipeline_row"
#: Words as the decontamination takes them, and the shortest item that a document is dropped for.
_WORD = r"(?:[a-z0-9]|[^\x00-\x7F])+"
_LEAST_WORDS = 5


def _row_key() -> F.Column:
    """Id and text digest of a row as one string."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents whose row key is (left_semi) or is not (left_anti) among ``rows``."""
    return docs.withColumn(_ROW, _row_key()).join(rows, _ROW, how).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as low quality or toxic go."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = quality.train(docs, labels)
    keyed = docs.withColumn(_ROW, _row_key())
    kept = quality.classify(keyed, models=known, doc_id=_ROW).where("keep")
    return _only(docs, kept.select(F.col("doc_id").alias(_ROW)), "left_semi")


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id, once."""
    ship_package(spark)
    kept = near_dup.near_duplicates(docs).where("kept").select(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_key").alias(_ROW))
    one = docs.withColumn(_ROW, _row_key()).dropDuplicates([_ROW])
    return one.join(kept, _ROW, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of five words or more go.

    A shorter item ("Yes") is no passage that a document could have copied;
    it would take most documents with it.
    """
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.size(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_WORD), F.lit(0)))
    found = decontamination.contaminated(docs.withColumn(_ROW, _row_key()), items.where(words >= _LEAST_WORDS), doc_id=_ROW)
    return _only(docs, found.select(F.col("doc_id").alias(_ROW)).distinct(), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret, or with linked parts of one, go."""
    ship_package(spark)
    found = secrets.scan(docs.withColumn(_ROW, _row_key()), doc_id=_ROW).where(F.size("spans") > 0)
    return _only(docs, found.select(F.col("doc_id").alias(_ROW)).distinct(), "left_anti")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order.

    Adds ``mix_size`` (words), ``mix_taken`` (words taken in all copies),
    ``mix_copy`` and ``mix_position``; documents that the mix does not take
    have no row.
    """
    ship_package(spark)
    mixed = mixing.mix(docs.withColumn(_ROW, _row_key()), doc_id=_ROW).where(F.size("positions") > 0) \
        .dropDuplicates(["doc_id", "positions"])
    copies = mixed.select(F.col("doc_id").alias(_ROW), F.col("size").alias("mix_size"),
                          F.col("taken").alias("mix_taken"), F.posexplode("positions").alias("mix_copy", "mix_position"))
    return docs.withColumn(_ROW, _row_key()).dropDuplicates([_ROW]).join(copies, _ROW) \
        .select(*docs.columns, "mix_size", "mix_taken", "mix_copy", "mix_position") \
        .orderBy("mix_position", "doc_id", "mix_copy")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_neardup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
]

#: A trained classifier decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder and the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
