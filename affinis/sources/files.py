"""Rating-file readers (S2-S8) with explicit schemas.

Every reader returns the canonical interaction schema
``(user_id STRING, item_id STRING, rating DOUBLE, ts TIMESTAMP)`` — ids are
strings (product ids are alphanumeric), epoch seconds become timestamps.
Files are read by Spark (splittable, distributed); the only driver-side
work is listing candidate paths and sniffing one header line.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import coerce_ratings

# Candidate file names for product-review data, in order.
REVIEW_FILE_NAMES = ["reviews.csv", "amazon_reviews.csv", "amazon_product_reviews.csv",
                     "ratings_Electronics.csv"]
# Header aliases -> canonical column.
COLUMN_ALIASES = {"userId": "user_id", "productId": "item_id", "Rating": "rating",
                  "reviewerID": "user_id", "asin": "item_id", "overall": "rating"}
# Supported (domain, dataset) pairs.
DATASETS = {("entertainment", "movielens"), ("ecommerce", "amazon"), ("education", "open_university")}

RAW_TSV = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("rating", T.StringType()), T.StructField("timestamp", T.StringType())])


def canonical(df: DataFrame, ts_unit: str = "s") -> DataFrame:
    """(user_id, item_id, rating, timestamp?) -> canonical types."""
    cols = [F.col("user_id").cast("string").alias("user_id"),
            F.col("item_id").cast("string").alias("item_id"),
            F.col("rating")]
    if "timestamp" in df.columns:
        sec = F.expr("try_cast(timestamp AS BIGINT)")
        ts = F.timestamp_millis(sec) if ts_unit == "ms" else F.timestamp_seconds(sec)
        cols.append(ts.alias("ts"))
    return coerce_ratings(df.select(*cols), "drop")


def read_ratings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, headerless (user, item, rating, epoch seconds)."""
    return canonical(spark.read.schema(RAW_TSV).option("sep", "\t").csv(path))


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV with header ``userId,movieId,rating,timestamp``."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({"userId": "user_id", "movieId": "item_id"})
    return canonical(df)


def list_files(spark: SparkSession, root: str, name_glob: str) -> list[str]:
    """Sorted paths below ``root`` matching ``name_glob`` (binaryFile
    listing; the content column is never read)."""
    try:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", name_glob).load(root).select("path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["path"] for r in df.collect())


def find_ratings_file(spark: SparkSession, root: str, name: str = "ratings.csv") -> str:
    """First ``ratings.csv`` below ``root`` in sorted path order."""
    found = list_files(spark, root, name)
    if not found:
        raise FileNotFoundError(f"{name} not found below {root}")
    return found[0]


def has_header(spark: SparkSession, path: str) -> bool:
    """True if the first line names a known column, or has no number where the rating stands.

    Ids are no evidence, so headerless files with alphanumeric ids are read
    as data.
    """
    known = {c.lower() for pair in COLUMN_ALIASES.items() for c in pair} | {"timestamp"}
    line = F.split(F.regexp_replace("value", "[\"\\s]", ""), ",")
    first = spark.read.text(path).limit(1).select(
        F.exists(line, lambda x: F.lower(x).isin(*known)).alias("named"),
        F.expr("try_cast(try_element_at(split(value, ','), 3) AS DOUBLE)").isNull().alias("no_rating"),
        (F.size(line) >= 3).alias("wide")).collect()
    return bool(first) and (first[0]["named"] or (first[0]["wide"] and first[0]["no_rating"]))


def read_product_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate names, else the first CSV; header sniffed; aliases
    mapped; required columns checked; non-numeric ratings dropped (P6)."""
    order = {name: k for k, name in enumerate(REVIEW_FILE_NAMES)}
    found = list_files(spark, folder, "*.csv")
    if not found:
        raise FileNotFoundError(f"no review file in {folder}")
    return read_reviews_file(spark, min(found, key=lambda f: (order.get(f.rsplit("/", 1)[-1], len(order)), f)))


def read_reviews_file(spark: SparkSession, path: str) -> DataFrame:
    """Read one located review file (or folder of part files)."""
    if has_header(spark, path):
        df = spark.read.option("header", True).csv(path)
        df = df.withColumnsRenamed({k: v for k, v in COLUMN_ALIASES.items() if k in df.columns})
    else:
        df = spark.read.schema(RAW_TSV).csv(path)
    missing = [c for c in ("user_id", "item_id", "rating") if c not in df.columns]
    if missing:
        raise ValueError(f"required columns {missing} missing; found {df.columns}")
    return canonical(df)


def read_course_assessments(spark: SparkSession, path: str) -> DataFrame:
    """id_student -> user, id_assessment -> item, score -> rating."""
    df = spark.read.option("header", True).csv(path)
    df = df.select(F.col("id_student").alias("user_id"), F.col("id_assessment").alias("item_id"),
                   F.col("score").alias("rating"))
    return canonical(df)


def import_headerless(spark: SparkSession, src: str, dest: str) -> DataFrame:
    """Fixed-order headerless file -> cleaned canonical Parquet."""
    df = canonical(spark.read.schema(RAW_TSV).csv(src))
    df.write.mode("overwrite").parquet(dest)
    return spark.read.parquet(dest)


def load_dataset(spark: SparkSession, domain: str, dataset: str, root: str) -> DataFrame:
    """Dispatch by (domain, dataset); unknown pair -> ValueError."""
    if (domain, dataset) not in DATASETS:
        raise ValueError(f"unknown dataset {domain}/{dataset}")
    folder = f"{root.rstrip('/')}/{domain}/{dataset}"
    if dataset == "movielens":
        tsv = list_files(spark, folder, "u.data")
        return read_ratings_tsv(spark, tsv[0]) if tsv else read_ratings_csv(
            spark, find_ratings_file(spark, folder))
    if dataset == "amazon":
        return read_product_reviews(spark, folder)
    return read_course_assessments(spark, find_ratings_file(spark, folder, "studentAssessment.csv"))


NEW_RATING = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("rating", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType())])


def read_new_ratings(spark: SparkSession, path: str, now_epoch: int) -> DataFrame:
    """New-rating CSV files with coercion: ids -> string, bad rating ->
    0.0, bad timestamp -> ``now_epoch`` (a parameter, not the wall clock)."""
    df = spark.read.schema(NEW_RATING).option("header", True).csv(path)
    return coerce_ratings(df, "zero").select(
        "user_id", "item_id", "rating",
        F.coalesce(F.expr("try_cast(timestamp AS BIGINT)"), F.lit(now_epoch)).alias("timestamp"),
        F.coalesce(F.col("source"), F.lit("explicit")).alias("source"))
