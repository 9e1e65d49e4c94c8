"""Mixing of sources with a time-varying curriculum.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating.
They share all words of the input by weight; no target exceeds ``epochs``
times its source's size, and the excess is shared again by weight.  With
sources sorted by cap / weight the capped ones are a prefix, so running
sums give the common level in one pass.

Positions: each source has a schedule, its rate on equal steps of the
training run.  The integral of the rate, scaled to the target, is the
source's cumulative word demand; the training position of a document copy
is where the demand reaches the words taken before that copy's middle.  A
source takes its documents in hash order, again and again until its
target is met; the last document taken may be cut.

Prefix sums are made per (source, hash bucket) and then inside a bucket,
so a source with a third of all rows is spread over many tasks.

Cases: null or empty texts have size 0 and are never taken; a null source
is a source of its own; repeated rows are separate documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.session import materialize

#: Fixed values of the mix: weights by source rank and the cap in epochs.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Schedules by source rank: first sources early, last ones late.
RATES = ((1.6, 1.2, 0.8, 0.4), (1.0, 1.0, 1.0, 1.0), (0.4, 0.8, 1.2, 1.6))
ROWS_PER_BUCKET = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, rates=RATES) -> DataFrame:
    """(source, source_size) -> adds weight, target, rates; one row per source.

    The windows run over one row per source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*values), (F.col("_rank") % len(values) + 1).cast("int"))
    s = sizes.withColumn("_rank", rank) \
        .withColumn("weight", pick([F.lit(w) for w in weights]).cast("long")) \
        .withColumn("rates", pick([F.array(*map(F.lit, r)) for r in rates])) \
        .withColumn("_cap", F.col("source_size") * epochs)
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("_rank"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("_all", F.sum("source_size").over(every)) \
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                    / F.sum("weight").over(onward))
    # the first source that its level does not fill sets the level of all later ones
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"),
                         F.struct(F.col("_cap") / F.col("weight"), F.col("_rank"), F.col("_level")))).over(every)["_level"]
    return s.withColumn("_common", level).select(
        "source", "source_size", "weight", "rates",
        F.least(F.col("_cap").cast("double"), F.col("_common") * F.col("weight")).alias("target"))


def training_position(share, rates):
    """Inverse of the integrated schedule: where ``share`` of the demand is met."""
    m = F.size(rates)
    whole = F.aggregate(rates, F.lit(0.0), lambda a, x: a + x)
    want = share * whole
    step = F.aggregate(
        rates, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("t")),
        lambda a, r: F.struct(
            (a["sum"] + r).alias("sum"),
            F.when(want > a["sum"], a["t"] + F.when(r > 0, F.least(F.lit(1.0), (want - a["sum"]) / r))
                   .otherwise(F.lit(1.0))).otherwise(a["t"]).alias("t")))
    return step["t"] / m


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, rates=RATES,
        rows_per_bucket: int = ROWS_PER_BUCKET, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, source, target, taken, positions) per document.

    ``positions`` has the training position in [0, 1) of every copy taken.
    """
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_key")), "mix-sizes")
    buckets = max(1, math.ceil(base.count() / rows_per_bucket))
    slot = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    base = base.withColumn("_bucket", F.floor(slot * buckets / F.lit(1 << 32)).cast("int"))

    parts = base.groupBy("source", "_bucket").agg(F.sum("size").alias("_part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, epochs, rates)
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_part").over(ahead), F.lit(0))) \
        .alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))) \
        .select(F.col("p.source").alias("_source"), F.col("_bucket").alias("_slot"), "_ahead",
                "source_size", "target", "rates")

    rows = base.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_slot")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .withColumn("_full", F.when(F.col("source_size") > 0,
                                    F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))) \
        .withColumn("_rest", F.round(F.col("target") - F.col("_full") * F.col("source_size")).cast("long")) \
        .withColumn("_last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))) \
        .withColumn("taken", (F.col("size") * F.col("_full") + F.col("_last")).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("_full") + F.when(F.col("_last") > 0, 1).otherwise(0)).otherwise(0)
    share = lambda e: F.least(F.lit(1.0), (  # noqa: E731  of the source's demand at the middle of copy e
        e * F.col("source_size") + F.col("_before")
        + F.when(e < F.col("_full"), F.col("size")).otherwise(F.col("_last")) / 2) / F.col("target"))
    positions = F.when(copies > 0, F.transform(
        F.sequence(F.lit(0), (copies - 1).cast("int")), lambda e: training_position(share(e), F.col("rates")))) \
        .otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "size", "source_size", "source", "target", "taken", positions.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position."""
    return mixed.select("*", F.posexplode("positions").alias("copy", "position")) \
        .drop("positions").orderBy("position", "doc_id", "copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs).withColumn("first_position", F.round(F.try_element_at("positions", F.lit(1)), 9))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position") \
        .orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap,
              CASE r % 3 WHEN 0 THEN [1.6, 1.2, 0.8, 0.4] WHEN 1 THEN [1.0, 1.0, 1.0, 1.0]
                         ELSE [0.4, 0.8, 1.2, 1.6] END AS rates FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                  - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
s4 AS (SELECT *, first_value(lvl) OVER (ORDER BY (lvl * w > cap), cap / w, r
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM s3),
s AS (SELECT source, source_size, CAST(rates AS DOUBLE[]) AS rates,
             least(CAST(cap AS DOUBLE), common * w) AS target FROM s4),
j AS (SELECT d.*, s.source_size, s.target, s.rates,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size) ELSE 0 END AS whole
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, greatest(0, least(size, round(target - whole * source_size) - before)) AS last FROM j),
u AS (SELECT *, CASE WHEN size > 0 AND (whole > 0 OR last > 0) THEN
        least(1.0, (before + CASE WHEN whole > 0 THEN size ELSE last END / 2) / target) * 4.0 END AS want FROM t)
SELECT doc_id, size, source_size, target, CAST(size * whole + last AS BIGINT) AS taken,
       round(CASE WHEN want IS NULL THEN NULL
         WHEN want <= rates[1] THEN want / rates[1]
         WHEN want <= rates[1] + rates[2] THEN 1 + (want - rates[1]) / rates[2]
         WHEN want <= rates[1] + rates[2] + rates[3] THEN 2 + (want - rates[1] - rates[2]) / rates[3]
         ELSE 3 + least(1.0, (want - rates[1] - rates[2] - rates[3]) / rates[4]) END / 4, 9) AS first_position
FROM u
"""
