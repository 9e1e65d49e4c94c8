"""Ratings table as a log of batches with maintained statistics (ST1, V-7, A9, A10).

  <path>/_bucket=../_batch=../          rows of a batch, last one per (user, item)
  <path>.stats/values/_batch=../        (value, n): changes of the rows per rating value
  <path>.stats/users/_bucket=../_batch=../   (id, n): changes of the items per user
  <path>.stats/items/_bucket=../_batch=../   (id, n): changes of the users per item
  <path>.stats/purged/_batch=../        (purged): batches that this batch takes back
  <path>.stats/commits/_batch=../       one row of totals, written last

A batch is compared with the rows that it replaces, which are read from
the buckets of its own keys alone.  Rows per rating value carry counts, so
a replaced or purged rating is taken back exactly: minimum, maximum, mean
and the histogram over a range that moves follow from the values that are
left.  A user is counted when their number of items leaves zero.

Every table of a batch is a partition of its own and depends on earlier
batches only; a replayed batch replaces its partitions.  Readers take
batches up to the last commit, so a batch counts whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import bucket5
from ..operators.prep import dedup_keep_last
from ..session import materialize

#: The batch number of the rows that a log starts with.
BASE = -1
BUCKETS = 64
KEYS = ("user_id", "item_id")


def _bucket(*columns: str, n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def _same(a: DataFrame, b: DataFrame, columns=KEYS) -> Column:
    """Equality that takes nulls as equal."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"_{c}"])
    return out


class RatingsLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        commits = self._commits().where(F.col("_batch") == BASE).first()
        self.buckets = commits["n_buckets"]
        self.types = {"user_id": commits["user_type"], "item_id": commits["item_type"]}

    @classmethod
    def create(cls, ratings: DataFrame, path: str, buckets: int = BUCKETS) -> "RatingsLog":
        """Start a log from ratings (user_id, item_id, rating, ts)."""
        log = cls.__new__(cls)
        log.spark, log.path, log.buckets = ratings.sparkSession, path, buckets
        log.types = {c: t for c, t in ratings.dtypes if c in KEYS}
        log._put(log.spark.createDataFrame([], "purged int"), "purged", BASE, mode="overwrite")
        log._put(log._fresh(ratings), None, BASE, ("_bucket",), "overwrite")
        log._write_changes(log._change(BASE), BASE, "overwrite")
        return log

    # -- tables ------------------------------------------------------------
    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}.stats/{name}")

    def _commits(self) -> DataFrame:
        return self._table("commits", "users long, items long, n_buckets int, user_type string, item_type string, _batch int")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(
            f"user_id {self.types['user_id']}, item_id {self.types['item_id']}, rating double, ts timestamp, "
            "_bucket int, _batch int").parquet(self.path)

    def _put(self, df: DataFrame, name: str | None, batch: int, parts: tuple[str, ...] = (), mode: str | None = None) -> None:
        """Write the partitions of a batch; a replay replaces them."""
        target = self.path if name is None else f"{self.path}.stats/{name}"
        writer = df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").partitionBy(*parts, "_batch")
        if mode is None:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(target)

    def last(self) -> int:
        """The newest batch that is whole."""
        return self._commits().agg(F.max("_batch")).first()[0]

    def purged(self, before: int) -> list[int]:
        found = self._table("purged", "purged int, _batch int").where(F.col("_batch") < before)
        return [r[0] for r in found.select("purged").distinct().collect()]

    # -- readers -----------------------------------------------------------
    def current(self, before: int | None = None, buckets: list[int] | None = None,
                without: list[int] | None = None) -> DataFrame:
        """V-7 on read: the last row per (user, item); ``buckets`` prunes folders."""
        before = self.last() + 1 if before is None else before
        rows = self._rows().where(F.col("_batch") < before)
        if buckets is not None:
            rows = rows.where(F.col("_bucket").isin(buckets))
        gone = without if without is not None else self.purged(before)
        if gone:
            rows = rows.where(~F.col("_batch").isin(gone))
        return dedup_keep_last(rows.drop("_bucket"), KEYS, ("ts", "rating"), seq="_batch").drop("_batch")

    def stats(self, before: int | None = None) -> DataFrame:
        """A9 + A10, as ``profile.dataset_stats`` of the current table; reads no rating."""
        before = self.last() + 1 if before is None else before
        values = self._table("values", "value double, n long, _batch int").where(F.col("_batch") < before) \
            .groupBy("value").agg(F.sum("n").alias("n")).where("n <> 0")
        values = materialize(values, "stat-values")
        known = F.when(F.col("value").isNotNull(), F.col("n"))
        base = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_ratings"), F.min("value").alias("min_rating"),
                          F.max("value").alias("max_rating"),
                          (F.sum(F.col("value") * F.col("n")) / F.sum(known)).alias("avg_rating"))
        totals = self._commits().where(F.col("_batch") < before).agg(
            F.sum("users").alias("total_users"), F.sum("items").alias("total_items"))
        base = base.crossJoin(totals)
        placed = values.crossJoin(F.broadcast(base.select("min_rating", "max_rating"))) \
            .withColumn("_b", bucket5("value", "min_rating", "max_rating"))
        counts = placed.agg(*[F.coalesce(F.sum(F.when(F.col("_b") == i, F.col("n"))), F.lit(0)).alias(f"_c{i}")
                              for i in range(5)])
        whole = sum(F.col(f"_c{i}") for i in range(5))
        share = F.array(*[F.when(whole > 0, F.col(f"_c{i}") / whole).otherwise(F.lit(0.0)) for i in range(5)])
        per = lambda c: F.col("total_ratings") / F.when(F.col(c) > 0, F.col(c))
        pairs = F.col("total_users") * F.col("total_items")
        return base.crossJoin(counts.select(share.alias("rating_distribution"))).select(
            "total_ratings", "total_users", "total_items", "min_rating", "max_rating", "avg_rating",
            "rating_distribution", per("total_users").alias("avg_ratings_per_user"),
            per("total_items").alias("avg_ratings_per_item"),
            (F.lit(1.0) - F.col("total_ratings") / F.when(pairs > 0, pairs)).alias("sparsity"))

    # -- writers -----------------------------------------------------------
    def append(self, rows: DataFrame, batch: int) -> None:
        """Merge a batch: later batches win, inside a batch the last (ts, rating)."""
        self._put(self._fresh(rows), None, batch, ("_bucket",))
        change = self._change(batch)
        old = _keyed(self.current(batch, _touched(self._rows().where(F.col("_batch") == batch))))
        change = change.drop("old", "has_old").join(old, _same(change, old), "left").drop("_user_id", "_item_id")
        self._write_changes(change, batch)

    def _change(self, batch: int) -> DataFrame:
        """The rows of a batch as changes from nothing."""
        return self._rows().where(F.col("_batch") == batch).select(
            *KEYS, F.col("rating").alias("new"), F.lit(True).alias("has_new"), F.lit(None).cast("double").alias("old"),
            F.lit(None).cast("boolean").alias("has_old"))

    def purge(self, batch: int, as_batch: int) -> None:
        """Take back a batch, as batch ``as_batch``; the rows that it had replaced count again."""
        gone = self.purged(as_batch)
        mine = self._rows().where(F.col("_batch") == batch) if batch not in gone else self._rows().where("false")
        fresh, touched = mine.select(*KEYS), _touched(mine)
        old = _keyed(self.current(as_batch, touched, gone))
        new = _keyed(self.current(as_batch, touched, [*gone, batch]), "new")
        change = fresh.join(old, _same(fresh, old), "left").drop("_user_id", "_item_id")
        change = change.join(new, _same(change, new), "left").drop("_user_id", "_item_id")
        self._put(self.spark.createDataFrame([(batch,)], "purged int"), "purged", as_batch)
        self._write_changes(change, as_batch)

    def _fresh(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*KEYS, F.col("rating").cast("double").alias("rating"), F.col("ts").cast("timestamp").alias("ts"))
        return dedup_keep_last(rows).withColumn("_bucket", _bucket(*KEYS, n=self.buckets))

    def _write_changes(self, change: DataFrame, batch: int, mode: str | None = None) -> None:
        """Changes of the statistics from (user, item, old, has_old, new, has_new); the commit comes last."""
        change = materialize(change.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_old", "has_new")}), "log-change")
        values = change.where("has_new").select(F.col("new").alias("value"), F.lit(1).alias("n")) \
            .union(change.where("has_old").select("old", F.lit(-1))).groupBy("value").agg(F.sum("n").alias("n"))
        self._put(values.where("n <> 0"), "values", batch, mode=mode)
        turned = change.withColumn("n", F.col("has_new").cast("int") - F.col("has_old").cast("int")).where("n <> 0")
        users, items = (self._count(turned, c, f"{c[:4]}s", batch, mode) for c in KEYS)
        commit = self.spark.createDataFrame(
            [(users, items, self.buckets, self.types["user_id"], self.types["item_id"])],
            "users long, items long, n_buckets int, user_type string, item_type string")
        self._put(commit, "commits", batch, mode=mode)

    def _count(self, turned: DataFrame, key: str, name: str, batch: int, mode: str | None) -> int:
        """Write the changes per id; ids that came minus ids that went."""
        change = turned.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.sum("n").alias("n")).where("n <> 0")
        self._put(change.withColumn("_bucket", _bucket("id", n=self.buckets)), name, batch, ("_bucket",), mode)
        table = self._table(name, f"id {self.types[key]}, n long, _bucket int, _batch int")
        mine = table.where(F.col("_batch") == batch)
        known = table.where((F.col("_batch") < batch) & F.col("_bucket").isin(_touched(mine))) \
            .groupBy("id").agg(F.sum("n").alias("_n"))
        before = F.coalesce("_n", F.lit(0))
        born, gone = (before == 0) & (F.col("n") > 0), (before > 0) & (before + F.col("n") == 0)
        return mine.join(known, "id", "left").agg(F.count_if(born) - F.count_if(gone)).first()[0]


def _touched(df: DataFrame) -> list[int]:
    """Buckets of a batch: at most as many numbers as there are buckets."""
    return sorted(r[0] for r in df.select("_bucket").distinct().collect())


def _keyed(rows: DataFrame, name: str = "old") -> DataFrame:
    return rows.select(F.col("user_id").alias("_user_id"), F.col("item_id").alias("_item_id"), F.col("rating").alias(name),
                       F.lit(True).alias(f"has_{name}"))
