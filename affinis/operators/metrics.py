"""Ranking, rating and beyond-accuracy metrics as DataFrame aggregates.

Recommendations are long form ``(user_id, rank, item_id, score)``; truth
is any ``(user_id, item_id, ...)`` table (deduplicated here).  Every
metric is a join + per-user aggregate + global average; nothing is
collected per user on the driver.

Variants (named, because the reference mixes them):
  precision  'min' -> hits / min(k, list length)      (E1)
             'k'   -> hits / k                          (E1b)
  ndcg       'standard'    ideal length min(relevant, k)            (E3)
             'skip_no_hit' users without a hit skipped, ideal length
                           min(relevant, list length)                 (E3b)
  map        'hit_users' AP = sum(prec@hit)/min(rel,k), users with a hit (E4)
             'all'       same AP, users without a hit count as 0       (E4b)
             'hits'      AP = mean of precisions at hits, hit users   (E4c)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _idcg(m) -> F.Column:
    """sum_{i=1..m} 1/log2(i+1) (HOF over a bounded sequence, m <= k)."""
    return F.when(m <= 0, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), m.cast("int")), F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1)))


def per_user_ranking(recs: DataFrame, truth: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Per-user components: n_recs, hits, dcg, ap_sum, n_relevant.

    Only users present in both the recommendations and the truth.
    W5: running hit count over rank (window bounded by k rows per user).
    With ``by`` the recommendations hold a set of lists for each value of
    these columns; here and below all of them are scored in one pass.
    """
    top = recs.where(F.col("rank") <= k).select(*by, "user_id", "rank", "item_id")
    rel = truth.select("user_id", "item_id").distinct()
    n_rel = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    j = top.join(rel.withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left") \
           .withColumn("_hit", F.coalesce(F.col("_hit"), F.lit(0)))
    # position among the user's top-k rows (1-based), robust to rank gaps
    w = Window.partitionBy(*by, "user_id").orderBy("rank")
    j = j.withColumn("_pos", F.row_number().over(w)) \
         .withColumn("_cum", F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = j.groupBy(*by, "user_id").agg(
        F.count(F.lit(1)).alias("n_recs"),
        F.sum("_hit").alias("hits"),
        F.sum(F.col("_hit") / F.log2(F.col("_pos") + 1)).alias("dcg"),
        F.sum(F.when(F.col("_hit") == 1, F.col("_cum") / F.col("_pos")).otherwise(0.0)).alias("ap_sum"))
    return per.join(n_rel, "user_id")


def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int = 10,
                    precision: str = "min", ndcg: str = "standard",
                    map_variant: str = "hit_users", by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``precision_at_k, recall_at_k, ndcg_at_k, map_at_k,
    n_users``."""
    per = per_user_ranking(recs, truth, k, by)
    hits = F.col("hits").cast("double")
    prec = hits / (F.least(F.col("n_recs"), F.lit(k)) if precision == "min" else F.lit(k))
    recall = hits / F.col("n_relevant")
    if ndcg == "standard":
        nd = F.col("dcg") / _idcg(F.least(F.col("n_relevant"), F.lit(k)))
        nd_keep = F.lit(True)
    else:
        nd = F.col("dcg") / _idcg(F.least(F.col("n_relevant"), F.col("n_recs")))
        nd_keep = F.col("hits") > 0
    if map_variant == "hits":
        ap = F.col("ap_sum") / F.col("hits")
        ap_keep = F.col("hits") > 0
    else:
        ap = F.col("ap_sum") / F.least(F.col("n_relevant"), F.lit(k))
        ap_keep = (F.col("hits") > 0) if map_variant == "hit_users" else F.lit(True)
    return per.groupBy(*by).agg(
        F.coalesce(F.avg(prec), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.avg(recall), F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(nd_keep, nd)), F.lit(0.0)).alias("ndcg_at_k"),
        F.coalesce(F.avg(F.when(ap_keep, ap)), F.lit(0.0)).alias("map_at_k"),
        F.count(F.lit(1)).alias("n_users"))


def coverage(recs: DataFrame, train: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """E5: distinct recommended items / distinct train items."""
    rec = recs.groupBy(*by).agg(F.count_distinct("item_id").alias("_r"))
    cat = train.agg(F.count_distinct("item_id").alias("_c"))
    return rec.crossJoin(cat).select(
        *by,
        F.when(F.col("_c") > 0, F.col("_r") / F.col("_c")).otherwise(0.0).alias("coverage"))


def novelty(recs: DataFrame, train: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over users of mean self-information -log2(count/total);
    items unknown to train contribute 0."""
    total = train.agg(F.count(F.lit(1)).alias("_t"))
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("_cnt"))
    info = pop.crossJoin(F.broadcast(total)).select(
        "item_id", (-F.log2(F.col("_cnt") / F.col("_t"))).alias("_si"))
    per = recs.join(info, "item_id", "left").groupBy(*by, "user_id").agg(
        F.avg(F.coalesce(F.col("_si"), F.lit(0.0))).alias("_u"))
    return per.groupBy(*by).agg(F.coalesce(F.avg("_u"), F.lit(0.0)).alias("novelty"))


def diversity(recs: DataFrame, item_vectors: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """E7 / E8.

    With vectors (E7): mean pairwise cosine distance of each list's items
    that have a vector, lists with < 2 vectors skipped, averaged over
    users.  Computed without forming pairs: for unit vectors v_i,
    sum_{i<j} v_i.v_j = (|sum v_i|^2 - m) / 2, so the mean pairwise
    distance is 1 - (|sum v_i|^2 - m) / (m (m - 1)).  Per user the list is
    bounded by k, so the per-user vector sum is a bounded collect.
    Without vectors (E8): unique / length for lists of length >= 2.
    """
    if item_vectors is None:
        per = recs.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("_n"),
                                               F.count_distinct("item_id").alias("_u"))
        # a list too short counts in no average, but its group still has a row
        per = per.select(*by, F.when(F.col("_n") >= 2, F.col("_u") / F.col("_n")).alias("_d"))
        return per.groupBy(*by).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("diversity"))
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    unit = item_vectors.select("item_id", F.transform("features", lambda x: x / norm).alias("_v"))
    j = recs.select(*by, "user_id", "item_id").join(unit, "item_id")
    per = j.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("_m"),
                                        F.collect_list("_v").alias("_vs"))
    per = per.where(F.col("_m") >= 2)
    dim = F.size(F.element_at("_vs", 1))
    summed = F.aggregate(
        "_vs", F.array_repeat(F.lit(0.0), dim),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    sq = F.aggregate(summed, F.lit(0.0), lambda a, x: a + x * x)
    m = F.col("_m").cast("double")
    per = per.select(*by, (F.lit(1.0) - (sq - m) / (m * (m - 1))).alias("_d"))
    return per.groupBy(*by).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("diversity"))


def beyond_accuracy(recs: DataFrame, train: DataFrame, item_vectors: DataFrame | None = None,
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage, novelty, diversity in one row (one for each value of ``by``)."""
    parts = coverage(recs, train, by), novelty(recs, train, by), diversity(recs, item_vectors, by)
    if by:
        return parts[0].join(parts[1], list(by)).join(parts[2], list(by))
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def rating_errors(scored: DataFrame, actual: str = "rating", prediction: str = "prediction") -> DataFrame:
    """RMSE and MAE over the rows of ``scored`` (truth rows carrying a
    ``prediction`` column).  Rows whose prediction is NULL are skipped —
    the 'skip' policy; the global-mean policy fills them upstream
    (``popularity.predict_user_mean(..., unknown_item='global_mean')``)."""
    j = scored.where(F.col(prediction).isNotNull())
    err = F.col(prediction) - F.col(actual)
    return j.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                 F.count(F.lit(1)).alias("n_pairs"))
