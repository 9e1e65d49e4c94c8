"""Sources, store, ingest helpers and the update loop on small fixture files."""

import os

from pyspark.sql import functions as F

from affinis.operators import abtest, ingest, selection
from affinis.plans import pipeline
from affinis.sources import files, store
from conftest import rows


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_tsv_and_recursive_csv(spark, tmp_dir):
    write(f"{tmp_dir}/ml/u.data", "1\t10\t4\t881250949\n2\t10\t5\t891717742\n")
    df = files.read_ratings_tsv(spark, f"{tmp_dir}/ml/u.data")
    assert rows(df, "user_id", "item_id", "rating") == [("1", "10", 4.0), ("2", "10", 5.0)]
    write(f"{tmp_dir}/deep/b/ratings.csv", "userId,movieId,rating,timestamp\n3,7,2.5,1000000000\n")
    write(f"{tmp_dir}/deep/a/ratings.csv", "userId,movieId,rating,timestamp\n1,1,1,1000000000\n")
    path = files.find_ratings_file(spark, f"{tmp_dir}/deep")
    assert path.endswith("/a/ratings.csv")
    assert rows(files.read_ratings_csv(spark, path), "user_id") == [("1",)]


def test_product_reviews_sniff_alias_and_coercion(spark, tmp_dir):
    write(f"{tmp_dir}/amz/reviews.csv", "reviewerID,asin,overall,timestamp\nA1,B9,5,1\nA2,B9,bad,2\n")
    df = files.read_product_reviews(spark, f"{tmp_dir}/amz")
    assert rows(df, "user_id", "item_id", "rating") == [("A1", "B9", 5.0)]
    write(f"{tmp_dir}/amz2/other.csv", "1,10,4.0,1\n2,11,3.0,2\n")
    df2 = files.read_product_reviews(spark, f"{tmp_dir}/amz2")
    assert df2.count() == 2


def test_course_and_headerless_import(spark, tmp_dir):
    write(f"{tmp_dir}/ou/studentAssessment.csv", "id_assessment,id_student,score\n5,11,80\n")
    assert rows(files.read_course_assessments(spark, f"{tmp_dir}/ou/studentAssessment.csv"),
                "user_id", "item_id", "rating") == [("11", "5", 80.0)]
    write(f"{tmp_dir}/raw.csv", "u1,i1,3,1000000000\nu2,i2,x,1000000000\n")
    out = files.import_headerless(spark, f"{tmp_dir}/raw.csv", f"{tmp_dir}/clean")
    assert out.count() == 1


def test_new_ratings_reader_policy(spark, tmp_dir):
    write(f"{tmp_dir}/new/r.csv", "user_id,item_id,rating,timestamp,source\n1,2,x,bad,\n")
    r = files.read_new_ratings(spark, f"{tmp_dir}/new", now_epoch=42).collect()[0]
    assert (r["rating"], r["timestamp"], r["source"]) == (0.0, 42, "explicit")


def test_store_since_purge_and_has_ratings(spark, tmp_dir):
    df = spark.createDataFrame([("u1", "i1", 4.0, 100, None), ("u2", "i2", 3.0, 200, "implicit")],
                               "user_id string, item_id string, rating double, timestamp long, source string")
    store.append_ratings(store.validate_batch(df, 0), tmp_dir, "d", "s")
    assert rows(store.new_ratings(spark, tmp_dir, "d", "s", 200), "user_id") == [("u2",)]
    snap, removed = store.purge_before(spark, tmp_dir, "d", "s", 200, f"{tmp_dir}/snap")
    assert removed == 1 and snap.count() == 1
    from affinis.operators import prep
    users = spark.createDataFrame([("u1",), ("u9",)], "user_id string")
    assert rows(prep.users_with_ratings(users, df), "user_id") == [("u1",)]


def test_stage_idempotent(spark, tmp_dir):
    df = spark.createDataFrame([("u1", "i1", 4.0)], "user_id string, item_id string, rating double")
    store.stage(df, tmp_dir, "d", "s", "b1")
    store.stage(df, tmp_dir, "d", "s", "b1")
    store.stage(df.union(df), tmp_dir, "d", "s", "b2")
    assert store.newest_staged(spark, tmp_dir, "d", "s").count() == 2
    assert spark.read.parquet(f"{tmp_dir}/staging").where("batch_id = 'b1'").count() == 1


def test_role_mapping(spark):
    df = spark.createDataFrame([(f"c{i % 15}", f"p{i % 3}", float(i % 5), 1_600_000_000 + i) for i in range(100)],
                               "a string, b string, c double, d long")
    roles = ingest.map_columns(df)
    assert roles == {"timestamp": "d", "rating": "c", "user_id": "a", "item_id": "b"}
    named = spark.createDataFrame([("x", "y", 1.0)], "customer string, product string, score double")
    assert ingest.map_columns(named) == {"user_id": "customer", "item_id": "product", "rating": "score"}


def test_domain_resolution_and_interest(spark):
    profiles = spark.createDataFrame([("u1", {"ecommerce": ["amazon"]}), ("u2", {})],
                                     "user_id string, domain_preferences map<string, array<string>>")
    req = spark.createDataFrame([("u1", None, None), ("u2", None, None), ("u3", "education", "open_university")],
                                "user_id string, domain string, dataset string")
    got = rows(ingest.resolve_domain(req, profiles), "user_id", "domain", "dataset")
    assert got == [("u1", "ecommerce", "amazon"), ("u2", "entertainment", "movielens"),
                   ("u3", "education", "open_university")]
    assert rows(ingest.users_interested(profiles, "ecommerce", "amazon"), "user_id") == [("u1",)]


def test_date_parse_and_rekey(spark):
    d = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02",), ("junk",)], "date string")
    got = [r["timestamp"] for r in ingest.parse_dates(d, "date", now_epoch=7).collect()]
    assert got == [1704164645, 1704153600, 7]
    r = spark.createDataFrame([("42", "i", 5.0)], "user_id string, item_id string, rating double")
    acc = spark.createDataFrame([("acct-1", "42")], "user_id string, original_dataset_id string")
    assert rows(ingest.rekey_history(r, acc), "user_id", "source") == [("acct-1", "historical")]


def test_versions_numeric_and_champion(spark):
    m = spark.createDataFrame([("als", "9", 1.0), ("als", "10", 2.0)], "algorithm string, version string, timestamp double")
    assert rows(selection.latest_versions(m, 1), "version") == [("10",)]
    concl = spark.createDataFrame([("d", "s", 5.0, "sar")], "domain string, dataset string, concluded_at double, winning_model string")
    models = spark.createDataFrame([("d", "s", "als", "3", 9.0), ("e", "s", "svd", "1", 1.0)],
                                   "domain string, dataset string, algorithm string, version string, timestamp double")
    got = rows(abtest.champion(concl, models))
    assert got == [("d", "s", "sar", "ab_test"), ("e", "s", "svd", "latest")]
    tests = spark.createDataFrame([("t1", "active", 100.0), ("t2", "active", 5.0), ("t3", "concluded", 100.0)],
                                  "test_id string, status string, end_time double")
    assert rows(abtest.active_tests(tests, 50.0), "test_id") == [("t1",)]


def test_update_loop(spark, tmp_dir):
    main = spark.createDataFrame([("u%d" % i, "i%d" % (i % 5), float(1 + i % 5)) for i in range(100)],
                                 "user_id string, item_id string, rating double") \
        .withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    main.write.parquet(f"{tmp_dir}/main")
    new = spark.createDataFrame([("u%d" % i, "i9", 3.0, 2000, "explicit") for i in range(15)],
                                "user_id string, item_id string, rating double, timestamp long, source string")
    store.append_ratings(new, tmp_dir, "d", "s")
    rep = pipeline.update_dataset(spark, tmp_dir, f"{tmp_dir}/main", "d", "s", "b1", None,
                                  f"{tmp_dir}/snap1").collect()[0]
    assert rep["total_ratings"] == 15 and rep["merged_total"] == 115
    # the next run stages nothing again, a run of the same batch stages the same rows
    rep = pipeline.update_dataset(spark, tmp_dir, f"{tmp_dir}/snap1", "d", "s", "b2", None,
                                  f"{tmp_dir}/snap2").collect()[0]
    assert rep["total_ratings"] == 0 and rep["merged_total"] == 115
    rep = pipeline.update_dataset(spark, tmp_dir, f"{tmp_dir}/main", "d", "s", "b1", None,
                                  f"{tmp_dir}/snap3").collect()[0]
    assert rep["total_ratings"] == 15 and rep["merged_total"] == 115


def test_late_ratings_of_old_events_are_neither_lost_nor_doubled(spark, tmp_dir):
    """One arrives between two runs, one while the first is at work."""
    schema = "user_id string, item_id string, rating double, timestamp long, source string"
    main = spark.createDataFrame([("u%d" % i, "i%d" % (i % 5), float(1 + i % 5)) for i in range(40)],
                                 "user_id string, item_id string, rating double").withColumn("ts", F.timestamp_seconds(F.lit(9000)))
    main.write.parquet(f"{tmp_dir}/main")
    put = lambda rows, now: store.append_ratings(spark.createDataFrame(rows, schema), tmp_dir, "d", "s", now)
    run = lambda frm, batch, lo, hi, to: pipeline.update_dataset(
        spark, tmp_dir, f"{tmp_dir}/{frm}", "d", "s", batch, None, f"{tmp_dir}/{to}", lo, hi).first()
    put([("a", "i1", 3.0, 200_000, "explicit"), ("a", "i1", 3.0, 200_000, "explicit")], 200_100)
    put([("late", "i1", 4.0, 50, "explicit")], 300_000)  # after the cut of the first run
    first = run("main", "b1", 0, 250_000, "s1")
    assert (first["total_ratings"], first["merged_total"]) == (2, 41)
    put([("older", "i2", 2.0, 10, "explicit")], 300_001)
    second = run("s1", "b2", 250_000, 400_000, "s2")
    assert (second["total_ratings"], second["merged_total"]) == (2, 43)
    assert run("s2", "b3", 400_000, 500_000, "s3")["total_ratings"] == 0
    # the day of arrival prunes folders
    seen = store.new_ratings(spark, tmp_dir, "d", "s", ingested_since=300_000)
    assert rows(seen, "user_id") == [("late",), ("older",)]
    plan = " ".join(seen._jdf.queryExecution().executedPlan().toString().split())
    assert "ingest_date" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    left, gone = store.purge_staged(spark, tmp_dir, "d", "s", "b1", f"{tmp_dir}/new2")
    assert gone == 2 and rows(left, "user_id") == [("late",), ("older",)]


def test_prepare_cache_and_features(spark, tmp_dir):
    import datetime as dt
    raw = spark.createDataFrame([("u%d" % (i % 9), "i%d" % (i % 4), float(1 + i % 5), dt.datetime(2024, 1, 1 + i % 20))
                                 for i in range(120)], "user_id string, item_id string, rating double, ts timestamp")
    p1 = pipeline.prepare(raw, tmp_dir, "d", "s", min_ratings=10)
    assert p1.count() == 120 and set(rows(p1.select("split").distinct())) == {("train",), ("test",)}
    # second call reuses the cache even with different input
    p2 = pipeline.prepare(raw.limit(5), tmp_dir, "d", "s", min_ratings=10)
    assert p2.count() == 120
    feats = store.load_features(spark, tmp_dir, "d", "s")
    assert feats["user_features"].count() == 9


def test_retrain_decision_and_baseline(spark):
    from affinis.operators import drift
    rep = spark.createDataFrame([(False, [])], "should_retrain boolean, reasons array<string>")
    no_model = spark.createDataFrame([(False,)], "has_model boolean")
    tests_ = spark.createDataFrame([("t1",)], "test_id string")
    r = drift.retrain_decision(rep, no_model, tests_).collect()[0]
    assert r["retrain"] and r["reasons"] == ["no_model"] and r["active_ab_tests"] == 1
    hist = spark.createDataFrame([(10, 1.0, "training")], "total_ratings long, stats_time double, role string")
    cur = spark.createDataFrame([(12,)], "total_ratings long")
    out = drift.training_baseline(hist, cur, 2.0)
    newest = out.where("role = 'training'").orderBy(F.col("stats_time").desc()).first()
    assert newest["total_ratings"] == 12


def test_model_save_load_roundtrip(spark, tmp_dir):
    import datetime as dt
    from affinis.models import cooccurrence as cooc
    from affinis.models import popularity as popm
    df = spark.createDataFrame([("u%d" % (k % 5), "i%d" % (k % 7), 1.0, dt.datetime(2024, 1, 1)) for k in range(30)],
                               "user_id string, item_id string, rating double, ts timestamp")
    m = popm.fit(df)
    m.save(f"{tmp_dir}/pop")
    m2 = popm.PopularityModel.load(spark, f"{tmp_dir}/pop")
    assert rows(popm.recommend(m, n=3)) == rows(popm.recommend(m2, n=3))
    c = cooc.fit(df, materialize=False)
    c.save(f"{tmp_dir}/cooc")
    c2 = cooc.CooccurrenceModel.load(spark, f"{tmp_dir}/cooc")
    assert rows(cooc.recommend(c, n=3)) == rows(cooc.recommend(c2, n=3))
