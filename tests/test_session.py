"""Folder of intermediates and what is deleted from it."""

import os

import pytest

from affinis import session


def test_only_own_tables_are_dropped(spark, tmp_dir):
    one, two = (session.scratch_path(spark, n) for n in ("one", "two"))
    for path in (one, two, f"{tmp_dir}/other"):
        spark.range(3).write.parquet(path)
    assert session.drop_intermediates(spark, [one, f"{tmp_dir}/other"]) == 1
    local = lambda p: p.removeprefix("file://")
    assert not os.path.exists(local(one)) and spark.read.parquet(two).count() == 3
    assert spark.read.parquet(f"{tmp_dir}/other").count() == 3
    assert session.drop_intermediates(spark, [one]) == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_split_is_written_anew_after_new_input_or_a_drop(spark, tmp_dir):
    from affinis.plans import catalog
    from conftest import SF001
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(f"{tmp_dir}/{name}.parquet")
    first, *_ = catalog.split_frames(spark, tmp_dir)
    assert catalog.split_frames(spark, tmp_dir)[0] is first
    n = first.count()
    spark.read.parquet(f"{SF001}/lineitem.parquet").write.mode("append").parquet(f"{tmp_dir}/lineitem.parquet")
    second, *_ = catalog.split_frames(spark, tmp_dir)
    assert second.count() > n
    folder = second.inputFiles()[0].split("/split=")[0].split("file:")[-1]
    own = [p for p in session._WRITTEN[spark.sparkContext.applicationId] if folder.endswith(p.split("file:")[-1])]
    assert session.drop_intermediates(spark, own) == 1
    third, *_ = catalog.split_frames(spark, tmp_dir)
    assert third.count() == second.sparkSession.read.parquet(third.inputFiles()[0].split("/split=")[0]).count() > n
