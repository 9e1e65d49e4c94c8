"""Session helpers.

The library never forces cluster-sized settings: shuffle partitions,
broadcast threshold and the checkpoint folder are taken from the session
the caller built.  ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "affinis", checkpoint: str | None = None) -> SparkSession:
    """Local session for tests / bench (UI off, UTC, AQE on)."""
    checkpoint = checkpoint or tempfile.mkdtemp(prefix="affinis-ckpt-")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AFFINIS_DRIVER_MEM", "16g"))
        .config("spark.checkpoint.dir", checkpoint)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


def tune(spark: SparkSession) -> None:
    """Settings every job of the library relies on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # shuffle files go when the job that made them has ended, not when the driver collects garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # rows of packed columns are large: both sides of a Python step hold some batches
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application).

    Functions that run in Python workers import its modules; a worker does
    not share the driver's ``sys.path``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="affinis-pkg-")) / "affinis.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Taken from the cluster setting ``spark.checkpoint.dir`` (or a
    checkpoint folder already set on the context).  Without either, a
    ``local[...]`` session gets a scratch folder (driver and executors are
    one process there) and any other master is an error: executors would
    each write to their own disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="affinis-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_WRITTEN: dict[str, list[str]] = {}


def drop_intermediates(spark: SparkSession, paths: list[str] | None = None, named: set[str] | None = None) -> int:
    """Delete intermediate tables of this application: all, or those given (by path, or by folder name).

    For jobs whose results are stored: results that have not been written
    yet still read these tables.  Returns the number of folders deleted;
    only paths that ``scratch_path`` gave out are touched.
    """
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    chosen = [p for p in own if (paths is None or p in paths) and (named is None or p.rsplit("/", 1)[1] in named)]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for path in chosen:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        done += bool(target.getFileSystem(conf).delete(target, True))
        own.remove(path)
    return done


def file_states(spark: SparkSession, *frames: DataFrame) -> list[tuple[str, int, int]]:
    """(file, length, modification time) of the files that the frames read, in name order."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted({f for df in frames for f in df.inputFiles()}):
        # inputFiles() are URIs
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def is_written(spark: SparkSession, table: DataFrame) -> bool:
    """Whether all files of a written table are still there."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in table.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name))
        if not path.getFileSystem(conf).exists(path):
            return False
    return True


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where a plan is reused by several downstream jobs and its
    lineage is long; the written table survives executor loss.
    ``partition_by`` turns later filters on those columns into directory
    pruning.
    """
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    # the schema is known: no job to read it from the files
    return df.sparkSession.read.schema(df.schema).parquet(path)
