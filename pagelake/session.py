"""Spark session helpers.

On a cluster the session comes from the platform (spark-submit / notebook) and
already carries ``spark.checkpoint.dir`` pointing at shared storage; nothing
here overrides settings that are already present. ``get_spark`` is the local
builder used by tests, the bench and the examples.
"""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library relies on for reproducible results; applied only when
# the session does not set them already.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Tables and stages are read by this library alone; whole pages take half the disk of Spark's default.
TABLE_CODEC = "zstd"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pagelake") -> SparkSession:
    """Local session for tests and benches (UI off, loopback only)."""
    master = master or os.environ.get("PAGELAKE_MASTER", "local[*]")
    if shuffle_partitions is None:
        shuffle_partitions = int(os.environ.get("PAGELAKE_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("PAGELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("pagelake.scan.partitions", str(shuffle_partitions))
    prepare_session(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only on a ``local`` master (tests) is a scratch folder set when the session names none;
    on a cluster that is an error, because executors do not share local folders.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current is not None:
        return current
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="pagelake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a write inside go when it ends: the table that it wrote replaces them."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


_recorded = threading.local()


@contextmanager
def stages_recorded():
    """The folders that ``materialize`` writes inside, in this thread, as a list for :func:`drop_stages`."""
    lists = _recorded.__dict__.setdefault("lists", [])
    lists.append(paths := [])
    try:
        yield paths
    finally:
        lists[:] = [x for x in lists if x is not paths]


def materialize(df, name: str = "stage"):
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it
    back: one job, lineage cut, and the data survives the loss of executors
    (unlike cached blocks).  Used where a plan would otherwise be recomputed."""
    import os
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "pagelake-stages", f"{name}-{uuid.uuid4().hex}")
    for paths in getattr(_recorded, "lists", ()):
        paths.append(path)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").option("compression", TABLE_CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``pagelake`` importable in Python workers (functions defined in the
    package are pickled by reference).  The package is zipped once and added
    with ``addPyFile`` — the same mechanism as ``spark-submit --py-files`` —
    once per SparkContext."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_pagelake_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="pagelake-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    sc._pagelake_shipped = True


def prepare_session(spark: SparkSession) -> SparkSession:
    """Checkpoint folder (from the session, scratch only when unset) and the
    package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def drop_stages(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the stage folders ``materialize`` wrote under the shared
    checkpoint folder (``pagelake-stages``), or those of ``paths`` only.  Call it once the
    DataFrames read from them are no longer needed (end of a job); it never touches other data."""
    base = ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    for folder in [os.path.join(base, "pagelake-stages")] if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            fs.delete(path, True)
