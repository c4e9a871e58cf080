"""Session construction, shared-folder handling and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows, with what a hash table adds to each, stay under so many bytes.
MAX_BROADCAST_BYTES = 16 << 20
ROW_OVERHEAD = 24


def get_session(app: str = "gavelspark", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the active session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GAVEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, but only for a local master; a cluster without the
    setting is an error, because a machine-local folder would not survive there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gavelspark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out to all cores if it has fewer partitions than there are cores.

    One small file is one task otherwise, however much work follows in Python; scans of many files stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have the repository on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_gavelspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    work = tempfile.mkdtemp(prefix="gavelspark-ship-")
    atexit.register(shutil.rmtree, work, ignore_errors=True)
    archive = os.path.join(work, "gavelspark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._gavelspark_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    Unlike ``localCheckpoint`` the result survives the loss of executors, and unlike ``checkpoint``
    later readers prune columns. The files are removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:
        pass  # the session has ended; its owner clears the folder


def checked_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``max_bytes``, else unchanged (shuffle join).

    The width of a row is the usual one of its types; rows are counted no further than the bound.
    """
    most = max_bytes // (ROW_OVERHEAD + df._jdf.schema().defaultSize())
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
