"""Session construction and the shared folder in which lineage is cut.

A cluster names its shared folder in ``spark.checkpoint.dir``; it is read from the session and never replaced.
Only where nothing is set (tests, a laptop) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "tracewright") -> SparkSession:
    """A single-JVM session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names, else, in a single JVM only, one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tracewright-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` files by hash of ``key`` and return a scan of it: joins of such tables on the key move nothing."""
    spark = df.sparkSession
    name = f"tw_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    _delete_on_exit(spark, path)
    return spark.table(name)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of it.

    Unlike a cache the copy survives the loss of any executor, and later scans prune its columns and filter inside the
    files. The folder is removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tw-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application.

    The archive lies in the shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tracewright_shipped", False):
        return
    here, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for at, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("tracewright", os.path.relpath(full, here)))
    archive = f"{shared_dir(spark)}/tracewright_{uuid.uuid4().hex}.zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(archive)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(bytearray(held.getvalue()))
    out.close()
    fs.deleteOnExit(at)
    sc.addPyFile(archive)
    sc._tracewright_shipped = True
