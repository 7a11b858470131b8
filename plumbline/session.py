"""Session for tests and benchmarks, shared folder, and spreading of small inputs."""
import os
import tempfile
from contextlib import contextmanager
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str | None] = {}


def build_session(cores: int | str = "*", app: str = "plumbline", settings: dict | None = None) -> SparkSession:
    """Local session with further ``settings``.  On a cluster use the session it gives; nothing below depends on these."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    return (SparkSession.builder.config(map=settings or {}).master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(parallel))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.maxMetadataStringLength", "1000")  # pushed filters are shown whole, however long the column ids are
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folders.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="spark-")
        _local_folders[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_folder` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What a query in here shuffles is removed as it ends, not when the driver happens to collect garbage: steps that store tables one after
    the other need the disk of the largest, not of all."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core.  Inputs with enough splits are left alone, so
    large tables are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
