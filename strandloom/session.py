"""Session factory and the durable work area used to cut lineage."""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", app: str = "strandloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    It is the one named by ``spark.checkpoint.dir``.  A session in one process
    (a test) that names none gets a private temporary folder; a cluster must
    name one, since its machines share no temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = getattr(work_dir, "_local", None)
        if not folder:
            made = tempfile.mkdtemp(prefix="strandloom-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = "file://" + made
            work_dir._local = folder  # type: ignore[attr-defined]
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the work area and read it back.

    The table survives the loss of executors, is read column by column, and what
    is computed from it is never computed twice from the source.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # at the latest with the application
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slots(spark: SparkSession) -> int:
    """Tasks that run at once."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Round-robin rows over the cluster where a scan has too few splits for the CPU work that follows.

    A table of one row group is one task whatever its size, so work of
    milliseconds a row would run on a single core.
    """
    spark = df.sparkSession
    want = factor * slots(spark)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
