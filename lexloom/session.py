"""Session defaults and the shared folder for cut lineage and streaming state."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A cluster names that setting; only a local master may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return os.path.join(base, f"lexloom-{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so lost executors cost no rerun."""
    folder = shared_folder(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_DEALT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when the input has fewer files than there are cores.

    For expensive per-row work on a few files of one row group each, which a reader cannot split. The
    number of parts grows with the size of the files, so a part stays small however large they are.
    Only the file list is looked at, no job runs; input in many files is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    return df.repartition(max(cores, -(-_stored_bytes(df.sparkSession, files) // _DEALT_BYTES)))


def _stored_bytes(spark: SparkSession, files: list[str]) -> int:
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]  # names come URL-encoded
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lexloom")
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, "lexloom"))
    _shipped.add(app)
