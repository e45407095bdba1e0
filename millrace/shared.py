"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local folder is made if all runs in one process, as in tests; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def drop(df: DataFrame | None) -> None:
    """Remove the table of a frame that ``cut`` gave, once nothing reads it any more; other frames stay as they are."""
    path = getattr(df, "_millrace_path", None)
    if path:
        _remove(df.sparkSession, path)


def cut(df: DataFrame, partition_by: str | None = None, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result survives the loss of any executor and later uses don't repeat the
    work before it. The table is removed when the program ends, or as soon as another one
    takes its place: rounds of an iteration hand their last table over as ``instead``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    drop(instead)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out
