"""Tables in the folder that the driver and all executors share: what is used twice is written once, and lineage ends at
files that outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session on one machine without that setting (a test) gets a folder of its own; on a
    cluster it is an error."""
    for held in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if held:
            return held.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path of a name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    fs, at = hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder, in folders ``by`` some columns, and read back; it goes with :func:`gone`, or
    when the session ends."""
    spark = df.sparkSession
    folder = shared_folder(spark, what)
    df.write.partitionBy(*by).parquet(f"{folder}/rows")
    out = spark.read.schema(df.schema).parquet(f"{folder}/rows")
    out.stored_at = folder
    return out


def gone(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stored` made and that nothing reads any more."""
    for df in tables:
        fs, at = hadoop(df.sparkSession, df.stored_at)
        fs.delete(at, True)
