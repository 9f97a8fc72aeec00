"""What the operators of this subpackage share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, wherever a contract speaks of words (fixed pattern; same in Java, RE2 and Python).
WORD = r"[^\x20\x09-\x0D]+"
#: Files of a table in the shared folder: enough to keep all cores busy, and few enough to open.
FILES_A_CORE, FILE_BYTES = 2, 64 << 20
#: Seconds that :func:`release` waits after each of its looks.
PAUSES = (0.3, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine without that setting (a test) gets a folder of its own; on a cluster it is an error.
    """
    for held in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if held:
            return held.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    fs, at = _folder(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, what: str, files: int = FILES_A_CORE) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at replicated files, so a lost executor
    costs no recomputation and what is used twice is computed once. It is in few files, see :func:`packed`, or more
    ``files`` a core where its rows are costly to make; they go with :func:`dropped`, or when the session ends."""
    spark = df.sparkSession
    folder = shared_folder(spark, what)
    path = f"{folder}/rows"
    packed(df, files).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` made and that nothing reads any more."""
    for df in tables:
        fs, at = _folder(df.sparkSession, df.stored_at)
        fs.delete(at, True)


def pieces_of(df: DataFrame, a_core: int = FILES_A_CORE, most_bytes: int = FILE_BYTES) -> int:
    """How many parts of a table suit it: so many for each core of the cluster, or one for each ``most_bytes`` that it is
    made from if these are more."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(a_core * df.sparkSession.sparkContext.defaultParallelism, min(read // most_bytes, 1 << 30))


def packed(df: DataFrame, files: int = FILES_A_CORE) -> DataFrame:
    """``df`` for writing: in so many files for each core of the cluster, or one for each FILE_BYTES that it is made
    from if these are more, so that tasks stay small however much there is."""
    return df.coalesce(pieces_of(df, files))


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs leave with the driver. Shuffle files, whose results have been written, would else stay
    on disk until the driver happens to collect its garbage; what listeners still hold is free only after they have had
    their turn, so this looks twice. The collection also gives back heap, and free memory of Python goes back too."""
    for pause in PAUSES:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    trim()


def trim() -> None:
    """Give memory that this process has freed back to the machine, where its libraries can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Python workers started on this machine find the library wherever the driver found it. On a cluster it is
    installed or passed by --py-files, and the added entry does no harm."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in (held := env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def small_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 8 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``most_bytes`` bytes: texts may be long, and a batch is held whole
    by a Python worker and by the executor beside it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        held = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if held > most or held <= 0:
            spark.conf.set(key, str(most))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``mod``; rows without id are in fold 0 of the empty text's crc."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod
