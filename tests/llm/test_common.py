import os
from types import SimpleNamespace

import pytest

from tessera.llm import common


def folder(df):
    return df.stored_at.removeprefix("file:")


def test_written_tables_have_few_files_and_go(spark):
    rows = spark.range(1000).repartition(50)
    table = common.written(rows, "t")
    files = [f for _, _, names in os.walk(folder(table)) for f in names if f.endswith(".parquet")]
    assert table.count() == 1000 and len(files) <= common.FILES_A_CORE * spark.sparkContext.defaultParallelism
    common.dropped(table)
    assert not os.path.exists(folder(table))


def test_files_follow_the_size_beyond_a_few_a_core(spark, monkeypatch):
    table = common.written(spark.range(200_000).repartition(50), "t", 20)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder(table)) for f in names if f.endswith(".parquet"))
    wide = table.repartition(64)
    few = common.FILES_A_CORE * spark.sparkContext.defaultParallelism
    assert common.packed(wide).rdd.getNumPartitions() == few
    monkeypatch.setattr(common, "FILE_BYTES", size // (few + 10))
    assert few < common.packed(wide).rdd.getNumPartitions() <= 64


def test_a_cluster_needs_a_shared_folder():
    def session(master, held=None):
        conf = SimpleNamespace(get=lambda key, default=None: held)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app", getConf=lambda: conf))

    assert common.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_batches_are_bounded(spark):
    common.small_batches(spark, 500, 1 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500" and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 1 << 20
    common.small_batches(spark)  # never widens what is narrower
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
