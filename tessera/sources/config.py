"""Dictionaries for query rewriting, read from JSON with Spark, so from any store; kept if a reload fails."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rewrite import Dictionaries

#: Entries of a dictionary file at most: it is held by every Python worker.
MOST = 100_000
SYNONYMS = "version string, entries array<struct<key:string,synonyms:array<string>,category:string,enabled:boolean>>"
STOP_WORDS = "version string, zh array<string>, en array<string>"
MAPPING = "version string, entries array<struct<from:string,to:string,enabled:boolean,confidence:double>>"

# The dictionaries that are shipped, and used where no file can be read at first.
DEFAULT = Dictionaries(
    synonyms={
        "换工作": ["职业转换", "跳槽", "转行", "career switch"],
        "薪资": ["工资", "薪酬", "收入", "salary"],
        "阅读": ["文章", "短文", "passage", "reading"],
        "词汇": ["单词", "词", "vocabulary", "word"],
        "主旨": ["大意", "中心思想", "main idea", "gist"],
        "配置": ["设置", "参数", "config", "setting"],
        "切片": ["分块", "切分", "chunk", "split"],
        "召回": ["检索", "搜索", "recall", "retrieve"],
    },
    fixed={"专升本": "专升本 3500词", "讲稿": "讲义", "API": "API 接口"},
    confidence={"专升本": 0.95, "讲稿": 0.95, "API": 0.90},
)


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Enabled entries, in order; an entry that doesn't say is enabled."""
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.posexplode("entries").alias("place", "e")).select("place", "e.*").where(F.coalesce("enabled", F.lit(True)))


def _rows(spark: SparkSession, path: str, schema: str) -> list | None:
    """Entries of a file, or None if it can't be read or isn't as it should be."""
    try:
        rows = entries(spark, path, schema).orderBy("place").limit(MOST + 1).collect()
    except Exception as e:
        if _unreadable(e):
            return None
        raise
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} entries")
    return rows


def _unreadable(e: Exception) -> bool:
    return isinstance(e, AnalysisException) or "MALFORMED" in str(e) or "FileNotFound" in str(e)


def _stop_words(spark: SparkSession, path: str) -> frozenset[str] | None:
    try:
        rows = spark.read.schema(STOP_WORDS).json(path, multiLine=True, mode="FAILFAST").select(F.explode(F.concat(F.coalesce("zh", F.array()), F.coalesce("en", F.array()))).alias("w"))
        words = [r["w"] for r in rows.where("w IS NOT NULL").limit(MOST + 1).collect()]
    except Exception as e:
        if _unreadable(e):
            return None
        raise
    if len(words) > MOST:
        raise ValueError(f"more than {MOST} stop words")
    return frozenset(w.lower() for w in words)


def load(spark: SparkSession, synonyms: str, mapping: str, before: Dictionaries | None = None, stop: str | None = None) -> Dictionaries:
    """A snapshot of the files. Of one that can't be read, what ``before`` holds stays, or else what is shipped."""
    held = before or DEFAULT
    words, fixed = _rows(spark, synonyms, SYNONYMS), _rows(spark, mapping, MAPPING)
    stops = _stop_words(spark, stop) if stop else None
    if words is not None:
        held = replace(held, synonyms={r["key"]: r["synonyms"] or [] for r in words if r["key"]})
    if fixed is not None:
        held = replace(held, fixed={r["from"]: r["to"] for r in fixed if r["from"]}, confidence={r["from"]: 0.95 if r["confidence"] is None else r["confidence"] for r in fixed if r["from"]})
    return held if stops is None else replace(held, stop=stops)


def changed_at(spark: SparkSession, path: str) -> int:
    """When a file was changed, in milliseconds; 0 if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getModificationTime() if fs.exists(at) else 0


class Watched:
    """Dictionaries that follow their files: :meth:`current` reads again, before a batch of queries, what has changed."""

    def __init__(self, spark: SparkSession, synonyms: str, mapping: str, stop: str | None = None):
        self.spark, self.paths, self.times, self.held = spark, (synonyms, mapping, stop), None, DEFAULT

    def current(self) -> Dictionaries:
        times = [changed_at(self.spark, p) if p else 0 for p in self.paths]
        if self.times is None or any(new > old for new, old in zip(times, self.times, strict=True)):
            synonyms, mapping, stop = self.paths
            self.held, self.times = load(self.spark, synonyms, mapping, self.held, stop), times
        return self.held
