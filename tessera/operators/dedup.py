"""Exact duplicates by content hash, and the hash register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(docs: DataFrame, double: bool = False) -> DataFrame:
    """(doc_id, text) with ``hash``: SHA-256 of the text, or of that hash's hex digits."""
    h = F.sha2("text", 256)
    return docs.withColumn("hash", F.sha2(h, 256) if double else h)


def keep_first(docs: DataFrame) -> DataFrame:
    """(doc_id, hash) of the smallest document of each text, with the number of its copies. Null texts are one group."""
    return hashed(docs).groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def unseen(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``new`` whose hash isn't known, the smallest document of each."""
    return new.join(known.select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


def seen(new: DataFrame, known: DataFrame) -> DataFrame:
    return new.join(known.select("hash").distinct(), "hash", "left_semi")


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """The register (hash, doc_id) with the hashes that it didn't hold."""
    return known.select("hash", "doc_id").unionByName(unseen(new, known).select("hash", "doc_id"))


def forget(known: DataFrame, documents: DataFrame) -> DataFrame:
    return known.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def latest(known: DataFrame, most: int = 10_000) -> DataFrame:
    """The newest entries, what a cache is warmed with."""
    return known.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(most)
