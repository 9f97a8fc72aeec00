"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's result to the shared
folder and reads it back as the next one's documents. All return the columns of ``documents``, the last also ``copy``.
Results are dealt over a few partitions a core, so that no stage leaves many small files to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, minhash, mixing, pii, quality
from tessera.llm.common import packed, release, ship, small_batches, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject: a score of 0.5 or more. Null and empty
    texts are judged as texts without features, repeated rows alike; other columns stay as they are."""
    ship(spark)
    small_batches(spark)
    model = quality.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    at = len(docs.columns)
    names = [f"c{i}" for i in range(at)]
    return packed(scored.toDF(*names, "score").where(F.col("score") >= 0.5).drop("score").toDF(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id. Documents without words are nobody's
    duplicates; rows without doc_id stay; of rows that share a doc_id one stays."""
    ship(spark)
    small_batches(spark)
    return packed(minhash.deduplicated(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked. Null and empty texts stay, and all do if there are no items."""
    ship(spark)
    small_batches(spark)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    return packed(decontaminate.without_leaks(docs, items))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind and n_chars counted anew. Null and empty texts
    stay as they are."""
    ship(spark)
    small_batches(spark)
    return packed(pii.redact(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each time that the mix takes a document, with ``copy`` from 1; the last document of a
    source's fractional repetition is cut. A null source is one source, the last. Documents without words, and those
    beyond their source's target, have no row."""
    return packed(mixing.mixed(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("mixing sources", source_mixing),
]

#: No SQL expresses a trained classifier; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
        release(spark)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
