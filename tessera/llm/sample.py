"""A bounded, reproducible sample of labelled texts, and how sure of a class the labels make one beforehand."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[Column], Column], rows: int, most_bytes: int, unlabelled: int = 0) -> tuple[pa.Array, np.ndarray, float]:
    """Texts and labels (0 or 1) of at most ``rows`` rows a class and ``most_bytes`` bytes in all, and the share of 1;
    with them ``unlabelled`` documents at most without a label, marked -1.

    Of the ids that ``learn`` admits, those of smallest md5 are taken from each class and only they are sent to the
    documents, so a join never moves the corpus. Null labels and ids are left out; of several labels of one id the
    smallest counts, of several texts too; a null text is empty. Without any rows the share is 0.5.
    """
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(learn(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = known.withColumn("k", order)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # by the counts, all but surely the first rows in the order of k are below this; only they are ranked in one place
    below = F.lit(1.0)
    for y, count in counts.items():
        below = F.when(F.col("y") == y, min(1.0, (1.5 * rows + 200) / count)).otherwise(below)
    first = known.where(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / 2**32 < below)
    place = F.row_number().over(Window.partitionBy("y").orderBy("k", "doc_id"))
    picked = first.withColumn("place", place).where(F.col("place") <= rows).select("doc_id", "y", "place")
    if unlabelled:
        rest = max(1, docs.count() - sum(counts.values()))
        ids = docs.where(F.col("doc_id").isNotNull() & learn(F.col("doc_id"))).select("doc_id", order.alias("k"))
        ids = ids.where(F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / 2**32 < (4 * unlabelled + 800) / rest).distinct()
        spare = ids.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("k").limit(unlabelled)
        spare = spare.withColumn("place", F.row_number().over(Window.orderBy("k", "doc_id"))).select("doc_id", F.lit(-1).alias("y"), "place")
        picked = picked.unionByName(spare)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "y", "place").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("place", "y", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = texts.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("text", "y").toArrow()
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    text = taken.column("text").combine_chunks()
    return text if isinstance(text, pa.Array) else text.chunk(0), taken.column("y").to_numpy().astype(np.float64), share


def log_odds(share: float) -> float:
    share = min(max(share, 0.001), 0.999)
    return float(np.log(share / (1 - share)))
