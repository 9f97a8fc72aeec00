"""Rank fusion, hybrid search and the retrieval cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.functions import text as T
from tessera.operators import bm25, knn
from tessera.sources.shared import stored

#: Hits that are broadcast to the texts.
BROADCAST_HITS = 100_000


def reciprocal_ranks(legs: list[DataFrame], k: int | None, rrf_k: int = S.RRF_K) -> DataFrame:
    """Legs (qid, id, rank), the first counting first in ties, to (qid, id, score, rank). One sum over a union: no outer
    join."""
    rows = reduce(DataFrame.unionByName, [leg.select("qid", "id", S.reciprocal_rank(F.col("rank"), rrf_k).alias("s"), F.lit(i).alias("leg")) for i, leg in enumerate(legs)])
    fused = rows.groupBy("qid", "id").agg(F.sum("s").alias("score"), F.min("leg").alias("leg"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "leg", "id"))).drop("leg")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def hybrid(index: bm25.Index | None, vectors: DataFrame, queries: DataFrame, k: int, rrf_k: int = S.RRF_K, leg_k: int | None = None, digits: int | None = None) -> DataFrame:
    """Queries (qid, query, vector) by both legs, fused; by vectors alone without an index."""
    near = knn.search(vectors, queries.select("qid", "vector"), leg_k or k, digits=digits)
    if index is None:
        return near.select("qid", "id", F.col("cosine").alias("score"), "rank")
    words = bm25.search(index, queries.select("qid", "query"), leg_k or k, digits=digits)
    return reciprocal_ranks([near, words], k, rrf_k)


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (id, ...) with the other columns of chunks (id, ...). Hits are written, since they are what all legs end in; a
    bounded number of them goes to where the texts are, which aren't shuffled then."""
    hits = stored(hits, "hits")
    few = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    return (F.broadcast(hits) if few else hits).join(chunks, "id")


def first_by_text(stages: DataFrame) -> DataFrame:
    """Rows (qid, stage, pos, text, ...) without those whose text stands earlier for the same query."""
    turn = F.row_number().over(Window.partitionBy("qid", F.sha2("text", 256)).orderBy("stage", "pos"))
    return stages.withColumn("_turn", turn).where(F.col("_turn") == 1).drop("_turn")


def without_excluded(rows: DataFrame, excluded: Column) -> DataFrame:
    """Rows whose text holds none of an array of words, as they are written."""
    return rows.where(~F.coalesce(F.exists(excluded, lambda w: F.contains(F.col("text"), w)), F.lit(False)))


def cascade(hits: DataFrame, expansions: DataFrame, by_file: DataFrame, chunks: DataFrame, excluded: DataFrame, limit: int | None = None) -> DataFrame:
    """The stages of retrieval: hybrid hits, then hits of expansion words, then hits within a named file.

    Each of the first three is (qid, id, rank), the second with the number of its word as ``word``, and may have a
    ``score``, which is kept; ``chunks`` is (id, text), ``excluded`` (qid, words). A text counts once a query, at its
    first place; texts with an excluded word go.
    """

    def stage(rows: DataFrame, n: int, word: Column) -> DataFrame:
        pos = F.struct(word.cast("long").alias("word"), F.col("rank").cast("long").alias("rank"))
        score = F.col("score").cast("double") if "score" in rows.columns else F.lit(None).cast("double")
        return rows.select("qid", "id", F.lit(n).alias("stage"), pos.alias("pos"), score.alias("score"))

    stages = [stage(hits, 1, F.lit(0)), stage(expansions, 2, F.col("word")), stage(by_file, 3, F.lit(0))]
    rows = with_texts(reduce(DataFrame.unionByName, stages), chunks.select("id", "text"))
    rows = first_by_text(rows).join(excluded, "qid", "left")
    rows = without_excluded(rows, F.col("words")).drop("words")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("stage", "pos")))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def by_source(vectors: DataFrame, queries: DataFrame, names: DataFrame, k: int = 20) -> DataFrame:
    """Nearest rows among those whose source holds the file name asked for (qid, name); for a query without any, again
    without the extension."""
    columns = ["qid", "vector", "name"]
    exact = knn.search(vectors, queries.select("qid", "vector").join(names, "qid").select(columns), k)
    rest = names.join(exact.select("qid").distinct(), "qid", "left_anti").withColumn("name", T.remove_extension("name"))
    return exact.unionByName(knn.search(vectors, queries.select("qid", "vector").join(rest, "qid").select(columns), k))


def context(rows: DataFrame, file: str | None = None) -> DataFrame:
    """Ranked rows (qid, rank, text) to one numbered block of text a query."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    block = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("【片段"), (i + 1).cast("string"), F.lit("】\n"), p["text"], F.lit("\n\n"))), "")
    head = F.lit(f"以下内容来自文件: {file}\n\n" if file else "")
    return rows.groupBy("qid").agg(F.concat(head, block).alias("context"))
