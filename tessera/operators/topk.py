"""The k best documents by BM25 without scoring every posting.

An index of blocks holds a row for each term and block of documents: how many postings, the largest part of a score that
one of them can bring, and the postings themselves. A search gathers its terms' rows by block, once, and then works within
blocks, with its terms broadcast:

1. the sum of a block's maxima over a query's terms bounds the score of all its documents;
2. the few blocks of the highest bound are scored whole, and the k-th best score in them is a floor that the answer's
   k-th can't be below;
3. blocks whose bound is below the floor are out. Of a query's terms, those of a block's smallest maxima that together
   stay below the floor can't make a document reach it, so only the other terms' postings are scored at first;
4. these sums may raise a task's floor; a document whose sum, with the block's maxima of the terms left aside, is below it
   is out too, and the postings left aside are scored in the blocks of the others only.

Nothing is approximate: the rows are those of :func:`tessera.operators.bm25.search`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import score as S
from tessera.functions import text as T
from tessera.operators import bm25
from tessera.sources.shared import gone, stored

#: Documents of a block; blocks scored whole for the floor; what rounding may hide.
BLOCK, PILOTS, SLACK = 16, 12, 1e-9
#: Folders that terms are dealt over, of which a search opens those of its terms.
SHELVES = 64
#: Characters of text that a task cuts into postings and sorts, at most about; with fewer cores busy, at least.
MOST_TEXT, LEAST_TEXT = 16_000_000, 1_000_000


def shelf(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHELVES)).cast("int")


@dataclass
class BlockIndex:
    """``blocks`` is a written table (term, block, n, most, ids, tf, dl, shelf) in a folder a shelf, so that a search of few
    terms reads few files; ``n`` documents of ``mean`` length."""

    blocks: DataFrame
    n: int
    mean: float

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> BlockIndex:
        """Of documents with an id and a text that isn't blank. A block's documents are those of one hash of the id, so
        neither a popular source nor a run of long texts gathers in one. Texts are dealt by block before they are cut, so
        postings stay where they are."""
        texts = bm25._texts(docs, id_col, text_col)
        held = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(T.utf16_length(F.col("text"))), F.lit(1.0)).alias("mean")).first()
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-held["n"] // size))))
        share = S.term_score(F.col("tf"), F.col("dl"), F.lit(held["mean"]), F.lit(1), F.lit(1), F.lit(1)) / S.idf(F.lit(1), F.lit(1))
        measured = texts.withColumn("block", block).repartition(_tasks(docs.sparkSession, held["n"] * held["mean"]), "block").select("block", "id", T.utf16_length("text").alias("dl"), T.analyze("text").alias("terms"))
        each = measured.select("block", "id", "dl", F.explode("terms").alias("term")).groupBy("block", "id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").cast("int").alias("dl"))
        posts = F.collect_list(F.struct("id", "tf", "dl")).alias("posts")
        per = each.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(share).alias("most"), posts)
        per = per.select("term", "block", "n", "most", F.col("posts.id").alias("ids"), F.col("posts.tf").alias("tf"), F.col("posts.dl").alias("dl"), shelf(F.col("term")).alias("shelf"))
        return cls(stored(per.sortWithinPartitions("shelf", "term", "block"), "bm25-blocks", by=("shelf",)), held["n"], held["mean"])

    def release(self) -> None:
        gone(self.blocks)


def _tasks(spark, chars: float) -> int:
    """A task's postings are to fit its memory, however large the table, so that sorting them spills nothing."""
    return max(1, -int(-chars // MOST_TEXT), min(spark.sparkContext.defaultParallelism, -int(-chars // LEAST_TEXT)))


@dataclass
class Found:
    """``rows`` (qid, id, score, rank), and how many postings were scored (``read``) of how many that the queries' terms have
    (qid, stage, postings), the stage ``all`` being the latter."""

    rows: DataFrame
    read: DataFrame


def search(index: BlockIndex, queries: DataFrame, k: int = 10, digits: int | None = None, pilots: int = PILOTS) -> Found:
    """(qid, query) to the k best of each query, ties by id; queries without qid have no rows. ``digits`` rounds scores
    before they are ranked. Queries of more than BROADCAST_TERMS terms in all are searched some at a time."""
    asked = queries.where(F.col("qid").isNotNull()).select("qid", F.explode(T.analyze(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = stored(asked, "asked")
    parts = max(1, -(-asked.count() // bm25.BROADCAST_TERMS))
    of = F.pmod(F.xxhash64("qid"), F.lit(parts))
    found = [_searched(index, asked.where(of == p), k, digits, pilots) for p in range(parts)]
    gone(asked)
    return Found(*(reduce(DataFrame.unionByName, (getattr(f, name) for f in found)) for name in ("rows", "read")))


def _searched(index: BlockIndex, asked: DataFrame, k: int, digits: int | None, pilots: int) -> Found:
    spark, slack = asked.sparkSession, SLACK + (10.0**-digits if digits is not None else 0.0)
    qid, kind = asked.schema["qid"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()
    rows = asked.toArrow()
    if not len(rows):
        return Found(spark.createDataFrame([], f"qid {qid}, id {kind}, score double, rank int"), spark.createDataFrame([], f"qid {qid}, stage string, postings long"))
    words = pc.unique(rows.column("term").combine_chunks())
    rows = rows.append_column("t", pc.index_in(rows.column("term"), value_set=words)).sort_by("t")
    names = rows.column("qid").combine_chunks().dictionary_encode()
    q, t = names.indices.to_numpy().astype(np.int64), rows.column("t").to_numpy().astype(np.int64)
    numbers = spark.createDataFrame(pa.table({"term": words, "t": pa.array(np.arange(len(words)), pa.int32())}))
    shelves = [r.shelf for r in numbers.select(shelf(F.col("term")).alias("shelf")).distinct().collect()]  # SHELVES at most
    mine = index.blocks.where(F.col("shelf").isin(shelves)).join(F.broadcast(numbers), "term")
    heads = mine.select("block", F.struct("t", F.col("n").cast("int").alias("n"), "most", "ids", "tf", "dl").alias("r")).repartition("block")
    held = stored(heads.groupBy("block").agg(F.collect_list("r").alias("r")), "batch")  # a row a block
    head = held.select("block", F.col("r.t").alias("t"), F.col("r.n").alias("n"), F.col("r.most").alias("most"))
    whole = held.select("block", *(F.col(f"r.{c}").alias(c) for c in ("t", "n", "most", "ids", "tf", "dl")))
    df, idf = np.zeros(len(words), np.int64), np.zeros(len(words))
    counts = head.select(F.explode(F.arrays_zip("t", "n")).alias("h")).groupBy(F.col("h.t").alias("t")).agg(F.sum("h.n").alias("df"))
    for r in counts.select("t", "df", S.idf(F.lit(index.n), F.col("df")).alias("idf")).collect():  # not more than the batch's terms
        df[r.t], idf[r.t] = r.df, r.idf
    batch = _Batch(q, rows.column("qtf").to_numpy() * idf[t], np.searchsorted(t, np.arange(len(words) + 1)), len(names.dictionary), index.mean)
    send = spark.sparkContext.broadcast

    best = head.mapInArrow(_bounds(send(batch), pilots), "q int, block long, bound double")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))).where(F.col("place") <= pilots)
    first = best.select("q", "block").toArrow()  # some blocks a query
    those = spark.createDataFrame(pa.table({"block": pc.unique(first.column("block"))}))
    first = _pair(first.column("q").to_numpy().astype(np.int64), first.column("block").to_numpy())
    shape = f"q int, id {kind}, score double, stage string, postings long"
    none = np.zeros(batch.queries)
    known = stored(whole.join(F.broadcast(those), "block", "left_semi").mapInArrow(_rated(send((batch, first, none)), True, k, slack), shape), "known")
    top = known.where("stage IS NULL").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("place") <= k)
    floor = none.copy()
    for r in top.groupBy("q").agg(F.max("place").alias("n"), F.min("score").alias("low")).collect():  # a row a query
        floor[r.q] = max(0.0, r.low - slack) if r.n == k else 0.0
    more = stored(whole.mapInArrow(_rated(send((batch, first, floor)), False, k, slack), shape), "more")

    both = known.unionByName(more)
    ids = F.broadcast(spark.createDataFrame(pa.table({"q": pa.array(np.arange(batch.queries), pa.int32()), "qid": names.dictionary})))
    total = both.where("stage IS NULL").select("q", "id", "score")
    total = total.withColumn("score", F.round("score", digits)) if digits is not None else total
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    out = stored(ranked.join(ids, "q").select("qid", "id", "score", "rank"), "found")
    every = spark.createDataFrame(pa.table({"q": pa.array(np.arange(batch.queries), pa.int32()), "postings": np.bincount(q, df[t], batch.queries).astype(np.int64)}))
    read = both.where("stage IS NOT NULL").groupBy("q", "stage").agg(F.sum("postings").alias("postings"))
    read = every.where("postings > 0").select("q", F.lit("all").alias("stage"), "postings").unionByName(read)
    read = stored(read.join(ids, "q").select("qid", "stage", "postings"), "read")
    gone(held, known, more)
    return Found(out, read)


@dataclass
class _Batch:
    """Rows of a query's number and a term's weight in it, sorted by term, of which term t has those from ``first[t]`` on."""

    q: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    queries: int
    mean: float


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, n numbers."""
    ends = np.cumsum(n)
    return np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each in its group, of a sorted array of groups."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def _pair(q: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A query and a block in one number."""
    return (q << 40) + block


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _pieces(b: pa.RecordBatch, batch: _Batch) -> Iterator[tuple]:
    """Of some blocks at a time: their numbers, the range of their heads, and pairs of a head and a query that has its term:
    heads, rows of the batch, and each pair's bound."""
    block, t, n, most = b.column("block").to_numpy(), _flat(b.column("t")), _flat(b.column("n")), _flat(b.column("most"))
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(b.column("t")).to_numpy())))
    many = np.diff(batch.first)[t]
    pairs = np.concatenate(([0], np.cumsum(many * n.astype(np.int64))))[at]
    lo = 0
    while lo < len(block):
        hi = max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + bm25.PAIRS, "right")) - 1)
        heads = np.arange(at[lo], at[hi])
        h, own = np.repeat(heads, many[heads]), _spread(batch.first[t[heads]], many[heads])
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))[h - at[lo]]
        yield block[lo:hi], heads, h, own, row, batch.weight[own] * most[h]
        lo = hi


def _bounds(held, pilots: int):
    """Rows of blocks to the blocks of the highest bound of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = held.value
        for b in batches:
            for block, _, _, own, row, most in _pieces(b, batch):
                key, place = np.unique(batch.q[own] * len(block) + row, return_inverse=True)
                bound, q, at = np.bincount(place, most, len(key)), key // len(block), block[key % len(block)]
                order = np.lexsort((at, -bound, q))
                order = order[_places(q[order]) < pilots]
                yield pa.RecordBatch.from_arrays([pa.array(q[order], pa.int32()), pa.array(at[order]), pa.array(bound[order])], ["q", "block", "bound"])

    return run


def _rated(held, whole: bool, k: int, slack: float):
    """Rows of blocks to scores: of a query's first blocks all, or of its others those that may reach the floor; and how many
    postings it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, first, floor = held.value
        floor, took = floor.copy(), {"pilots" if whole else "main": np.zeros(batch.queries, np.int64), "aside": np.zeros(batch.queries, np.int64)}
        best = np.zeros(0, np.int64), np.zeros(0)  # queries and scores, the k best of each
        for b in batches:
            n, tf, dl, ids = _flat(b.column("n")), _flat(b.column("tf").flatten()), _flat(b.column("dl").flatten()), b.column("ids").flatten().flatten()
            posts = np.concatenate(([0], np.cumsum(n)))
            for block, heads, h, own, row, most in _pieces(b, batch):
                begin = posts[heads[0]] if len(heads) else 0
                names = ids.slice(begin, (posts[heads[-1] + 1] if len(heads) else 0) - begin).dictionary_encode()
                number, docs = names.indices.to_numpy(), len(names.dictionary)
                where = np.zeros(docs, np.int64)  # the block of each document

                def scores(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """Pairs' postings: query and document in one number, and what they bring."""
                    at, of = _spread(posts[h[some]], n[h[some]]), np.repeat(some, n[h[some]])
                    doc = number[at - begin]
                    where[doc] = row[of]
                    below = tf[at] + S.K1 * (1 - S.B + S.B * (dl[at] / batch.mean))
                    return batch.q[own[of]] * docs + doc, batch.weight[own[of]] * tf[at] * (S.K1 + 1) / below

                def counted(stage: str, some: np.ndarray) -> None:
                    took[stage] += np.bincount(batch.q[own[some]], n[h[some]], batch.queries).astype(np.int64)

                key, place = np.unique(batch.q[own] * len(block) + row, return_inverse=True)
                q = key // len(block)
                pilot = np.isin(_pair(q, block[key % len(block)]), first)
                live = pilot if whole else ~pilot & (np.bincount(place, most, len(key)) >= floor[q])
                some = np.flatnonzero(live[place])
                some = some[np.lexsort((most[some], place[some]))]
                if not len(some):
                    continue
                aside, left = np.zeros(len(some), bool), np.zeros(len(key))
                if not whole:  # the terms of the smallest maxima whose sum is below the floor
                    upto, begins = np.cumsum(most[some]), np.searchsorted(place[some], place[some])
                    aside = upto - (upto - most[some])[begins] < floor[q[place[some]]]
                    left = np.bincount(place[some], most[some] * aside, len(key))
                    aside &= (left < floor[q])[place[some]]  # whatever the running sum has rounded
                    left = np.bincount(place[some], most[some] * aside, len(key))
                counted("pilots" if whole else "main", some[~aside])
                found, value = scores(some[~aside])
                found, inverse = np.unique(found, return_inverse=True)
                if not len(found):
                    continue
                score, of = np.bincount(inverse, value, len(found)), found // docs
                if not whole:
                    asked, held_best = np.concatenate([best[0], of]), np.concatenate([best[1], score])
                    order = np.lexsort((-held_best, asked))
                    order = order[_places(asked[order]) == k - 1]  # parts of scores are below them
                    floor[asked[order]] = np.maximum(floor[asked[order]], held_best[order] - slack)
                    group = np.searchsorted(key, of * len(block) + where[found % docs])
                    keep = score + left[group] >= floor[of]
                    wanted = np.zeros(len(key), bool)
                    wanted[group[keep]] = True
                    again = some[aside]
                    again = again[wanted[place[again]]]
                    counted("aside", again)
                    also, value = scores(again)
                    at = np.minimum(np.searchsorted(found, also), len(found) - 1)
                    mine = found[at] == also
                    score = score + np.bincount(at[mine], value[mine], len(found))
                    keep &= score >= floor[of]
                    found, score, of = found[keep], score[keep], of[keep]
                    asked, held_best = np.concatenate([best[0], of]), np.concatenate([best[1], score])
                    order = np.lexsort((-held_best, asked))
                    order = order[_places(asked[order]) < k]
                    best = asked[order], held_best[order]
                yield _rows(of, names.dictionary.take(pa.array(found % docs)), score, None, [None] * len(found))
        for stage, n in took.items():
            some = np.flatnonzero(n)
            if len(some):
                yield _rows(some, pa.nulls(len(some), ids.type), pa.nulls(len(some), pa.float64()), stage, n[some])

    return run


def _rows(q: np.ndarray, ids: pa.Array, score, stage: str | None, postings) -> pa.RecordBatch:
    columns = [pa.array(q, pa.int32()), ids, pa.array(score), pa.array([stage] * len(q), pa.string()), pa.array(postings, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["q", "id", "score", "stage", "postings"])
