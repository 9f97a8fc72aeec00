"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Points enter the graph in batches: a beam search from the medoid proposes neighbours, and robust pruning keeps the
nearest and drops what a kept one is closer to than the point is (relaxed by alpha), so edges stay diverse; reverse
edges are pruned likewise. Shards are bounded groups of rows by hash, and each graph is one row of the index.

Every query is searched in every shard, but no shard is sent anywhere for it: a block of queries of bounded size is
broadcast, a task takes the shards of its part of the index one after another and keeps the best of all of them for
each query, so what is shuffled is a few rows a query and task. More queries than a block holds take further passes
over the index, each written before the next. Equal vectors are one node: of equal scores the smaller id wins, so of
each vector only the few smallest ids can be in a result, and these are carried by the node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, table, written

DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Points of a shard, at about, and components of all queries of a block, which is broadcast.
SHARD_POINTS, BLOCK_VALUES = 4096, 1 << 22
#: Beam of a query, and how many of its points are scored exactly.
SEARCH_BEAM, RESCORED = 256, 24
_BATCH, _WIDTH = 256, 4
_SEED = 5


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1 where there are fewer) and inner products, best first, of each query's beam. All vectors have length 1."""
    n, b = len(points), len(queries)
    beam = min(beam, n)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    seen[:, [entry, n]] = True
    ids = np.full((b, beam), n)
    score = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], score[:, 0], open_[:, 0] = entry, queries @ points[entry], True
    padded = np.vstack([edges, np.full((1, edges.shape[1]), n, edges.dtype)])
    width = min(_WIDTH, beam)
    while open_.any():
        key = np.where(open_, score, -np.inf)
        pick = np.argpartition(-key, width - 1, axis=1)[:, :width]
        alive = np.take_along_axis(open_, pick, 1)
        np.put_along_axis(open_, pick, False, 1)
        near = padded[np.where(alive, np.take_along_axis(ids, pick, 1), n)].reshape(b, -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows, near]] = n
        seen[rows, near] = True
        new = np.einsum("bkd,bd->bk", points[np.minimum(near, n - 1)], queries)
        new[near == n] = -np.inf
        ids, score = np.hstack([ids, near]), np.hstack([score, new])
        open_ = np.hstack([open_, near < n])
        best = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        ids, score, open_ = (np.take_along_axis(x, best, 1) for x in (ids, score, open_))
    return np.where(np.isinf(score), -1, ids), score


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (-1: none), nearest first, each farther from those kept than from its point."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == of[:, None]] = -1
    vectors = points[np.maximum(candidates, 0)]
    distance = 2 - 2 * np.einsum("bkd,bd->bk", vectors, points[of])
    distance[candidates < 0] = np.inf
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    alive = np.isfinite(distance)
    kept = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        kept[some, k] = candidates[rows, first][some]
        between = 2 - 2 * np.einsum("bkd,bd->bk", vectors, vectors[rows, first])
        alive &= alpha * alpha * between > distance  # squared distances
        alive[rows, first] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = _SEED) -> tuple[np.ndarray, int]:
    """Graph (n x degree, n where there is no edge) and entry of unit vectors."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    edges = np.full((n, degree), n, np.int32)
    first = min(degree // 2, max(n - 1, 0))
    if first:
        edges[:, :first] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, first))) % n
    order = rng.permutation(n)
    for lo in range(0, n, _BATCH):
        of = order[lo : lo + _BATCH]
        found, _ = beam_search(points, edges, entry, points[of], beam)
        own = edges[of]
        kept = robust_prune(points, of, np.hstack([found, np.where(own == n, -1, own)]), degree, alpha)
        edges[of] = np.where(kept < 0, n, kept)
        source, target = np.repeat(of, degree)[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        into, at, count = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, int(count.max()) if len(count) else 0, degree):
            some = count > part
            held, spot = into[some], at[some] + part
            take = np.arange(degree)[None, :]
            fresh = np.where(take < (count[some] - part)[:, None], source[np.minimum(spot[:, None] + take, len(source) - 1)], -1)
            own = edges[held]
            pruned = robust_prune(points, held, np.hstack([np.where(own == n, -1, own), fresh]), degree, alpha)
            edges[held] = np.where(pruned < 0, n, pruned)
    return edges, entry


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([x.flatten() for x in flat.chunks])
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_INDEX = "shard long, dim int, ids binary, points binary, edges binary, entry int"
NEAREST = 5
KEPT_IDS = NEAREST + 1


def _index(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lead")
    points = _matrix(rows.column("v"))
    edges, entry = build(_unit(points))
    ids = np.full((len(points), KEPT_IDS), -1, np.int64)
    count = np.zeros(len(points), np.int64)
    for i, own in enumerate(rows.column("ids").to_pylist()):
        ids[i, : len(own)], count[i] = own, len(own)
    first = {k: rows.column(k)[0].as_py() for k in ("shard", "dim")}
    return pa.table({
        "shard": pa.array([first["shard"]], pa.int64()), "dim": pa.array([first["dim"]], pa.int32()), "ids": pa.array([count.tobytes() + ids.tobytes()], pa.binary()),
        "points": pa.array([points.tobytes()], pa.binary()), "edges": pa.array([edges.tobytes()], pa.binary()), "entry": pa.array([entry], pa.int32()),
    })


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added up component by component."""
    return np.ascontiguousarray(np.moveaxis(a * b, -1, 0)).sum(axis=0)


def _searched(shard: dict, own: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (-inf and -1 where there are none) of the NEAREST rows of a shard for queries with ids ``own``."""
    points = np.frombuffer(shard["points"], np.float64).reshape(-1, shard["dim"])
    edges = np.frombuffer(shard["edges"], np.int32).reshape(len(points), -1)
    raw = np.frombuffer(shard["ids"], np.int64)
    count, ids = raw[: len(points)], raw[len(points) :].reshape(len(points), KEPT_IDS)
    ids = np.where(np.arange(KEPT_IDS) < count[:, None], ids, -1)
    absent = np.arange(KEPT_IDS) >= count[:, None]
    unit, norm = _unit(points), np.sqrt(_dot(points, points))
    scores, found = np.full((len(own), NEAREST), -np.inf), np.full((len(own), NEAREST), -1)
    for lo in range(0, len(own), _BATCH):
        q, me = vectors[lo : lo + _BATCH], own[lo : lo + _BATCH]
        near, _ = beam_search(unit, edges, shard["entry"], _unit(q), SEARCH_BEAM)
        near = near[:, :RESCORED]
        score = _dot(points[np.maximum(near, 0)], q[:, None, :]) / (norm[np.maximum(near, 0)] * np.sqrt(_dot(q, q))[:, None])
        all_ = ids[np.maximum(near, 0)]
        all_scores = np.where((near < 0)[:, :, None] | absent[np.maximum(near, 0)] | (all_ == me[:, None, None]), -np.inf, score[:, :, None])
        scores[lo : lo + _BATCH], found[lo : lo + _BATCH] = _best(all_scores.reshape(len(q), -1), all_.reshape(len(q), -1))
    return scores, found


def _best(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The NEAREST of each row, ties by the smaller id."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :NEAREST]
    scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
    more = NEAREST - scores.shape[1]
    return (np.pad(scores, ((0, 0), (0, more)), constant_values=-np.inf), np.pad(ids, ((0, 0), (0, more)), constant_values=-1)) if more > 0 else (scores, ids)


def _block(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a block's queries, by number of components."""
    out = {}
    for dim in rows.column("dim").unique().to_pylist():
        own = rows.filter(pc.equal(rows.column("dim"), dim))
        out[dim] = own.column("vec_id").to_numpy(), _matrix(own.column("v"))
    return out


def _asked(index: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The best of each part of the index for the queries of a block: (query_id, vec_id, score)."""
    held = index.sparkSession.sparkContext.broadcast(block)  # of BLOCK_VALUES components at about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                shard = {n: b.column(n)[i].as_py() for n in ("dim", "ids", "points", "edges", "entry")}
                if shard["dim"] in held.value:
                    new, was = _searched(shard, *held.value[shard["dim"]]), best.get(shard["dim"])
                    best[shard["dim"]] = _best(np.hstack([was[0], new[0]]), np.hstack([was[1], new[1]])) if was else new
        for dim, (scores, ids) in best.items():
            there = scores > -np.inf
            cols = [np.repeat(held.value[dim][0], there.sum(axis=1)), ids[there], scores[there]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def usable(v: Column) -> Column:
    """Vectors that take part: with components, none null, not a number or infinite, and not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(vec_id long, embedding) to each query's NEAREST rows by cosine: (query_id, rank, vec_id, score).

    Queries are the rows for which ``is_query`` holds, candidates all rows but those with the query's id. Vectors of
    another number of components are no candidates. Rows that aren't usable or have no id take no part; a query that
    repeats an id counts once, with its smallest vector. A table without usable rows gives no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= KEPT_IDS)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.select("v", "ids", F.element_at("ids", 1).alias("lead"), F.size("v").alias("dim")), "nodes")
    queries = written(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    shards = max(1, -(-nodes.count() // SHARD_POINTS))
    blocks = max(1, -(-(queries.agg(F.sum(F.size("v"))).first()[0] or 0) // block_values))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("lead"), F.lit(shards)))
    index = written(dealt.groupBy("shard", "dim").applyInArrow(_index, _INDEX), "index", 8)
    packed = queries.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    found = [written(_asked(index, _block(packed.where(F.col("block") == k).toArrow())), "found", 8) for k in range(blocks)]
    dropped(nodes, queries, index)
    found = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir):
    """The nearest rows of ``embeddings`` to every row whose vec_id is divisible by 50; see :func:`nearest`."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.v, q.v) / (e.n * q.n) AS score FROM n q JOIN n e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
