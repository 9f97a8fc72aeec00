"""Exact nearest neighbours for batches of queries.

Queries are taken in blocks of bounded size, each broadcast for one pass over the vectors; of several blocks one is held
at a time, and what a pass finds is written before the next. A task scores its Arrow
batches against the block by one matrix product each and keeps the k best of all of them for every query, so what is
shuffled is k rows a query and task; a window picks the k best of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import gone, shared_folder, stored

#: Components of the vectors of a block's queries, and cells of the matrix of scores, at about.
BLOCK_VALUES, CELLS = 1 << 22, 1 << 22


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _usable(column: pa.Array) -> np.ndarray:
    """Which lists hold numbers only."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = length > 0
    if column.flatten().null_count:
        rows = np.repeat(np.arange(len(column)), length)
        out[rows[pc.is_null(column.flatten()).to_numpy(zero_copy_only=False)]] = False
    return out


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


class _Block:
    """Queries of one number of components."""

    def __init__(self, rows: pa.Table, dim: int):
        self.vectors = _matrix(rows.column("vector").combine_chunks(), dim)
        self.lengths = _lengths(self.vectors)
        self.ids = rows.column("qid").combine_chunks()
        self.names = rows.column("name").to_pylist() if "name" in rows.column_names else None


def _held(part: pa.Table) -> dict[int, _Block]:
    """Queries by their number of components."""
    usable = pa.array(_usable(part.column("vector").combine_chunks()), pa.bool_())
    own = {d: part.filter(pc.and_(pc.equal(part.column("dim"), d), usable)) for d in part.column("dim").unique().to_pylist()}
    return {d: _Block(rows, d) for d, rows in own.items() if len(rows)}


def best_of(ids: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest, ties by id; what is -inf or has the id -1 at the end is none."""
    if cosine.shape[1] > 4 * k:  # the k-th largest is a bound, kept with all that tie with it
        bound = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        most = max(k, int((cosine >= bound).sum(axis=1).max()))
        first = np.argpartition(-cosine, most - 1, axis=1)[:, :most] if most < cosine.shape[1] else np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
        ids, cosine = np.take_along_axis(ids, first, 1), np.take_along_axis(cosine, first, 1)
    order = np.lexsort((ids, -cosine), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(cosine, order, 1)


def search(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, digits: int | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(id long, vector, ...) and (qid, vector) to (qid, id, cosine, score, rank): the k rows of largest cosine of those
    ``where`` admits, ties by id; score is (1 + cosine) / 2. Zero vectors have cosine 0; null ones take no part.
    If queries have a ``name``, only rows whose ``source`` holds it count for them. ``digits`` rounds cosines before they
    are ranked."""
    named = "name" in queries.columns
    rows = (vectors if where is None else vectors.where(where)).where(F.col("id").isNotNull()).select(F.col("id").cast("long"), "vector", *["source"] * named)
    asked = queries.where(F.col("qid").isNotNull() & (F.size("vector") > 0)).select("qid", "vector", F.size("vector").alias("dim"), *["name"] * named)
    asked = asked.where(F.col("name").isNotNull()) if named else asked
    kind = queries.schema["qid"].dataType.simpleString()
    found = f"qid {kind}, id long, cosine double"
    broadcast = queries.sparkSession.sparkContext.broadcast
    blocks = max(1, -(-(asked.agg(F.sum("dim")).first()[0] or 0) // block_values))
    if blocks == 1:
        held = _held(asked.toArrow())
        out = rows.mapInArrow(_pass(broadcast(held), k, digits), found) if held else queries.sparkSession.createDataFrame([], found)
    else:  # one block at a time with the driver and the workers
        folder = shared_folder(queries.sparkSession, "knn")
        dealt = asked.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))  # of one size, whatever the ids
        dealt = stored(dealt.repartition("block"), "queries", by=("block",))
        for block in range(blocks):
            if held := _held(dealt.where(F.col("block") == block).drop("block").toArrow()):
                here = broadcast(held)
                rows.mapInArrow(_pass(here, k, digits), found).write.mode("append").parquet(folder)
                here.destroy()
        gone(dealt)
        out = queries.sparkSession.read.schema(found).parquet(folder)
    if digits is not None:
        out = out.withColumn("cosine", F.round("cosine", digits))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")))
    return ranked.where(F.col("rank") <= k).select("qid", "id", "cosine", ((1 + F.col("cosine")) / 2).alias("score"), "rank")


def _pass(held, k: int, digits: int | None):
    """What a task does with its vectors for the broadcast blocks ``held``, by number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            vector = b.column("vector")
            length = np.where(_usable(vector), pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False), 0)
            for dim, block in held.value.items():
                own = np.flatnonzero(length == dim)
                step = max(1, CELLS // len(block.vectors))
                for part in (own[lo : lo + step] for lo in range(0, len(own), step)):
                    m = _matrix(vector.take(pa.array(part)), dim)
                    both = block.lengths[:, None] * _lengths(m)[None, :]
                    cosine = np.divide(block.vectors @ m.T, both, out=np.zeros(both.shape), where=both > 0)
                    cosine = cosine if digits is None else np.round(cosine, digits)
                    if block.names:
                        source = pc.fill_null(b.column("source").take(pa.array(part)), "")
                        places = {n: pc.match_substring(source, n).to_numpy(zero_copy_only=False) for n in set(block.names)}
                        cosine[~np.stack([places[n] for n in block.names])] = -np.inf
                    ids = np.broadcast_to(b.column("id").take(pa.array(part)).to_numpy(zero_copy_only=False), cosine.shape)
                    was = best.get(dim)
                    best[dim] = best_of(np.hstack([was[0], ids]) if was else ids, np.hstack([was[1], cosine]) if was else cosine, k)
        for dim, (ids, cosine) in best.items():
            some = cosine > -np.inf
            qid = held.value[dim].ids.take(pa.array(np.repeat(np.arange(len(some)), some.sum(axis=1))))
            yield pa.RecordBatch.from_arrays([qid, pa.array(ids[some]), pa.array(cosine[some])], ["qid", "id", "cosine"])

    return run
