"""Sentence vectors by a pluggable embedder, in Arrow batches, and the table they are kept in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunk import hashed_embedder

Embedder = Callable[[str], np.ndarray]


def embed(rows: DataFrame, key: str, text: str = "text", embedder: Embedder = hashed_embedder, out: str = "vector") -> DataFrame:
    """(key, text) to (key, vector): unit vectors; null for null and blank texts and those without any feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(text).to_pylist():
                v = np.asarray(embedder(t), np.float32) if t and t.strip() else None
                n = float(np.linalg.norm(v)) if v is not None else 0.0
                found.append((v / n).tolist() if n else None)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, pa.list_(pa.float32()))], [key, out])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out} array<float>")


def store(chunks: DataFrame, path: str, key: str = "chunk_id", embedder: Embedder = hashed_embedder, mode: str = "append", dim: int | None = None, at: Column | None = None) -> DataFrame:
    """Embed chunks and write them with their other columns and the time ``at`` (now, if not given); returns the table as
    it then is. The table is made if there is none. A vector of another number of components than ``dim`` is an error."""
    whole = chunks.join(embed(chunks.dropDuplicates([key]), key, embedder=embedder), key)
    if dim is not None:
        other = F.concat(F.lit(f"not {dim} components: "), F.size("vector").cast("string"))
        whole = whole.withColumn("vector", F.when(F.col("vector").isNull() | (F.size("vector") == dim), F.col("vector")).otherwise(F.raise_error(other).cast("array<float>")))
    whole.withColumn("stored_at", F.current_timestamp() if at is None else at).write.mode(mode).parquet(path)
    return chunks.sparkSession.read.parquet(path)
