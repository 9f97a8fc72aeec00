"""Uploads and ingestion as batch jobs: files in, parsed documents in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk, dedup, embed
from tessera.operators.meta import UNCATEGORISED, Failure
from tessera.sources.readers import format_of


def upload(files: DataFrame, known: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """Files (file_name, content, category) to (file_name, format, category, hash, path, status, code).

    The bytes' hash comes first: a file whose bytes are known (hash), or that an earlier one by name has, is rejected, as
    is one of an unknown format; ``code`` says why. Others are to be stored at ``path``, the month of ``at`` (now, if not
    given) and a name of their own, and are processing. An empty or null file is invalid.
    """
    rows = files.select("file_name", "category", format_of("file_name").alias("format"), F.sha2("content", 256).alias("hash"), (F.coalesce(F.length("content"), F.lit(0)) == 0).alias("empty"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("hash").orderBy("file_name")) == 1)
    held = known.select("hash").distinct().withColumn("held", F.lit(True)) if known is not None else None
    rows = rows.join(held, "hash", "left") if held is not None else rows.withColumn("held", F.lit(None).cast("boolean"))
    code = F.when(F.col("empty"), Failure.CODES["INVALID"]).when(F.col("held") | ~F.col("first"), Failure.CODES["FILE_CONTENT_EXIST"]).when(F.col("format") == "UNKNOWN", Failure.CODES["UNSUPPORTED_FILE_TYPE"])
    month = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM")
    path = F.concat(month, F.lit("/"), T.unique_filename(T.sanitize_filename("file_name"), F.col("hash")))
    named = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(UNCATEGORISED))
    rows = rows.withColumn("code", code)
    return rows.select("file_name", "format", named.alias("category"), "hash", F.when(F.col("code").isNull(), path).alias("path"), F.when(F.col("code").isNull(), "processing").otherwise("rejected").alias("status"), "code")


def ingest(parsed: DataFrame, known: DataFrame | None = None, embedder: embed.Embedder = chunk.hashed_embedder, **options) -> dict[str, DataFrame]:
    """Parsed files (doc_id, file_name, format, text, error, category) to documents, chunks, terms, vectors and hashes.

    A text that is known, or that an earlier document of the batch has, is a duplicate and isn't indexed; one that
    couldn't be parsed or cut failed, with the reason. Every document has a row with its status.
    """
    rows = parsed.withColumn("hash", F.sha2("text", 256))
    good = rows.where(F.col("error").isNull() & (F.trim("text") != ""))
    fresh = dedup.unseen(good, known) if known is not None else good.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    taken = good.join(fresh.select("doc_id"), "doc_id", "left_semi")
    cut, failed = chunk.routed(taken.drop("category"), **options)
    chunks = cut.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    documents = rows.join(fresh.select("doc_id", F.lit(True).alias("fresh")), "doc_id", "left").join(failed.select("doc_id", F.col("error").alias("why")), "doc_id", "left")
    bad = F.col("error").isNotNull() | F.col("why").isNotNull() | (F.coalesce(F.trim("text"), F.lit("")) == "")
    status = F.when(bad, "failed").when(F.coalesce("fresh", F.lit(False)), "active").otherwise("duplicate")
    named = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(UNCATEGORISED))
    documents = documents.select("doc_id", T.sanitize_filename("file_name").alias("file_name"), "format", named.alias("category"), status.alias("status"), F.coalesce("error", "why").alias("error_message"), "hash")
    vectors = embed.embed(chunks, "chunk_id", embedder=embedder).join(chunks.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    terms = chunks.select(F.col("chunk_id").alias("id"), F.explode(T.analyze(F.col("text"))).alias("term"))
    hashes = fresh.join(failed.select("doc_id"), "doc_id", "left_anti").select("hash", "doc_id")
    return {"documents": documents, "chunks": chunks, "hashes": hashes, "terms": terms, "vectors": vectors}
