"""Documents, categories and chunks as tables: lists, counts, upserts and cascading deletes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNCATEGORISED = "未分类"


class Failure(Exception):
    """An error with the code that an API would answer with."""

    # Codes by name.
    CODES = {
        "INVALID": 400,
        "NOT_FOUND": 404,
        "CATEGORY_EXISTS": 1001,
        "CATEGORY_NOT_EMPTY": 1002,
        "DOCUMENT_NOT_FOUND": 1003,
        "FILE_SAVE_ERROR": 1004,
        "UNSUPPORTED_FILE_TYPE": 1005,
        "VECTOR_DELETE_ERROR": 1006,
        "FILE_CONTENT_EXIST": 1007,
        "FILE_READ_ERROR": 1008,
        "DB_ERROR": 2001,
        "DATA_INTEGRITY_VIOLATION": 2002,
        "AI_SERVICE_ERROR": 3001,
        "EMBEDDING_ERROR": 3002,
        "CHAT_ERROR": 3003,
    }

    def __init__(self, name: str, message: str = ""):
        super().__init__(f"{name}: {message}")
        self.code = self.CODES[name]


@dataclass(frozen=True)
class Tables:
    """documents (document_id, file_name, category, status, upload_time), chunks (document_id, ...), hashes (hash,
    document_id), postings (document_id, ...), categories (name, ...), and vectors (document_id, ...) where there are."""

    documents: DataFrame
    chunks: DataFrame
    hashes: DataFrame
    postings: DataFrame
    categories: DataFrame
    vectors: DataFrame | None = None


def chunk_counts(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, newest first, with their number of chunks; times in milliseconds."""
    rows = documents.join(chunk_counts(chunks), "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    if "upload_time" in documents.columns:
        rows = rows.withColumn("uploaded_ms", F.unix_millis(F.col("upload_time").cast("timestamp"))).orderBy(F.desc("upload_time"), "document_id")
    return rows


def document_status(documents: DataFrame, chunks: DataFrame, ids: list[int]) -> DataFrame:
    return list_documents(documents.where(F.col("document_id").isin(ids)), chunks).select("document_id", "status", "chunks")


def by_category(documents: DataFrame, chunks: DataFrame, name: str, statuses: tuple[str, ...] = ("active", "processing")) -> DataFrame:
    return list_documents(documents.where((F.col("category") == name) & F.col("status").isin(*statuses)), chunks)


def category_counts(documents: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    return documents.where(F.col("status").isin(*statuses)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def document(documents: DataFrame, document_id: int) -> DataFrame:
    row = documents.where(F.col("document_id") == document_id)
    if row.isEmpty():
        raise Failure("DOCUMENT_NOT_FOUND", str(document_id))
    return row


def by_file_name(documents: DataFrame, name: str) -> DataFrame:
    return documents.where((F.col("status") == "active") & (F.col("file_name") == name)).orderBy("document_id")


def numbered(chunks: DataFrame, key: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """Chunks numbered from 0 within their document, and ids made of both."""
    rows = chunks.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    return rows.withColumn("chunk_id", F.concat_ws("_", F.col(key).cast("string"), F.col("number").cast("string")))


def delete_documents(tables: Tables, ids: DataFrame) -> Tables:
    """Without the documents (document_id) and all that hangs on them; categories left without documents go too."""
    gone = ids.select("document_id").distinct()
    left = tables.documents.join(gone, "document_id", "left_anti")
    emptied = tables.documents.join(gone, "document_id", "left_semi").select("category").distinct()
    emptied = emptied.join(left.where(F.col("status").isin("active", "processing")).select("category").distinct(), "category", "left_anti")
    cut = {n: t.join(gone, "document_id", "left_anti") for n in ("chunks", "hashes", "postings", "vectors") if (t := getattr(tables, n)) is not None}
    return replace(tables, documents=left, categories=tables.categories.join(emptied.withColumnRenamed("category", "name"), "name", "left_anti"), **cut)


def category_exists(categories: DataFrame, name: str) -> bool:
    return not categories.where(F.col("name") == name.strip()).isEmpty()


def list_categories(categories: DataFrame, documents: DataFrame) -> DataFrame:
    """Categories by name with the number of their active documents."""
    counts = category_counts(documents).withColumnRenamed("category", "name")
    return categories.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("name")


def create_category(categories: DataFrame, name: str, description: str | None = None) -> DataFrame:
    if not name.strip():
        raise Failure("INVALID", "empty name")
    if category_exists(categories, name):
        raise Failure("CATEGORY_EXISTS", name)
    new = categories.sparkSession.createDataFrame([(name.strip(), description)], "name string, description string")
    return categories.unionByName(new.withColumn("create_time", F.current_timestamp().cast("timestamp_ntz")), allowMissingColumns=True)


def delete_category(categories: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    if categories.where(F.col("name") == name).isEmpty():
        raise Failure("NOT_FOUND", name)
    if not documents.where((F.col("category") == name) & F.col("status").isin("active", "processing")).isEmpty():
        raise Failure("CATEGORY_NOT_EMPTY", name)
    return categories.where(F.col("name") != name)


def ensure_categories(categories: DataFrame, documents: DataFrame) -> DataFrame:
    """The categories and those that documents name besides."""
    wanted = documents.select(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(UNCATEGORISED)).alias("name")).distinct()
    return categories.unionByName(wanted.join(categories, "name", "left_anti"), allowMissingColumns=True)


def with_status(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with the newest status of their events (document_id, status, error_message, at)."""
    latest = events.groupBy("document_id").agg(F.max_by(F.struct("status", "error_message"), F.struct("at", "status")).alias("new"))
    rows = documents.join(latest, "document_id", "left")
    rows = rows.withColumn("status", F.coalesce("new.status", "status"))
    if "error_message" in documents.columns:
        rows = rows.withColumn("error_message", F.coalesce("new.error_message", "error_message"))
    return rows.drop("new")
