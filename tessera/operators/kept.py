"""What is kept between sessions: an index for BM25, and documents with all that hangs on them, in a store whose tables
change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import bm25, meta
from tessera.sources.store import Change, Layout, Snapshot, Store

_ID = {"document_id": ("documents", "chunks", "hashes", "postings", "vectors"), "name": ("categories",)}


class KeptIndex:
    """An inverted index in a folder: documents and postings by bucket of the id, so that an upsert writes the buckets of
    its ids only. Searches read it as :class:`tessera.operators.bm25.Index`, without tokenising anything again."""

    def __init__(self, store: Store):
        self.store = store

    @classmethod
    def create(cls, spark: SparkSession, root: str, id_type: str = "long", buckets: int = 64) -> KeptIndex:
        layout = lambda rest, unique: Layout(StructType.fromDDL(f"id {id_type}, {rest}"), ("id",), unique, buckets=buckets)
        return cls(Store.create(spark, root, {"docs": layout("dl bigint", True), "postings": layout("term string, tf bigint, dl bigint", False)}))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> KeptIndex:
        return cls(Store(spark, root))

    def index(self, version: int | None = None) -> bm25.Index:
        snapshot = self.store.snapshot(version)
        return bm25.Index(snapshot.table("docs"), snapshot.table("postings"))

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **commit) -> Snapshot:
        """Index documents, in place of those of their ids. One whose text is null or blank now is not indexed any more;
        of several rows of one id all terms count."""
        ids = docs.select(docs[id_col].alias("id"))
        longest = bm25.lengths(docs, id_col, text_col).groupBy("id").agg(F.max("dl").alias("dl"))
        return self.store.commit({"docs": Change(longest, ids), "postings": Change(bm25.terms(docs, id_col, text_col), ids)}, **commit)

    def delete(self, ids: DataFrame, **commit) -> Snapshot:
        """Without the documents of some ``id``."""
        return self.store.commit({"docs": Change(gone=ids), "postings": Change(gone=ids)}, **commit)


def keep(spark: SparkSession, root: str, tables: meta.Tables, buckets: int = 64) -> Store:
    """The tables of documents in a new store: documents and categories have one row a key, the others as many as they
    hold of a document."""
    held = {name: (df, key) for key, names in _ID.items() for name in names if (df := getattr(tables, name)) is not None}
    layouts = {n: Layout(df.schema, (key,), unique=n in ("documents", "categories"), buckets=buckets) for n, (df, key) in held.items()}
    store = Store.create(spark, root, layouts)
    store.commit({n: Change(df) for n, (df, _) in held.items()})
    return store


def tables(snapshot: Snapshot) -> meta.Tables:
    """The tables of documents as of one version."""
    return meta.Tables(**{n: snapshot.table(n) for n in snapshot.held["tables"]})


def delete_documents(store: Store, ids: DataFrame) -> Snapshot:
    """Delete documents (document_id) and all that hangs on them, and the categories that are left without documents, as
    one version: no one sees a document without its chunks. Fails with Conflict if others change a table meanwhile."""
    since = store.snapshot()
    held = tables(since)
    left = meta.delete_documents(held, ids).categories
    emptied = held.categories.join(left, "name", "left_anti")
    ids = ids.select("document_id")
    changes = {n: Change(gone=ids) for n in _ID["document_id"] if n in since.held["tables"]}
    return store.commit(changes | {"categories": Change(gone=emptied)}, since=since)
