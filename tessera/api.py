"""The library's functions by task. Tables go in and come out; queries are batches keyed by ``qid``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, chunk, embed, fusion, knn, rewrite, sessions
from tessera.operators.ingest import ingest as ingest  # noqa: PLC0414
from tessera.operators.ingest import upload as upload  # noqa: PLC0414
from tessera.operators.meta import (  # noqa: F401
    by_category,
    category_counts,
    category_exists,
    create_category,
    delete_category,
    delete_documents,
    document_status,
    list_categories,
    list_documents,
)
from tessera.sources.config import DEFAULT


@dataclass
class Corpus:
    """Chunks (id long, text, source) with their vectors and inverted index."""

    chunks: DataFrame
    vectors: DataFrame
    index: bm25.Index | None
    embedder: embed.Embedder = chunk.hashed_embedder

    @classmethod
    def of(cls, chunks: DataFrame, embedder: embed.Embedder = chunk.hashed_embedder, keyword: bool = True) -> Corpus:
        vectors = embed.embed(chunks, "id", embedder=embedder).join(chunks.select("id", "source"), "id").persist()
        return cls(chunks, vectors, bm25.Index.build(chunks, "id") if keyword else None, embedder)

    def release(self) -> None:
        """Let go of the persisted vectors and postings."""
        self.vectors.unpersist()
        if self.index:
            self.index.release()

    def asked(self, queries: DataFrame) -> DataFrame:
        return embed.embed(queries, "qid", "query", self.embedder).join(queries.select("qid", "query"), "qid")


def vector_search(corpus: Corpus, queries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, query) to content, score and source of the nearest chunks; an unknown source says so."""
    found = knn.search(corpus.vectors, corpus.asked(queries), k)
    rows = fusion.with_texts(found, corpus.chunks.select("id", "text", "source"))
    return rows.select("qid", "rank", F.col("text").alias("content"), "score", F.coalesce("source", F.lit(sessions.UNKNOWN_SOURCE)).alias("source"))


def keyword_search(corpus: Corpus, queries: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """(qid, query) to the best chunks by words, with their text and source."""
    rows = fusion.with_texts(bm25.search(corpus.index, queries, k, digits), corpus.chunks.select("id", "text", "source"))
    return rows.select("qid", "id", "rank", "score", "text", F.coalesce("source", F.lit(sessions.UNKNOWN_SOURCE)).alias("source"))


def hybrid_search(corpus: Corpus, queries: DataFrame, k: int = 10) -> DataFrame:
    return fusion.hybrid(corpus.index, corpus.vectors, corpus.asked(queries), k)


def retrieve(corpus: Corpus, queries: DataFrame, k: int = 5, dictionaries: rewrite.Dictionaries = DEFAULT, decision: str = "RULE_ONLY", limit: int | None = None, model=None, classify: rewrite.Classifier = rewrite.intent_of) -> DataFrame:
    """Queries (qid, query) through rewriting and the cascade: (qid, id, stage, pos, score, text, rank).

    Expansion words are looked up by vectors, each for half of k (3 at least); a file that a query names is searched
    besides; excluded words drop what holds them.
    """
    told = rewrite.rewrite(queries, dictionaries, decision, model=model, classify=classify).persist()
    asked = told.select("qid", "query").where(F.trim("query") != "")
    hits = hybrid_search(corpus, asked, k)
    words = told.select("qid", "query", F.posexplode("expand").alias("word", "w")).where(F.col("w") != F.col("query"))
    each = words.select(F.col("w").alias("qid"), F.col("w").alias("query")).distinct()  # a word means the same in all queries
    more = knn.search(corpus.vectors, corpus.asked(each), max(k // 2, 3))
    more = more.withColumnRenamed("qid", "w").join(words.select("qid", "word", "w"), "w").select("qid", "id", "rank", "word", "score")
    names = told.select("qid", T.file_name("query").alias("name"), "query").where("name IS NOT NULL")
    content = names.select("qid", F.coalesce(F.nullif(T.content_query("query", "name"), F.lit("")), "query").alias("query"))
    file = fusion.by_source(corpus.vectors, corpus.asked(content), names.select("qid", "name"))
    return fusion.cascade(hits, more, file, corpus.chunks, told.select("qid", F.col("exclude").alias("words")), limit)


def chat_turn(corpus: Corpus, chat: DataFrame, questions: DataFrame, k: int = 3, model=None, at: Column | None = None, **options) -> DataFrame:
    """Questions (qid, session_id, query), one a session, with the chat (session_id, id, role, content, source_info,
    create_time) before them: answered from what :func:`retrieve` finds and the newest messages of the session. Returns
    the chat with the questions and answers; an answer carries the sources of what was found."""
    asked = questions.select("qid", "query")
    found = retrieve(corpus, asked, k, **options).persist()
    memories = questions.select("qid", "session_id").join(sessions.remembered(chat), "session_id").select("qid", "memory")
    answers = sessions.ask(fusion.context(found), asked.withColumnRenamed("query", "question"), model, memories=memories)
    answered = questions.select("qid", "session_id", F.col("query").alias("question")).join(answers.select("qid", "answer"), "qid")
    sources = found.join(corpus.chunks.select("id", "source"), "id").select("qid", "source", "rank")
    return sessions.append(chat, sessions.turns(answered, sources, F.current_timestamp() if at is None else at))


def ask(corpus: Corpus, queries: DataFrame, k: int = 3, model=None, **options) -> DataFrame:
    """(qid, query) to prompt and answer, over what :func:`retrieve` finds."""
    contexts = fusion.context(retrieve(corpus, queries, k, **options))
    return sessions.ask(contexts, queries.select("qid", F.col("query").alias("question")), model)
