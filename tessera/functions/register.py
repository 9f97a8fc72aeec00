"""SQL access: functions that the engine inlines, and a table function for chunks."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.operators import chunk, rewrite
from tessera.sources.config import DEFAULT

# SQL functions are expanded into the plan, so they stay in generated code.
FUNCTIONS = {
    "latin_tokens(text STRING) RETURNS ARRAY<STRING>": r"filter(transform(split(text, '[\\s\\p{Punct}]+'), t -> trim(lower(t))), t -> t <> '')",
    "rrf_score(place INT) RETURNS DOUBLE": "1 / (60D + place)",
    "bm25_idf(n DOUBLE, df DOUBLE) RETURNS DOUBLE": "ln(1 + (n - df + 0.5D) / (df + 0.5D))",
    "file_extension(name STRING) RETURNS STRING": r"lower(regexp_extract(name, '^.+\\.([^.]+)$', 1))",
    "token_count(text STRING) RETURNS INT": r"regexp_count(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\x20\\t\\n\\x0B\\f\\r]')",
    "contains_cjk(text STRING) RETURNS BOOLEAN": r"text RLIKE '[\\x{4e00}-\\x{9fff}]'",
    "remove_extension(name STRING) RETURNS STRING": r"regexp_replace(name, '^(.+)\\.[^.]*$', '$1')",
    "sanitize_filename(name STRING) RETURNS STRING": r"CASE WHEN name IS NULL OR name = '' THEN 'unknown.txt' ELSE regexp_replace(replace(name, '..', '_'), '[/\\\\]', '_') END",
    "bm25_term(tf DOUBLE, length DOUBLE, mean DOUBLE, n DOUBLE, df DOUBLE) RETURNS DOUBLE": "ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * length / mean))",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))",
    "source_of_chunk(chunk STRING) RETURNS STRING": r"regexp_replace(chunk, '^(.+)_[^_]*$', '$1')",
}


@udtf(returnType="chunk_index INT, text STRING, tokens INT, prefix STRING")
class ChunkMarkdown:
    """Chunks of a text by a preset's name."""

    def eval(self, text: str, preset: str):
        chunker = chunk.Chunker(chunk.PRESETS.get(preset, chunk.PRESETS["GENERAL"]), embed=chunk.hashed_embedder)
        for i, c in enumerate(chunker.chunks(text)):
            yield i, c.text, c.tokens, c.prefix


@udtf(returnType="query STRING, expand ARRAY<STRING>, exclude ARRAY<STRING>, confidence DOUBLE, path STRING")
class RewriteQuery:
    """A query rewritten with the shipped dictionaries."""

    def eval(self, query: str, decision: str):
        r = rewrite.rewrite_one(query, DEFAULT, decision or "RULE_ONLY")
        yield r.query, r.expand, r.exclude, r.confidence, r.path


@udtf(returnType="intent STRING, confidence DOUBLE")
class QueryIntent:
    """The intent of a query by the rules."""

    def eval(self, query: str):
        yield rewrite.intent_of(query or "", len(rewrite.tokens(query or "", rewrite.dictionary_segmenter([]))))


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in (("chunk_markdown", ChunkMarkdown), ("rewrite_query", RewriteQuery), ("query_intent", QueryIntent)):
        spark.udtf.register(name, function)
