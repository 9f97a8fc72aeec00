"""Scores as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the ranking functions.
K1, B, RRF_K = 1.2, 0.75, 60


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, mean: Column, n: Column, df: Column, qtf: Column) -> Column:
    return qtf * idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(length, mean)))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (F.lit(float(k)) + rank)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty and zero vectors; both are summed in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def keyword_score(count: Column, token: Column) -> Column:
    return count * (1 + F.length(token) * 0.3)


def rewrite_confidence(keywords: Column, intent: Column, hits: Column, valid: Column, tokens: Column) -> Column:
    """Weighted from the number of keywords, a clear intent, dictionary hits a keyword, and valid tokens; half up to
    two places."""
    many = F.when(keywords >= 3, 1.0).when(keywords == 2, 0.6).when(keywords == 1, 0.3).otherwise(0.0)
    clear = F.when(intent == "AMBIGUOUS", 0.0).otherwise(1.0)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    total = many * 0.3 + clear * 0.3 + share(hits, keywords) * 0.2 + share(valid, tokens) * 0.2
    return F.floor(total * 100 + 0.5) / 100.0
