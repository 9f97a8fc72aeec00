"""Intents of queries: rules as one column expression, a chain of classifiers, and replies of language models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import cjk_tokens, col

# Fixed word lists of the rules.
DEFINITIONAL = "什么是 定义 含义 意思 是什么 指的是 概念 解释".split()
PROCEDURAL = "如何 怎么 怎样 步骤 方法 操作 教程 怎么做 如何做 怎么办".split()
COMPARISON = "区别 对比 不同 差异 vs VS 相比 比较".split()
CONJUNCTIONS = "和 与".split()
FACTUAL = "多少 几个 是否 能不能 可以 有多少 几 多久 什么时候".split()
PRONOUNS = "那个 这个 它 这 那 东西 玩意".split()
INTENTS = "FACTUAL PROCEDURAL COMPARISON DEFINITIONAL AMBIGUOUS".split()
#: A classifier this sure ends the chain.
SURE = 0.70
#: What a model is told before the query; the names in it are those of REPLY.
PROMPT = """下面这句话是用户在知识库里输入的检索语句，请判断它想要什么，只输出一个 JSON 对象，前后不加文字和代码标记。各字段为：
- primaryIntent：DEFINITIONAL（问概念）、PROCEDURAL（问做法）、COMPARISON（问异同）、FACTUAL（问事实）、AMBIGUOUS（看不出）中的一个；
- confidence：对这一判断的把握，0 到 1 的小数；
- alternatives：其他可能，每项有 intent 和 probability；
- rewriteHints：检索时可以一并查找的词，二到五个；看不出意图时不填。
检索语句是："""
REPLY = "struct<primaryIntent:string,confidence:double,alternatives:array<struct<intent:string,probability:double>>,rewriteHints:array<string>>"


def result(intent: str, confidence: float) -> Column:
    return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))


def rules(query: Column | str, tokens: Column | None = None) -> Column:
    """struct(intent, confidence) of a query; null and blank ones are AMBIGUOUS with confidence 0. ``tokens`` is the
    number of its tokens, counted by the default segmenter if not given."""
    q = F.trim(col(query))
    tokens = F.size(cjk_tokens(q)) if tokens is None else tokens
    either = lambda words: q.rlike("|".join(words))
    han = r"[\x{4e00}-\x{9fa5}]"
    # Chinese on both sides of the first conjunction
    joined = reduce(Column.__or__, (q.rlike(rf"(?s)^[^{c}]*{han}[^{c}]*{c}.*{han}") for c in CONJUNCTIONS))
    counted = reduce(Column.__add__, (F.regexp_count(q, F.lit(p)) * len(p) for p in PRONOUNS))
    vague = (F.try_divide(counted.cast("double"), F.length(q).cast("double")) > 0.3) | (tokens <= 1)
    return (
        F.when(q.isNull() | (q == ""), result("AMBIGUOUS", 0.0))
        .when(either(DEFINITIONAL), result("DEFINITIONAL", 0.9))
        .when(either(PROCEDURAL), result("PROCEDURAL", 0.9))
        .when(either(COMPARISON) | joined, result("COMPARISON", 0.9))
        .when(either(FACTUAL), result("FACTUAL", 0.8))
        .when(vague, result("AMBIGUOUS", 0.3))
        .otherwise(result("FACTUAL", 0.6))
    )


def chain(*results: Column) -> Column:
    """The first sure result, else the first, else AMBIGUOUS; each may be null where its classifier failed."""
    sure = [F.when(r["confidence"] >= SURE, r) for r in results]
    return F.coalesce(*sure, *results, result("AMBIGUOUS", 0.0))


def parse_reply(reply: Column | str) -> Column:
    """A model's JSON, possibly fenced, to struct(intent, confidence, alternatives, hints). What can't be read is
    AMBIGUOUS with confidence 0; a missing confidence is 0.5; unknown intents are AMBIGUOUS."""
    text = F.trim(F.regexp_replace(F.trim(col(reply)), r"(?s)^`+[^\n]*\n(.*?)`+\s*$", "$1"))
    j = F.from_json(text, REPLY, {"mode": "PERMISSIVE"})
    known = lambda c: F.when(F.upper(F.trim(c)).isin(*INTENTS), F.upper(F.trim(c))).otherwise("AMBIGUOUS")
    sure = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))
    other = F.transform(F.coalesce(j["alternatives"], F.array().cast("array<struct<intent:string,probability:double>>")), lambda a: F.struct(known(a["intent"]).alias("intent"), sure(a["probability"]).alias("probability")))
    readable = F.get_json_object(text, "$").isNotNull()
    return F.struct(
        F.when(readable, known(j["primaryIntent"])).otherwise("AMBIGUOUS").alias("intent"),
        F.when(readable, sure(j["confidence"])).otherwise(0.0).alias("confidence"),
        F.when(readable, other).otherwise(F.array().cast("array<struct<intent:string,probability:double>>")).alias("alternatives"),
        F.coalesce(F.when(readable, j["rewriteHints"]), F.array().cast("array<string>")).alias("hints"),
    )
