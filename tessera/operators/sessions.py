"""Chat history: sessions, windows of messages, sources, prompts, and a turn of a chat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

MEMORY, SESSIONS = 20, 50
UNKNOWN_SOURCE = "未知来源"
# What a model is told before and after the context, and how the context is announced.
RULES = """你负责根据资料片段答复提问。
- 所说的每一点都要能在片段里找到出处，没有出处的不说；
- 片段没有涉及所问的事，就直说查不到；
- 先给结论，再列要点，不重复，必要时照抄片段中的原句。"""
FRAME = "可用的资料片段如下：\n\n"
CLOSING = "现在请作答；片段不足以作答时，请说资料里查不到。"


def sessions(chat: DataFrame, user: str | None = None, most: int = SESSIONS) -> DataFrame:
    """Newest sessions with the time and a preview of their last message. One aggregate; no row is read twice."""
    rows = chat if user is None else chat.where(F.col("user_id") == user)
    last = F.max_by("content", F.struct("create_time", "id"))
    found = rows.groupBy("session_id").agg(F.max("create_time").alias("last_active"), last.alias("content"))
    return found.select("session_id", "last_active", T.preview("content").alias("preview")).orderBy(F.desc("last_active"), "session_id").limit(most)


def history(chat: DataFrame, session: str | int) -> DataFrame:
    return chat.where(F.col("session_id") == session).orderBy("create_time", "id")


def memory(chat: DataFrame, most: int = MEMORY, latest: bool = True) -> DataFrame:
    """The newest messages of each session, or the oldest, in order, with the role that a model expects."""
    order = [F.desc("create_time"), F.desc("id")] if latest else ["create_time", "id"]
    kept = chat.withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("turn") <= most)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("create_time", "id"))
    return kept.select("session_id", place.alias("place"), F.when(F.lower("role") == "user", "user").otherwise("ai").alias("role"), "content")


def delete_session(chat: DataFrame, ids: DataFrame) -> DataFrame:
    return chat.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def append(chat: DataFrame, new: DataFrame) -> DataFrame:
    return chat.unionByName(new, allowMissingColumns=True)


def sources(chat: DataFrame) -> DataFrame:
    """Each message's sources, one a row; what is no JSON array has none."""
    return chat.select("session_id", "id", F.explode(F.array_distinct(T.json_sources("source_info"))).alias("source"))


def prompt(context: Column, question: Column, rules: str = RULES, memory: Column | None = None) -> Column:
    """What a model is asked: the rules, the messages before, if any, the context and the question."""
    before = F.coalesce(memory, F.lit("")) if memory is not None else F.lit("")
    return F.concat(F.lit(rules + "\n\n" if rules else ""), before, F.lit(FRAME), context, F.lit("\n\n问题："), question, F.lit("\n\n" + CLOSING))


def remembered(chat: DataFrame, most: int = MEMORY) -> DataFrame:
    """(session_id, memory): the newest messages of each session as lines, oldest first."""
    line = F.concat("role", F.lit("："), F.coalesce("content", F.lit("")), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return memory(chat, most).groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("memory"))


def ask(contexts: DataFrame, questions: DataFrame, model: Callable[[str], str] | None = None, none: str = "未找到相关内容", rules: str = RULES, memories: DataFrame | None = None) -> DataFrame:
    """(qid, context) and (qid, question) to (qid, prompt, answer), with the ``memory`` of each qid in its prompt if
    ``memories`` are given. Without a model the answer is null; without a context it says so. The model is called in
    Python workers, a batch of rows at a time."""
    rows = questions.join(contexts, "qid", "left")
    rows = rows.join(memories.select("qid", "memory"), "qid", "left") if memories is not None else rows.withColumn("memory", F.lit(""))
    rows = rows.select("qid", "context", prompt(F.coalesce("context", F.lit("")), F.col("question"), rules, F.col("memory")).alias("prompt"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            answers = [none if c is None else model(p) if model else None for c, p in zip(b.column("context").to_pylist(), b.column("prompt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("prompt"), pa.array(answers, pa.string())], ["qid", "prompt", "answer"])

    return rows.mapInArrow(run, f"qid {questions.schema['qid'].dataType.simpleString()}, prompt string, answer string")


def turns(answered: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The messages that a turn adds to a chat: of each (qid, session_id, question, answer) the question, and the answer
    with the distinct sources of what was ``found`` (qid, source, rank), as JSON; null without any. ``at`` is the time."""
    known = found.where(F.col("source").isNotNull()).groupBy("qid", "source").agg(F.min("rank").alias("rank"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"])
    rows = answered.join(known.groupBy("qid").agg(F.to_json(listed).alias("source_info")), "qid", "left")
    said = F.array(
        F.struct(F.lit(0).alias("id"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("source_info")),
        F.struct(F.lit(1).alias("id"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("source_info")),
    )
    return rows.select("session_id", F.explode(said).alias("m"), at.alias("create_time")).select("session_id", "m.*", "create_time")
