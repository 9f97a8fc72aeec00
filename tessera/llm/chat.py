"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: ``message`` (a whole text), ``delta`` (text streamed onto what is there),
``edit`` (a text that replaces the message) and ``regenerate`` (the message starts anew; deltas may follow). Folding
is a monoid: a run of events is summed up by whether it starts the message anew, the role, and the text since then,
and two neighbouring runs combine by the right one winning where it starts anew, else by joining the texts. So the
log is folded in blocks of sequence numbers, then by message, then rendered in blocks of turns, and only the blocks
of a conversation meet in its one row. No task sorts a whole hot conversation event by event.

Template: ``### <role>: <text></turn>\\n``. Backslash, ``#``, ``<`` in texts (and ``:`` in roles) are written
``\\b``, ``\\h``, ``\\l``, ``\\c``, so that no text holds a control string and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
#: Characters and what stands for them; a backslash is escaped first and read back last.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
TURNS_A_BLOCK, EVENTS_A_BLOCK = 64, 256
PARTIAL = "struct<anew:boolean,role:string,text:string>"


def escape(c: Column, role: bool = False) -> Column:
    for raw, stands in ESCAPES[: 4 if role else 3]:
        c = F.replace(c, F.lit(raw), F.lit(stands))
    return c


def unescape(c: Column) -> Column:
    for raw, stands in reversed(ESCAPES):
        c = F.replace(c, F.lit(stands), F.lit(raw))
    return c


def _joined(a: Column, b: Column) -> Column:
    """The monoid: ``a`` is the earlier run."""
    return F.struct(
        (a["anew"] | b["anew"]).alias("anew"),
        F.when(b["anew"], F.coalesce(b["role"], a["role"])).otherwise(F.coalesce(a["role"], b["role"])).alias("role"),
        F.when(b["anew"], b["text"]).otherwise(F.concat(a["text"], b["text"])).alias("text"),
    ).cast(PARTIAL)


def _folded(runs: Column) -> Column:
    nothing = F.struct(F.lit(False).alias("anew"), F.lit(None).cast("string").alias("role"), F.lit("").alias("text")).cast(PARTIAL)
    return F.aggregate(runs, nothing, lambda acc, x: _joined(acc, x["run"]))


def fold(events: DataFrame) -> DataFrame:
    """Events (conv_id, turn, part, seq, kind, role, text) to the final messages (conv_id, tb, turn, part, role, text).

    Messages are told apart by (conv_id, turn, part); ``part`` orders several messages of one turn. Events count in
    the order of seq, ties in the order of kind, role and text. A null text is empty, a null role the one known
    otherwise or else empty; a null turn, part or seq comes first; a null kind is a delta. A delta without a message
    starts one.
    """
    block = lambda c, n: F.floor(F.coalesce(F.col(c), F.lit(-1)) / n).cast("long")
    anew = F.coalesce(F.col("kind").isin("message", "edit", "regenerate"), F.lit(False))
    run = F.struct(anew.alias("anew"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")).cast(PARTIAL)
    log = events.select("conv_id", "turn", "part", "seq", "kind", run.alias("run"), block("turn", TURNS_A_BLOCK).alias("tb"), block("seq", EVENTS_A_BLOCK).alias("sb"))
    log = log.repartition("conv_id", "tb", "sb")
    parts = log.groupBy("conv_id", "tb", "sb", "turn", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "run"))).alias("runs"))
    parts = parts.select("conv_id", "tb", "sb", "turn", "part", _folded(F.col("runs")).alias("run")).repartition("conv_id", "tb")
    whole = parts.groupBy("conv_id", "tb", "turn", "part").agg(F.sort_array(F.collect_list(F.struct("sb", "run"))).alias("runs"))
    final = whole.select("conv_id", "tb", "turn", "part", _folded(F.col("runs")).alias("run"))
    return final.select("conv_id", "tb", "turn", "part", F.coalesce("run.role", F.lit("")).alias("role"), F.col("run.text").alias("text"))


def render(messages: DataFrame, learnt: str = "assistant") -> DataFrame:
    """What :func:`fold` returns to one row a conversation: conv_id, n_turns, formatted, loss_spans, blocks.

    ``loss_spans`` holds the (start, length) in code points of every text of the role ``learnt`` as it stands,
    escaped, in ``formatted``; ``blocks`` holds the same text in pieces, each with spans of its own, so that what
    reads it back needs no search through one long string. A null conv_id is one more conversation.
    """
    one = F.struct(F.col("turn"), F.col("part"), F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(AFTER_ROLE)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == learnt).alias("learnt"))
    rows = messages.groupBy("conv_id", "tb").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    spans_type = "array<struct<start:bigint,length:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans_type).alias("spans"))

    def placed(acc: Column, t: Column) -> Column:
        head, body = F.length(t["head"]).cast("long"), F.length(t["body"]).cast("long")
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body + len(CLOSE)).alias("at"), F.when(t["learnt"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).cast(spans_type).alias("spans"))

    def moved(acc: Column, b: Column) -> Column:
        shifted = F.transform(b["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))
        return F.struct((acc["at"] + b["chars"]).alias("at"), F.concat(acc["spans"], shifted).cast(spans_type).alias("spans"))

    blocks = rows.select(
        "conv_id", "tb", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("text"),
        F.aggregate("turns", start, placed).alias("done"),
    )
    block = F.struct("tb", F.col("text"), F.col("done.spans").alias("spans"), F.col("done.at").alias("chars"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(block)).alias("blocks"))
    return whole.select(
        "conv_id", "n_turns", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"),
        F.aggregate("blocks", start, moved)["spans"].alias("loss_spans"),
        F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["spans"].alias("spans"))).alias("blocks"),
    )


def read_back(text: Column) -> Column:
    """A formatted text to its turns: array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, AFTER_ROLE, 1)
        role = F.substring(head, len(OPEN) + 1, 1 << 30)
        body = F.substr(p, F.length(head) + len(AFTER_ROLE) + 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def learnt_text(blocks: Column) -> Column:
    """All text under the loss mask, unescaped."""
    of = lambda b: F.array_join(F.transform(b["spans"], lambda s: unescape(F.substr(b["text"], (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return F.array_join(F.transform(blocks, of), "")


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log in which every row is one whole message. Rows of one turn count in
    the order of role and text."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select("conv_id", "turn", F.row_number().over(same).cast("long").alias("part"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


#: A conversation whose texts hold control strings.
PROBE = r"\### Assistant: </turn> ok"


def op2_chat(spark, sf_dir):
    """All ``conversations``, and one whose texts hold control strings, formatted and read back. A null text is empty, a
    null role too, a null turn comes first, a null conv_id is one more conversation, repeated rows are turns of their own."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = render(fold(as_events(rows.unionByName(probe))))
    out = out.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"), F.transform("blocks", lambda b: read_back(b["text"])).alias("turns"), learnt_text(F.col("blocks")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda b: F.array_join(F.transform(b, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")), "")
    return out.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
           + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
