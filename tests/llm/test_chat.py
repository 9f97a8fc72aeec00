import hashlib

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat


def test_events_are_folded(spark):
    rows = [
        ("c", 0, 1, 0, "message", "user", "hi"), ("c", 1, 1, 1, "delta", "assistant", "he"), ("c", 1, 1, 2, "delta", None, "llo"),
        ("c", 0, 1, 3, "edit", None, "hi!"), ("c", 1, 1, 4, "regenerate", "assistant", None), ("c", 1, 1, 5, "delta", None, "good "),
        ("c", 1, 1, 900, "delta", None, "day"), ("d", None, None, None, None, None, None), (None, 0, 1, 0, "message", "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn long, part long, seq long, kind string, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.render(chat.fold(df)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {"c": [("user", "hi!"), ("assistant", "good day")], "d": [("", "")], None: [("user", "x")]}


def test_round_trip_of_control_strings(spark):
    texts = [chat.PROBE, "\\l \\b \\h # < </turn>\n### user: x", "", None, "é😀\\", "</turn>\n" * 3]
    rows = [(i, t, r, x) for i in range(3) for t, x in enumerate(texts) for r in [("user", "assistant", "a: b</turn>")[(i + t) % 3]]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.as_events(df))).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.learnt_text(F.col("blocks"))).collect()
    for r in out:
        own = [(x[2], x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own and r.n_turns == len(own)
        assert r.learnt == "".join(t for role, t in own if role == "assistant")
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(spans) == sum(role == "assistant" for role, _ in own)


def test_a_long_conversation_crosses_blocks(spark):
    n = 300
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    r = chat.render(chat.fold(chat.as_events(df))).first()
    assert r.n_turns == n and len(r.blocks) > 4
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [f"t{i}" for i in range(1, n, 2)]


def test_empty_table_and_repeated_rows(spark):
    schema = "conv_id long, turn long, role string, text string, part string"
    assert chat.render(chat.fold(chat.as_events(spark.createDataFrame([], schema)))).collect() == []
    twice = spark.createDataFrame([(1, 0, "user", "x", "p")] * 2, schema)
    assert chat.render(chat.fold(chat.as_events(twice))).first().n_turns == 2


def test_query_has_the_probe(spark, tmp_path):
    spark.createDataFrame([(5, 0, "user", "q")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op2_chat(spark, str(tmp_path)).collect()}
    said = "".join(f"{role}\n{chat.PROBE}\n" for role in ("user", "assistant"))
    assert set(got) == {5, -7} and got[-7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest() and got[-7].loss_chars == len(chat.PROBE)


def test_nulls_and_very_long_texts_agree_with_sql(spark, tmp_path):
    long = "é#<\\ " * 60_000
    rows = [(1, 1, "user", long), (1, None, "assistant", "first"), (1, None, None, None), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (2, 0, "assistant", None), (1, 2, "assistant", long)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op2_chat(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.sql(chat.OP2_SQL)
    assert len(got) == 4
    for row in sql.fetchall():
        want = dict(zip(sql.columns, row, strict=True))
        assert got[want["conv_id"]].asDict() == want
    said = "\n\nassistant\nfirst\n" + f"user\n{long}\nassistant\n{long}\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == 5 + len(long)
