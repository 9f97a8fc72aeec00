"""Intent chains, configuration, uploads, chat turns, the parser bridge and the SQL functions."""

import datetime
import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import api
from tessera.functions.register import register
from tessera.operators import chunk, ingest, intent, meta, rewrite, sessions
from tessera.sources import config, readers

REPLY = '```json\n{"primaryIntent":"comparison","confidence":0.9,"rewriteHints":["优缺点","区别"]}\n```'


def test_a_chain_takes_the_first_sure_classifier():
    unsure, sure = (lambda q, n: ("FACTUAL", 0.6)), (lambda q, n: ("COMPARISON", 0.7, ["h"]))

    def broken(q, n):
        raise RuntimeError

    assert rewrite.intents(broken, unsure, sure)("x", 3) == ("COMPARISON", 0.7, ["h"])
    assert rewrite.intents(unsure, broken)("x", 3) == ("FACTUAL", 0.6)
    assert rewrite.intents(broken, lambda q, n: None)("x", 3) == ("AMBIGUOUS", 0.0)


def test_hints_of_a_model_join_the_expansion(spark):
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return REPLY

    classify = rewrite.intents(rewrite.intent_of, rewrite.model_intents(ask))
    d = rewrite.Dictionaries()
    r = rewrite.rewrite_one("数据库性能", d, classify=classify)  # the rules are unsure: FACTUAL 0.6
    assert r.expand[-1] == "优缺点" and r.expand.count("区别") == 1 and "对比" in r.query
    assert asked[0].startswith(intent.PROMPT[:20]) and asked[0].endswith("数据库性能")
    assert rewrite.rewrite_one("如何配置", d, classify=classify).expand[-1] == "教程" and len(asked) == 1  # sure without it
    for bad in ("no json", "[1]", '{"primaryIntent":"x","confidence":7}'):
        assert rewrite.model_intents(lambda p: bad)("q", 2)[0] == "AMBIGUOUS"  # noqa: B023
    rows = spark.createDataFrame([(1, "数据库性能")], "qid long, query string")
    reply = REPLY
    assert "优缺点" in rewrite.rewrite(rows, d, classify=rewrite.model_intents(lambda p: reply)).first().expand


def test_segmenter_modes():
    words = ["数据", "数据库", "连接", "数据库连接"]
    assert rewrite.dictionary_segmenter(words)("数据库连接器") == ["数据库连接", "器"]
    assert rewrite.dictionary_segmenter(words, "index")("数据库连接器") == ["数据", "数据库", "连接", "数据库连接", "器"]
    with pytest.raises(ValueError):
        rewrite.dictionary_segmenter(words, "other")


def test_each_file_falls_back_on_its_own_and_is_followed(spark, tmp_path):
    s, m, w = (str(tmp_path / f"{n}.json") for n in "smw")
    (tmp_path / "m.json").write_text('{"entries":[{"from":"x","to":"y"}]}')
    (tmp_path / "w.json").write_text('{"zh":["配置"],"en":["Foo"]}')
    d = config.load(spark, s, m, stop=w)
    assert d.synonyms == config.DEFAULT.synonyms and d.fixed == {"x": "y"} and d.stop == {"配置", "foo"}
    assert rewrite.simple_keywords("foo 配置 bar the", stop=d.stop) == ["bar", "the"]
    assert "配置" not in rewrite.rewrite_one("怎么 配置 数据", d).expand
    watched = config.Watched(spark, s, m, w)
    assert watched.current() == d and watched.current() is watched.current()
    (tmp_path / "s.json").write_text('{"entries":[{"key":"a","synonyms":["b"]}]}')
    assert watched.current().synonyms == {"a": ["b"]} and watched.current().fixed == {"x": "y"}
    (tmp_path / "m.json").unlink()
    (tmp_path / "s.json").write_text("{broken")
    assert watched.current().synonyms == {"a": ["b"]} and watched.current().fixed == {"x": "y"}


def test_an_embedder_that_fails_leaves_cuts_by_length():
    def fails(s):
        raise RuntimeError

    text = "# T\n\n" + "cats purr softly. " * 30 + "stocks fell sharply. " * 30
    p = chunk.Preset(10, 150, 0, 0.75)
    by_length = chunk.Chunker(chunk.Preset(10, 150, 0), joiner=" ").chunks(text)
    assert [c.text for c in chunk.Chunker(p, embed=fails, joiner=" ").chunks(text)] == [c.text for c in by_length]
    some = chunk.Chunker(chunk.Preset(0, 150, 0, 0.75), embed=lambda s: None if "stocks" in s else np.ones(3), joiner=" ").chunks(text)
    assert [c.text.count(".") for c in some[-30:]] == [1] * 30  # a sentence without a vector stands alone


def test_a_document_that_can_not_be_cut_fails_alone(spark):
    schema = "doc_id long, file_name string, format string, text string, error string, category string"
    rows = [(1, "a.txt", "TXT", "bad text", None, "c"), (2, "b.txt", "TXT", "good text", None, "c")]

    def count(text):
        if "bad" in text:
            raise RuntimeError("why")
        return len(text.split())

    out = ingest.ingest(spark.createDataFrame(rows, schema), count=count)
    assert {r.doc_id: (r.status, r.error_message) for r in out["documents"].collect()} == {1: ("failed", "RuntimeError: why"), 2: ("active", None)}
    assert [r.doc_id for r in out["hashes"].collect()] == [2] and [r.chunk_id for r in out["vectors"].where("vector IS NOT NULL").collect()] == ["2_0"]
    with pytest.raises(Exception, match="why"):
        chunk.markdown_chunks(spark.createDataFrame(rows, schema).select("doc_id", "text"), count=count).collect()


def test_vectors_go_with_their_document(spark):
    one = lambda c: spark.createDataFrame([(1, c), (2, c)], "document_id long, x string")
    docs = spark.createDataFrame([(1, "a", "active"), (2, "b", "active")], "document_id long, category string, status string")
    t = meta.Tables(docs, one("c"), one("h"), one("p"), spark.createDataFrame([("a",), ("b",)], "name string"), one("v"))
    left = meta.delete_documents(t, docs.where("document_id = 1"))
    assert [r.document_id for r in left.vectors.collect()] == [2] and [r.name for r in left.categories.collect()] == ["b"]
    assert meta.category_exists(t.categories, " a ") and not meta.category_exists(t.categories, "z")
    assert [(r.name, r.n) for r in meta.list_categories(t.categories, docs.where("document_id = 1")).collect()] == [("a", 1), ("b", 0)]


def test_uploads(spark):
    rows = [("a.txt", b"one", "c"), ("b.txt", b"one", " "), ("../c.md", b"two", None), ("d.zip", b"three", "c"), ("e.txt", b"", "c"), ("f.txt", b"old", "c"), ("g.txt", None, "c")]
    known = spark.createDataFrame([(b"old",)], "c binary").select(F.sha2("c", 256).alias("hash"))
    out = {r.file_name: r for r in ingest.upload(spark.createDataFrame(rows, "file_name string, content binary, category string"), known, F.lit(datetime.datetime(2024, 3, 5))).collect()}
    assert {n: r.code for n, r in out.items()} == {"a.txt": None, "b.txt": 1007, "../c.md": None, "d.zip": 1005, "e.txt": 400, "f.txt": 1007, "g.txt": 400}
    c = out["../c.md"]
    assert (c.status, c.category, c.path) == ("processing", "未分类", f"2024-03/{c.hash[:8]}___c.md") and out["b.txt"].path is None


def test_a_chat_turn_remembers_and_is_kept(spark):
    chunks = spark.createDataFrame([(1, "cats purr softly", "pets.md"), (2, "cats sleep", None), (3, "stocks fell", "news.md")], "id long, text string, source string")
    corpus = api.Corpus.of(chunks)
    schema = "session_id string, id int, role string, content string, source_info string, create_time timestamp"
    old = [("s", i, ["user", "assistant"][i % 2], f"m{i:02d}", None, datetime.datetime(2024, 1, 1, 0, i)) for i in range(24)]
    questions = spark.createDataFrame([(1, "s", "cats purr"), (2, "new", "zzz qqq")], "qid long, session_id string, query string")
    now = F.lit(datetime.datetime(2024, 2, 1))
    after = api.chat_turn(corpus, spark.createDataFrame(old, schema), questions, model=lambda p: p, at=now)
    rows = after.where("create_time > '2024-01-20'").orderBy("session_id", "id").collect()
    assert after.count() == 28 and [(r.session_id, r.role) for r in rows] == [("new", "user"), ("new", "assistant"), ("s", "user"), ("s", "assistant")]
    said = rows[3].content
    assert said.startswith(sessions.RULES) and said.endswith(sessions.CLOSING) and "cats purr softly" in said and "问题：cats purr" in said
    assert said.index("m04") < said.index("m23") and "m03" not in said  # the newest twenty
    assert rows[2].content == "cats purr" and json.loads(rows[3].source_info)[0] == "pets.md" and None not in json.loads(rows[3].source_info)
    assert "m23" not in rows[1].content


def test_parser_bridge(spark, tmp_path):
    script = tmp_path / "p.py"
    script.write_text(
        "import json,sys,time\nd=open(sys.argv[1]).read()\n"
        "if d=='slow': time.sleep(60)\nif d=='big': print('x'*(3<<20))\nif d=='fail': sys.exit(3)\n"
        "print('noise {not' if d=='none' else 'noise', json.dumps({'success': d!='no', 'error': 'why', 'content': json.dumps({'results': {'a': {'md_content': '# '+d}}})}) if d!='none' else '')\n"
    )
    service = readers.command_service([sys.executable, str(script)], most_mb=1, timeout=3)
    assert service(b"text", "a/b.pdf") == "# text"
    for bad, why in ((b"slow", "no reply"), (b"big", "output"), (b"fail", "exit code 3"), (b"no", "why"), (b"none", "Expecting value")):
        with pytest.raises((OSError, ValueError), match=why):
            service(bad, "x.pdf")
    assert readers.bridge_text('{"success":true,"content":"{\\"results\\":\\"r\\"}"}') == "r"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_text("text")
    (tmp_path / "in/b.pdf").write_text("fail")
    got = {r.file_name: (r.text, r.error) for r in readers.parse(readers.files(spark, str(tmp_path / "in")), service).collect()}
    assert got["a.pdf"] == ("# text", None) and "exit code 3" in got["b.pdf"][1]


def test_more_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT token_count('élan, 数据 a_1') AS t, contains_cjk('a数') AS c, remove_extension('a.b.c') AS e, sanitize_filename('../a/b') AS s, round(cosine(array(1D, 0D), array(1D, 1D)), 6) AS k, round(bm25_term(2D, 10D, 10D, 100D, 5D), 6) AS b").first()
    assert (r.t, r.c, r.e, r.s, r.k) == (4, True, "a.b", "__a_b", 0.707107)
    assert abs(r.b - np.log(1 + 95.5 / 5.5) * 2 * 2.2 / 3.2) < 1e-6
    r = spark.sql("SELECT q.id, r.path, i.intent FROM VALUES (1, '如何配置API接口') AS q(id, t), LATERAL rewrite_query(q.t, 'FULL') r, LATERAL query_intent(q.t) i").first()
    assert (r.path, r.intent) == ("L1_RULE", "PROCEDURAL")


def test_texts_by_id(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "  "), (3, "c")], "id long, text string")
    index = api.Corpus.of(chunks.withColumn("source", F.lit("s"))).index
    found = index.text_of(chunks, spark.createDataFrame([(1,), (2,), (9,)], "id long")).collect()
    assert [(r.id, r.text) for r in found] == [(1, "a b")]


def test_the_catalogue_does_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm", None)  # as if it couldn't be imported
    assert "bm25_search" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())
