import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.functions.register import register
from tessera.operators import bm25, dedup, embed, fusion, ingest, knn, meta, rewrite, sessions
from tessera.sources import readers
from tessera.sources.config import DEFAULT
from tessera.streaming import status


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_upserts_are_idempotent_and_keep_other_terms(spark):
    index = bm25.Index.build(docs(spark, [(1, "a b a"), (2, "b c"), (3, None), (None, "x")]))
    new = docs(spark, [(2, "d d"), (4, "e")])
    once, twice = index.upsert(new), index.upsert(new).upsert(new)
    key = lambda i: sorted(map(tuple, i.postings.select("id", "term", "tf").collect()))
    assert key(once) == key(twice) == [(1, "a", 2), (1, "b", 1), (2, "d", 2), (4, "e", 1)]
    assert key(once.delete_where(F.col("id") == 1)) == [(2, "d", 2), (4, "e", 1)]
    assert sorted(r.id for r in once.docs.collect()) == [1, 2, 4]


def test_searches_without_rows(spark):
    index = bm25.Index.build(docs(spark, []))
    asked = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "qid long, query string")
    assert bm25.search(index, asked).collect() == []
    full = bm25.Index.build(docs(spark, [(1, "a b"), (2, "a")]))
    assert {r.qid for r in bm25.search(full, asked).collect()} == {1}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 1.0])], "id long, vector array<float>")
    got = knn.search(vectors, spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "qid long, vector array<double>"), 5).collect()
    assert [(r.qid, r.id, round(r.cosine, 6), round(r.score, 6)) for r in got] == [(7, 1, 0.707107, 0.853553), (7, 3, 0.0, 0.5)]


def test_many_queries_of_few_terms_are_not_broadcast(spark, monkeypatch):
    index = bm25.Index.build(docs(spark, [(1, "a b"), (2, "a"), (3, "c")]))
    asked = spark.createDataFrame([(i, "a c") for i in range(20)], "qid long, query string")
    whole = sorted(bm25.search(index, asked).collect())
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 10)  # two terms, forty rows
    hinted = []
    monkeypatch.setattr(bm25.F, "broadcast", lambda df, real=F.broadcast: hinted.append(df.columns) or real(df))
    assert sorted(bm25.search(index, asked).collect()) == whole and hinted == [["n", "mean"]]


def test_one_block_of_queries_is_held_at_a_time(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, vector array<double>")
    asked = vectors.select(F.lit(1).cast("long").alias("qid"), "vector").where("id < 20")  # one id for all
    whole = sorted(knn.search(vectors, asked, 4, digits=9).collect())
    sc, sizes, living = spark.sparkContext, [], []

    class Held:
        def __init__(self, value):
            self.real = real(value)
            sizes.append(sum(b.vectors.size for b in value.values()))
            living.append(1)
            assert len(living) == 1

        def destroy(self):
            living.pop()
            self.real.destroy()

        def __reduce__(self):
            return self.real.__reduce__()

    real = sc.broadcast
    monkeypatch.setattr(sc, "broadcast", Held)
    assert sorted(knn.search(vectors, asked, 4, digits=9, block_values=18).collect()) == whole
    assert len(sizes) == 4 and sum(sizes) == 60 and max(sizes) <= 18 + 3 * 4 and not living


def test_blocks_of_queries_agree(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = vectors.select(F.col("id").alias("qid"), "vector").where("id < 20")
    whole = sorted(knn.search(vectors, asked, 4, digits=9).collect())
    assert sorted(knn.search(vectors, asked, 4, digits=9, block_values=18).collect()) == whole
    m = np.array([v for _, v in rows])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    plain = [(q, i, n + 1) for q in range(20) for n, i in enumerate(sorted(range(60), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:4])]  # noqa: B023
    assert sorted((r.qid, r.id, r["rank"]) for r in whole) == sorted(plain)


def test_fused_scores_are_bounded(spark):
    leg = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, id long, rank int")
    got = fusion.reciprocal_ranks([leg, leg], None).collect()
    assert [(r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(10, 1), (11, 2)]
    assert max(r.score for r in got) == pytest.approx(2 / 61)


def test_cascade_and_context(spark):
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid long, id long, rank int")
    more = spark.createDataFrame([(1, 2, 1, 0), (1, 3, 2, 0), (1, 4, 1, 1)], "qid long, id long, rank int, word int")
    file = spark.createDataFrame([(1, 5, 1)], "qid long, id long, rank int")
    chunks = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "bad z"), (5, "w")], "id long, text string")
    excluded = spark.createDataFrame([(1, ["bad"])], "qid long, words array<string>")
    out = fusion.cascade(hits, more, file, chunks, excluded)
    assert [(r.id, r["rank"]) for r in sorted(out.collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2), (5, 3)]
    assert fusion.context(out.where("rank < 3"), "f.md").first().context == "以下内容来自文件: f.md\n\n【片段1】\nx\n\n【片段2】\ny\n\n"
    assert fusion.cascade(hits, more, file, chunks, excluded.where("qid = 9")).count() == 4


def test_by_source_tries_without_extension(spark):
    v = spark.createDataFrame([(1, [1.0], "notes.md"), (2, [1.0], "other.md")], "id long, vector array<double>, source string")
    asked = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "qid long, vector array<double>")
    names = spark.createDataFrame([(1, "notes.pdf"), (2, "other.md")], "qid long, name string")
    assert {(r.qid, r.id) for r in fusion.by_source(v, asked, names).collect()} == {(1, 1), (2, 2)}


def test_hash_register(spark):
    rows = dedup.hashed(docs(spark, [(1, "a"), (2, "a"), (3, "b"), (4, None)]))
    known = dedup.register(rows.where("doc_id = 3").select("hash", "doc_id"), rows)
    assert sorted((r.doc_id or 0) for r in known.collect()) == [1, 3, 4]
    assert dedup.forget(known, spark.createDataFrame([(3,)], "doc_id long")).count() == 2


def test_deletes_and_categories(spark):
    d = spark.createDataFrame([(1, "a", "active", "f"), (2, "a", "failed", "g"), (3, "b", "processing", "f")], "document_id long, category string, status string, file_name string")
    c = spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "document_id long, chunk_index int")
    names = spark.createDataFrame([("a", None), ("b", None), ("empty", None)], "name string, description string")
    t = meta.delete_documents(meta.Tables(d, c, c, c, names), spark.createDataFrame([(1,)], "document_id long"))
    assert [t.documents.count(), t.chunks.count(), t.categories.count()] == [2, 1, 2]
    assert {(r.document_id, r.chunks) for r in meta.list_documents(d, c).collect()} == {(1, 2), (2, 0), (3, 1)}
    assert meta.delete_category(names, d, "empty").count() == 2
    for bad in (lambda: meta.delete_category(names, d, "a"), lambda: meta.delete_category(names, d, "x"), lambda: meta.create_category(names, "a"), lambda: meta.create_category(names, " "), lambda: meta.document(d, 9)):
        with pytest.raises(meta.Failure):
            bad()
    assert meta.create_category(names, "new").count() == 4 and meta.ensure_categories(names, d.withColumn("category", F.lit(" "))).count() == 4
    events = spark.createDataFrame([(1, "failed", "why", 2), (1, "active", None, 1)], "document_id long, status string, error_message string, at int")
    assert {r.document_id: r.status for r in meta.with_status(d, events).collect()}[1] == "failed"
    assert meta.by_file_name(d, "f").count() == 1


def test_chat(spark):
    rows = [("s", i, "u" if i else "v", ["user", "assistant"][i % 2], f"m{i}", i) for i in range(30)]
    chat = spark.createDataFrame(rows, "session_id string, id long, user_id string, role string, content string, create_time long")
    assert [r.content for r in sessions.memory(chat).orderBy("place").collect()] == [f"m{i}" for i in range(10, 30)]
    assert [r.content for r in sessions.memory(chat, latest=False).orderBy("place").collect()] == [f"m{i}" for i in range(20)]
    assert sessions.sessions(chat).first().preview == "m29" and sessions.sessions(chat, "v").first().preview == "m0"
    assert sessions.delete_session(chat, chat.select("session_id")).count() == 0 and sessions.history(chat, "s").count() == 30
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "qid long, question string")
    context = spark.createDataFrame([(1, "ctx")], "qid long, context string")
    got = {r.qid: r.answer for r in sessions.ask(context, asked, model=str.upper).collect()}
    assert "CTX" in got[1] and got[2] == "未找到相关内容"


def test_files(spark, tmp_path):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t> b </w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", word)
    for name, content in (("a.txt", b"plain"), ("b.docx", data.getvalue()), ("c.pdf", b"%PDF"), ("d.docx", b"no zip"), ("e.html", b"<p>x</p>"), ("f.md", b"\xff")):
        (tmp_path / name).write_bytes(content)
    rows = {r.file_name: r for r in readers.parse(readers.files(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "plain" and rows["b.docx"].text == "one\na | b" and rows["e.html"].text == "x"
    assert rows["c.pdf"].error == "no parser for PDF" and rows["d.docx"].error and rows["f.md"].error
    served = {r.file_name: r.text for r in readers.parse(readers.files(spark, str(tmp_path)), lambda b, n: f"<i>{n}</i>").collect()}
    assert served["c.pdf"] == "c.pdf"
    assert {r.file_name for r in readers.texts(spark, str(tmp_path / "a.txt")).collect()} == {"a.txt"}
    assert readers.files(spark, str(tmp_path), 0).count() == 0
    reply = spark.createDataFrame([('{"data":{"content":"x"}}',), ('{"md_content":"y"}',), ("raw",)], "r string").select(readers.reply_text("r").alias("t"))
    assert [r.t for r in reply.collect()] == ["x", "y", "raw"]


def test_ingestion(spark):
    rows = [(1, "a.txt", "TXT", "same text", None, "c"), (2, "../b.txt", "TXT", "same text", None, " "), (3, "c.csv", "CSV", "h\nr1\nr2", None, None), (4, "d.pdf", "PDF", None, "no parser", "c")]
    out = ingest.ingest(spark.createDataFrame(rows, "doc_id long, file_name string, format string, text string, error string, category string"))
    assert {r.doc_id: (r.status, r.category) for r in out["documents"].collect()} == {1: ("active", "c"), 2: ("duplicate", "未分类"), 3: ("active", "未分类"), 4: ("failed", "c")}
    assert sorted(r.chunk_id for r in out["chunks"].collect()) == ["1_0", "3_0", "3_1"]
    again = ingest.ingest(spark.createDataFrame(rows[:1], "doc_id long, file_name string, format string, text string, error string, category string"), out["hashes"])
    assert again["documents"].first().status == "duplicate" and again["chunks"].count() == 0


def test_a_folder_is_ingested_in_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    seen = {}

    def index(rows, batch):
        seen.update({r.file_name: r.text for r in rows.collect()})

    for name in ("b.txt", "c.txt"):
        status.ingest(spark, str(tmp_path / "in"), index, str(tmp_path / "state"), 1).awaitTermination()
        (tmp_path / "in" / name).write_text(name)
    status.ingest(spark, str(tmp_path / "in"), index, str(tmp_path / "state")).awaitTermination()
    assert seen == {"a.txt": "one", "b.txt": "b.txt", "c.txt": "c.txt"}


def test_questions_from_end_to_end(spark, tmp_path):
    rows = [(1, "cats purr softly at night", "pets.md"), (2, "stocks fell sharply today", "news.md"), (3, "cats chase mice", None), (4, "   ", "blank.md")]
    chunks = spark.createDataFrame(rows, "id long, text string, source string")
    corpus = api.Corpus.of(chunks)
    asked = spark.createDataFrame([(1, "cats at night"), (2, "打开 news.md 里的 stocks"), (3, None), (4, "cats 不要 mice")], "qid long, query string")
    got = {}
    for r in api.retrieve(corpus, asked, 3).collect():
        got.setdefault(r.qid, []).append((r.stage, r.id))
    assert got[1][0][1] == 1 and (2 in {i for _, i in got[2]}) and 3 not in got
    assert 3 not in {i for _, i in got[4]}
    answers = {r.qid: r.answer for r in api.ask(corpus, asked, model=len_of).collect()}
    assert answers[1] != "未找到相关内容" and answers[3] == "未找到相关内容"
    found = api.vector_search(corpus, asked.where("qid = 1"), 2).collect()
    assert found[0].content.startswith("cats") and {r.source for r in found} <= {"pets.md", "未知来源"}
    plain = api.Corpus.of(chunks, keyword=False)
    assert {r.id for r in api.hybrid_search(plain, asked, 2).collect()} >= {1}
    kept = embed.store(chunks.withColumnRenamed("id", "chunk_id"), str(tmp_path / "v"))
    assert kept.where("vector IS NULL").count() == 1 and kept.count() == 4


@pytest.mark.parametrize("k", [3, 5, 8])
def test_each_expansion_word_brings_its_share(spark, k):
    words = ["salary", "income", "工资", "薪酬", "收入", "薪资"]
    texts = [" ".join([w] * (n + 1) + [f"other{i}{j}" for j in range(n)]) for i, w in enumerate(words) for n in range(6)]
    chunks = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, text string, source string")
    asked = spark.createDataFrame([(1, "薪资 salary")], "qid long, query string")
    rows = api.retrieve(api.Corpus.of(chunks), asked, k).collect()
    told = rewrite.rewrite(asked, DEFAULT, "RULE_ONLY").first()
    unit = lambda t: (v := embed.hashed_embedder(t)) / np.linalg.norm(v)
    vectors = np.array([unit(t) for t in texts])
    seen, expected = {r.id for r in rows if r.stage == 1}, []
    for place, word in enumerate(told.expand):
        if word == told.query:
            continue
        near = sorted(range(len(texts)), key=lambda i: (-round(float(vectors[i] @ unit(word)), 6), i))[: max(k // 2, 3)]  # noqa: B023
        expected += [((place, n + 1), i) for n, i in enumerate(near) if i not in seen]
        seen |= set(near)
    assert len(expected) > 3
    assert sorted(((r.pos.word, r.pos.rank), r.id) for r in rows if r.stage == 2) == expected


def len_of(prompt):
    return str(len(prompt))


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT latin_tokens('a, B--c') AS t").first().t == ["a", "b", "c"]
    r = spark.sql("SELECT round(rrf_score(1), 6) AS r, round(bm25_idf(10D, 1D), 6) AS i, file_extension('a.PDF') AS e, source_of_chunk('d_1_2') AS s").first()
    assert (r.r, r.i, r.e, r.s) == (0.016393, 1.992430, "pdf", "d_1")
    rows = spark.sql("SELECT d.id, c.* FROM VALUES (1, '# A\nx'), (2, '') AS d(id, t), LATERAL chunk_markdown(d.t, 'GENERAL') c").collect()
    assert [(x.id, x.chunk_index, x.prefix) for x in rows] == [(1, 0, "A")]
