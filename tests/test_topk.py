import random
import re

from pyspark.sql import functions as F

from tessera.operators import bm25, topk


def both(spark, docs, queries, k, **more):
    docs, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "qid long, query string")
    index = topk.BlockIndex.build(docs, **({"size": more.pop("size")} if "size" in more else {}))
    found = topk.search(index, queries, k, 6, **more)
    plain = bm25.search(bm25.Index.build(docs), queries, k, 6).where("qid IS NOT NULL")
    key = lambda df: sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    return key(found.rows), key(plain), {(r.qid, r.stage): r.postings for r in found.read.collect()}


def corpus(n, seed=5):
    """Words by a steep law, so that a few are in most documents."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]


def test_same_rows_as_scoring_everything(spark):
    docs = corpus(700)
    queries = [(1, "w0 w1 w300"), (2, "w0 w0 w2"), (3, "w250 w251 w399"), (4, "nowhere"), (5, ""), (6, None), (None, "w0"), (7, docs[13][1])]
    got, plain, _ = both(spark, docs, queries, 7, size=8, pilots=3)
    assert got == plain and {g[0] for g in got} == {1, 2, 3, 7}
    got, plain, _ = both(spark, docs, queries, 3, size=64, pilots=1)
    assert got == plain


def test_ties_nulls_and_small_tables(spark):
    docs = [(i, "a b") for i in range(60)] + [(100, None), (101, " "), (None, "a b"), (102, "a")]
    got, plain, _ = both(spark, docs, [(1, "a"), (2, "b a")], 5, size=4, pilots=2)
    assert got == plain and [g[2] for g in got if g[0] == 2] == [0, 1, 2, 3, 4]
    got, plain, _ = both(spark, docs[:3], [(1, "a")], 10)
    assert got == plain and len(got) == 3
    assert both(spark, [], [(1, "a")], 3)[:2] == ([], [])
    assert both(spark, docs, [], 3)[:2] == ([], [])


def test_most_postings_of_common_words_stay_unread(spark):
    docs = corpus(6000)
    got, plain, read = both(spark, docs, [(1, "w0 w1 w2 w390 w395"), (2, "w0 w3 w380 w385")], 3, size=4)
    assert got == plain
    for qid in (1, 2):
        assert sum(read.get((qid, s), 0) for s in ("pilots", "main", "aside")) < 0.1 * read[qid, "all"]


def test_a_search_opens_the_folders_of_its_terms(spark):
    index = topk.BlockIndex.build(spark.createDataFrame(corpus(200), "doc_id long, text string"))
    shelves = {r.shelf for r in index.blocks.select("shelf").distinct().collect()}
    assert len(shelves) > 32
    some = index.blocks.where(F.col("shelf").isin([min(shelves)]))
    assert all(f"shelf={min(shelves)}/" in r.f for r in some.select(F.input_file_name().alias("f")).collect())
    index.release()


def test_postings_are_shuffled_once_and_by_block(spark, monkeypatch):
    plans, kept = {}, topk.stored

    def noted(df, what, **more):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, what, **more)

    monkeypatch.setattr(topk, "stored", noted)
    monkeypatch.setattr(topk, "LEAST_TEXT", 1000)  # several tasks for a small table
    docs = corpus(300)
    got, plain, _ = both(spark, docs, [(i, docs[i][1]) for i in range(20)], 3, size=8)
    assert got == plain
    dealt = {what: re.findall(r"\bExchange (\w+\(\w+)", plan) for what, plan in plans.items()}
    assert [{x.split("#")[0] for x in dealt[what]} for what in ("bm25-blocks", "batch", "known", "more")] == [{"hashpartitioning(block"}] * 2 + [set()] * 2
    assert [len(dealt[what]) for what in ("bm25-blocks", "batch")] == [1, 1]


def test_ids_of_text_that_repeat_and_batches_searched_some_at_a_time(spark, monkeypatch):
    docs = [(f"d{i % 150}", t) for i, t in corpus(200)]
    docs, queries = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(f"q{i}", docs[i][1]) for i in range(12)], "qid string, query string")
    plain = bm25.search(bm25.Index.build(docs.groupBy("doc_id").agg(F.max("text").alias("text"))), queries, 4, 6).collect()
    index = topk.BlockIndex.build(docs.groupBy("doc_id").agg(F.max("text").alias("text")), size=8)
    monkeypatch.setattr(topk.bm25, "BROADCAST_TERMS", 60)
    key = lambda rows: sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in rows)
    found = topk.search(index, queries, 4, 6, pilots=2)
    assert key(found.rows.collect()) == key(plain)
    assert found.read.where("stage = 'all'").count() == 12
    twice, old = topk.BlockIndex.build(docs, size=8), bm25.terms(docs)
    posts = twice.blocks.select("term", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p")).select(F.col("p.ids").alias("id"), "term", F.col("p.tf").alias("tf"), F.col("p.dl").alias("dl"))
    assert sorted(map(tuple, posts.collect())) == sorted(map(tuple, old.select("id", "term", "tf", "dl").collect()))


def test_a_task_of_the_index_has_a_bounded_text(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [topk._tasks(spark, c) for c in (0, 5, 1_000_001, 2_000_000, 1e7)] == [1, 1, min(2, cores), min(2, cores), min(10, cores)]
    assert topk._tasks(spark, 1.6e10) == 1000
