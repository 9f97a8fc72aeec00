import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, sample, textbytes, toxicity
from tessera.llm.common import fold
from tests.llm.conftest import prose


@pytest.mark.parametrize("module,name,mod,held,label", [(toxicity, "op1_toxicity", 5, 0, "toxic"), (quality, "op10_quality", 3, 1, "quality")])
def test_held_out_accuracy(spark, module, name, mod, held, label):
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in getattr(module, name)(spark, d).collect()}
    labels = duckdb.sql(f"SELECT doc_id, {label} FROM '{d}/labels.parquet'").fetchall()
    own = [(out[i], y) for i, y in labels if out[i].held_out]
    assert len(own) > 500 and np.mean([r.predicted == y for r, y in own]) >= 0.97
    if label == "toxic":
        assert np.mean([r.predicted for r, y in own if y]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in out], "doc_id long").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod).alias("f")).collect()}
    assert all(r.held_out == (fold[i] == held) for i, r in out.items())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    docs = [(1, "some text here"), (2, None), (3, ""), (None, "x"), (1, "some text here"), (4, " ".join(prose(1, 30_000))), (5, "日本語 ñ 😀")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = module.score(df, module.fitted(df, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    empty = [r.score for r in out if r.doc_id in (2, 3)]
    assert empty[0] == empty[1]
    for nothing in (labels.limit(0), labels.where("doc_id = 9")):
        assert all(0 <= r.score <= 1 for r in module.score(df, module.fitted(df, nothing)).collect())
    assert module.score(df.limit(0), module.fitted(df, labels)).collect() == []


def test_score_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "s")], "doc_id long, text string, score int, `__0` string")
    out = quality.score(df, quality.train(pa.array(["good text", "bad"]), np.array([1.0, 0.0]), 0.5))
    assert out.columns == ["doc_id", "text", "score", "__0", "score"]


def test_sample_is_bounded_and_reproducible(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("q"))
    text, y, share = sample.labelled(docs, labels, "q", lambda i: F.lit(True), 20, 10**6)
    assert len(text) == 40 and y.sum() == 20 and share == 0.25
    again = sample.labelled(docs.repartition(5), labels, "q", lambda i: F.lit(True), 20, 10**6)
    assert (again[1] == y).all()
    assert len(sample.labelled(docs, labels, "q", lambda i: F.lit(True), 20, 1000)[0]) == 10
    twice = docs.unionByName(docs.withColumn("text", F.lit("a")))
    text, y, share = sample.labelled(twice, labels.where("doc_id < 300"), "q", lambda i: i % 2 == 0, 20, 10**6, 30)
    assert set(text.to_pylist()) == {"a"} and [(y == v).sum() for v in (0, 1, -1)] == [20, 20, 30] and share == 0.5


def test_label_model_weighs_voters():
    r = np.random.default_rng(0)
    y = (r.random(2000) < 0.3).astype(int)
    vote = lambda hit, miss: r.random(2000) < np.where(y == 1, hit, miss)
    good = [vote(0.8, 0.02), vote(0.7, 0.05), vote(0.6, 0.03)]
    bad, clean = vote(0.3, 0.3), [vote(0.04, 0.8), vote(0.08, 0.7)]
    votes = np.column_stack([*good, bad, bad, bad, *clean])  # three copies of a voter that knows nothing
    model = toxicity.LabelModel()
    known = np.where(r.random(2000) < 0.2, np.where(r.random(2000) < 0.9, y, 1 - y), -1)  # a tenth of the labels is wrong
    for labels in (np.full(2000, -1), known):
        q = model.fit(votes, np.arange(8) >= 6, np.full(2000, 0.3), labels)
        assert ((q > 0.5) == y).mean() > 0.94
        for j in (0, 1, 2, 6, 7):  # accuracies are found without being told
            for c in (0, 1):
                assert abs(model.rates[c, j, 0] - votes[y == c, j].mean()) < 0.12
        assert sum(p >= 0 for p in model.parent[3:6]) >= 2  # the copies depend on one another
    assert abs(model.label_rates[1, 1] - 0.9) < 0.06 and abs(model.label_rates[0, 0] - 0.9) < 0.06


@pytest.fixture(scope="module")
def toxic_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return sample.labelled(docs, labels, "toxic", lambda i: fold(i, 5) != 0, toxicity.ROWS, toxicity.BYTES, toxicity.UNLABELLED)


def test_votes_decide_without_the_labels(toxic_sample):
    texts, y, share = toxic_sample
    assert (y == -1).sum() == toxicity.UNLABELLED
    r = np.random.default_rng(3)
    mine = (y < 0) | (r.random(len(y)) < 0.7)  # the rest is held out
    told, hidden = (toxicity.train(texts.filter(pa.array(mine)), y[mine], share, hide=h) for h in (False, True))
    held, truth = texts.filter(pa.array(~mine)), y[~mine]
    right = [np.mean((m.scores(held) >= 0.5) == truth) for m in (told, hidden)]
    assert right[0] >= 0.97 and right[1] >= right[0] - 0.015
    labelled = np.flatnonzero(y >= 0)
    voters = toxicity.Voters(texts.take(pa.array(labelled)), y[labelled])
    counts, words = voters.counts(texts)
    q, model = toxicity.posterior(voters, texts, counts, words, np.full(len(y), -1.0), share)
    assert np.mean((q[labelled] > 0.5) == y[labelled]) >= 0.97
    votes, _ = voters.votes(texts, counts, words)
    votes = votes[:, votes.any(axis=0)]
    free = np.flatnonzero(model.parent < 0)
    rates = np.array([[votes[y == c, j].mean() for j in free] for c in (0, 1)])
    assert np.abs(model.rates[:, free, 0] - rates).max() < 0.12  # what the model says of voters is what the labels say


def test_quality_score_is_the_sum_over_features():
    r = random.Random(4)
    texts = [" ".join(prose(k, r.randint(0, 25)) + ["é😀", "la", "la"]) for k in range(20)] + ["", " x ", "ab"]
    model = quality.train(pa.array(texts), np.array([k % 2 for k in range(len(texts))], float), 0.4, epochs=3)

    def raw(data: bytes, mixed: bool) -> np.ndarray:
        one = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])
        w = textbytes.words(one)
        return w.hashes() if mixed else w.hash_of(np.array([0]), np.array([len(data)]))

    def plain(text: str) -> float:
        words = text.encode().split()
        buckets = [quality._bucket(raw(x, True), 0)[0] for x in words]
        for a, b in zip(words, words[1:], strict=False):
            pair = np.array([1], np.uint64) if a == b else textbytes.grams(np.concatenate([raw(a, True), raw(b, True)]), 2)
            buckets.append(quality._bucket(pair, 1)[0])
        for n in quality.NGRAMS:
            buckets += [quality._bucket(raw(x[k : k + n], False), n)[0] for x in words for k in range(len(x) - n + 1)]
        z = model.bias + (sum(float(model.weights[b]) for b in buckets) / len(buckets) if buckets else 0.0)
        return 1 / (1 + np.exp(-z))

    assert np.allclose(model.scores(pa.array(texts)), [plain(t) for t in texts], atol=1e-6)


def test_toxicity_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "you idiot", 5, "s"), (2, None, 5, "s")], "doc_id long, text string, score int, toxic string")
    out = toxicity.score(df, toxicity.train(pa.array(["idiot"] * 6 + ["fine"] * 6), np.array([1.0] * 6 + [0.0] * 6), 0.5))
    assert out.columns == ["doc_id", "score"] and out.count() == 2


def test_hashes_agree_with_words():
    r = random.Random(1)
    texts = [" ".join(prose(k, r.randint(0, 30))) + r.choice(["", "\n", "\t x", " é😀"]) for k in range(60)] + ["", None, " ", "a"]
    w = textbytes.words(pa.array(texts))
    h = w.hashes()
    plain = [(d, x) for d, t in enumerate(texts) for x in (t or "").split()]
    assert [d for d, _ in plain] == w.doc.tolist()
    by = {}
    for (_, x), v in zip(plain, h.tolist(), strict=True):
        assert by.setdefault(x, v) == v
    assert len(set(by.values())) == len(by)
    cut = pa.array(["skip me", *texts])[1:]
    assert (textbytes.words(cut).hashes() == h).all()
    assert sum(hi - lo for lo, hi in textbytes.pieces(cut, 100)) == len(texts)
    assert (textbytes.words(pa.array(["ABC é"]), lower=True).hashes() == textbytes.words(pa.array(["abc é"])).hashes()).all()
