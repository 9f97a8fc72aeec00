import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import substring
from tests.llm.conftest import WORDS, prose


def brute(docs):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def corpus():
    r = random.Random(8)
    passages = [prose(1000 + k, r.choice([12, 13, 14, 30, 70])) for k in range(12)]
    docs = []
    for i in range(80):
        w = prose(i, r.randint(0, 60))
        for _ in range(r.randint(0, 4)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = f"edit{i}"
            at = r.randint(0, len(w))
            w[at:at] = p
        docs.append((i * 7 % 83, r.choice([" ", "\n", "\t "]).join(w)))
    docs += [(500, "same " * 40), (501, "same " * 30), (502, "a b c " * 12), (503, "a b c " * 20), (504, ""), (505, None), (506, "x"), (507, " ".join(passages[3] * 5))]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_an_anchor_with_very_many_contents(spark, monkeypatch):
    line = prose(77, 16)
    docs = [(i, " ".join(prose(3000 + i, 20) + line + prose(6000 + i, 20))) for i in range(120)]
    expected = brute(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == expected
    passages = [(p, i) for i, p in enumerate([["a"] * 5, ["b", "a", "a"]])]
    automaton = substring.Automaton(passages)
    assert [n for n, _ in automaton.statistics(["b", "a", "a", "a", "c", "a"])] == [1, 2, 3, 3, 0, 1]


def test_nulls_and_repeated_ids(spark):
    text, other = " ".join(prose(1, 20)), " ".join(prose(2, 15))
    rows = [(1, text, 0), (1, other, 0), (1, text, 0), (None, text, 0), (2, text + " " + other, 0)]
    out = substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, tag int"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(1, 20, 0), (1, 15, 0), (1, 20, 0), (None, 20, 0), (2, 35, 35)], key=str)


def test_empty_table(spark):
    assert substring.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_known_references(spark):
    line = prose(5, 15)
    docs = spark.createDataFrame([(1, " ".join(["start", *line, "end"])), (2, " ".join(line[:12])), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([(" ".join(line),), (None,)], "text string")
    got = {r.doc_id: r.kept for r in substring.remove_known(docs, known).collect()}
    assert got == {1: "start end", 2: " ".join(line[:12]), 3: ""}


def test_query_columns(spark):
    docs = spark.createDataFrame([(1, "a  b")], "doc_id long, text string")
    row = substring.remove_repeated(docs).select(F.sha2("kept", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"a b").hexdigest()


def test_crowded_anchors_and_long_runs_against_brute_force(spark):
    docs = corpus()
    line = prose(77, 16)
    docs += [(1000 + i, " ".join(prose(3000 + i, 20) + line + prose(6000 + i, 20))) for i in range(60)]
    long = prose(99, 5500)  # longer than a run
    docs += [(2000, " ".join(long)), (2001, " ".join(long[:3000] + ["cut"] + long[3000:])), (2002, " ".join(long[2500:])), (1999, " ".join(long[4000:4100]))]
    expected = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for most in (1, 3, 1000):  # all anchors of several contents are crowded, some, or none
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated(df, most).collect()}
        assert got == expected


def test_rows_repeated_very_often(spark):
    text = " ".join(prose(1, 200))
    rows = [(1, text)] + [(2, text)] * 3000 + [(3, text + " more")]
    out = substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(1, 200, 0, 1), (2, 200, 200, 3000), (3, 201, 200, 1)]
