import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.components import components
from tests.llm.conftest import WORDS, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    r = random.Random(3)
    base = [prose(s, r.randint(4, 160)) for s in range(25)]
    docs = [(100 + i, " ".join(b)) for i, b in enumerate(base)]
    n = 200
    for b in base:
        for edits in (0, 1, 2, 4, 8, 16):
            w = list(b)
            for _ in range(edits):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            docs.append((n, " ".join(w).upper() if edits == 0 else "\n".join(w)))
            n += 1
    hub = prose(99, 120)
    for k in range(60):  # a large group, each a few edits from the hub and some apart from one another
        w = list(hub)
        for j in range(k % 7):
            w[(k * 13 + j * 17) % len(w)] = f"y{k}_{j}"
        docs.append((n, " ".join(w)))
        n += 1
    return docs + [(1, ""), (2, None), (3, " \t\n"), (4, "one"), (5, "one"), (6, "ONE"), (7, "one two three four"), (8, "one two three four five")]


def test_against_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_nulls_repeated_rows_and_clashing_columns(spark):
    text = " ".join(prose(1, 40))
    rows = [(1, text, 9, "x"), (1, text, 9, "x"), (2, text, 9, "y"), (None, text, 9, "z"), (3, None, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long, band string")
    out = minhash.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)], key=str)
    left = minhash.deduplicated(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.component_id, r.band) for r in left.collect()), key=str) == sorted([(1, 9, "x"), (None, 9, "z"), (3, 9, None)], key=str)


def test_two_texts_under_one_id(spark):
    x, y, z = (prose(s, 60) for s in (41, 42, 43))
    near = lambda w: " ".join([*w[:30], "changed", *w[31:]])
    rows = [(1, " ".join(x)), (1, " ".join(y)), (2, near(x)), (3, near(y)), (4, " ".join(z)), (4, ""), (5, near(z)), (5, near(x)), (6, " ".join(prose(44, 60))), (6, None), (7, " ".join(prose(45, 60)))]
    rows += [(11, " ".join(prose(46, 60))), (10, " ".join(prose(46, 60))), (11, " ".join(prose(47, 60))), (11, ""), (12, near(prose(47, 60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shuffled in (df, df.orderBy(F.desc("doc_id"), F.desc("text"))):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(shuffled).collect())
        roots = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 10: 10, 11: 10, 12: 10}
        assert got == sorted((d, roots[d], roots[d] == d) for d, _ in rows)
    assert sorted(r.doc_id for r in minhash.deduplicated(df).collect()) == [1, 6, 7, 10]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_fill_and_estimate():
    sets = [set(range(0, 400)), set(range(100, 500)), {7}, set()]
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 600, dtype=np.uint64)
    g = np.concatenate([np.sort(h[sorted(s)]) for s in sets]) if sets else h
    at = np.cumsum([0, *map(len, sets)])
    s = minhash.sketches(g, at, 512, 1)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == 0).all()
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.1


def test_one_very_long_text():
    text = " ".join(prose(5, 60_000))
    (lo, g, at), = list(minhash.shingle_sets(pa.array([text])))
    assert lo == 0 and at[1] == len(g) == len(shingles(text))


def test_components_of_chains_and_loops(spark):
    chain = [(i + 1, i) for i in range(100, 140)] + [(5, 5), (7, 6), (6, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"))[0].collect()))
    groups = defaultdict(set)
    for k, v in got.items():
        groups[v].add(k)
    assert groups == {100: set(range(100, 141)), 5: {5}, 6: {6, 7}}


def test_crowded_buckets_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most_pairs in (0, 30):  # all buckets that stars leave open are crowded, or some
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, most_pairs).collect()}
        assert got == brute(docs)


def test_a_passage_in_all_documents_makes_few_pairs(spark):
    r = random.Random(8)
    passage = prose(1000, 60)
    texts = [" ".join(passage + prose(2000 + i, r.randint(50, 70))) for i in range(300)]
    near = [" ".join(t.split()[:-3]) for t in texts[:20]]  # similar enough to the first 20
    docs = list(enumerate(texts + near))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in docs}
    (batch,) = list(minhash._sets(iter([pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})])))
    members = spark.createDataFrame([(i, i, len(sets[i])) for i in sets], "c long, root long, n long")
    rows = [(i, s) for i, s in enumerate(batch.column("set").to_pylist())]
    pairs = {(p.a, p.b) for p in minhash._by_rarest(members, spark.createDataFrame(rows, "c long, set array<long>")).collect()}
    assert pairs >= {(i, 300 + i) for i in range(20)} and len(pairs) < 60  # of 51,040
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df, 0).collect()}
    assert got == brute(docs)


def test_deduplicated_with_clashing_columns(spark):
    """Columns named as what the operator itself might add."""
    text = " ".join(prose(1, 30))
    rows = [(1, text, 7, 8, 9, "r", 0), (2, text, 7, 8, 9, "r", 0), (3, "other words", 1, 2, 3, None, 1), (3, "another text", 4, 5, 6, "q", 2), (None, text, 0, 0, 0, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __rank int, __n int, n int, rank string, kept int")
    got = minhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_the_finer_sketch_lets_pairs_at_the_threshold_pass():
    """Differing bits of pairs of similarity 0.75 have the mean and deviation that DIFFER stands on."""
    r = np.random.default_rng(2)
    differ = []
    for n in (40, 200, 1000):
        for _ in range(120):
            shared = r.integers(1, 2**63, 3 * n // 4 * 4 // 4, dtype=np.uint64)
            own = len(shared) // 3 // 2  # shared / (shared + both own) = 0.75
            a, b = (np.sort(np.concatenate([shared, r.integers(1, 2**63, own, dtype=np.uint64)])) for _ in range(2))
            at = np.array([0, len(a), len(a) + len(b)])
            bits = minhash.tb.mix(minhash.sketches(np.concatenate([a, b]), at, minhash.BITS, 2)) & np.uint64(1)
            differ.append(int((bits[0] != bits[1]).sum()))
    mean, deviation = minhash.BITS / 8, np.sqrt(minhash.BITS / 8 * 7 / 8)
    assert abs(np.mean(differ) - mean) < deviation / 2 and np.std(differ) < 1.1 * deviation
    assert mean + 7 * deviation <= minhash.DIFFER + 0.5 and max(differ) < minhash.DIFFER
