"""Divergence of sources against the contract's own words in plain Python, and the tries it stands on."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import tries
from tessera.llm.tries import Trie, shares
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, key long, rank int"


def plain(rows, least=10):
    rows = [tuple(x or "" for x in r) for r in rows]  # lang, source, text
    words = [TERM.findall(t.translate(SMALL)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(r[1], w) for r, w in zip(rows, words) if r[0] == lang]
        df, count = Counter(), defaultdict(Counter)
        for source, w in own:
            df.update(set(w))
            count[source].update(w)
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(n) for s, n in count.items()}, share(sum(count.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= 10]
    return sorted(out)


def rows(seed=1, n=150):
    r = random.Random(seed)
    words = [*prose(3, 40), "Éa", "éa", "日本", "x", "ÀB", "don't", "a1b"]
    out = [(r.choice(["en", "fr", None, "none"]), r.choice(["s0", "s0", "s1", "é", None]), " ".join(r.choice(words).capitalize() for _ in range(r.randint(0, 30)))) for _ in range(n)]
    return [*out, ("zz", "only", "few words"), ("zz", "other", None), ("zz", None, ""), ("one", "alone", "1 2 3"), *out[:5]]


def frame(spark, data):
    return spark.createDataFrame([(k, t, lang, s, 1, 2) for k, (lang, s, t) in enumerate(data)], SCHEMA)


def test_equals_the_contract(spark):
    data = rows()
    assert sorted(map(tuple, tries.divergences(frame(spark, data).repartition(7)).collect())) == plain(data)


@pytest.mark.parametrize("name, value", [("TERMS", 5), ("LEAVES", 3), ("CELLS", 4), ("MERGED", 1), ("DEPTH", 1)])
def test_small_limits_change_nothing(spark, monkeypatch, name, value):
    monkeypatch.setattr(tries, name, value)
    data = rows(2, 90)
    df = frame(spark, data).repartition(5)
    assert sorted(map(tuple, tries.divergences(df, 4).collect())) == plain(data, 4)


def test_sql_says_the_same(spark):
    data = rows(4)
    con = duckdb.connect()
    documents = frame(spark, data).toPandas()  # noqa: F841
    con.sql("CREATE TABLE t AS SELECT * FROM documents")
    got = con.sql(tries.OP11_SQL.replace("FROM documents", "FROM t")).fetchall()
    assert sorted(map(tuple, got)) == plain(data)


def test_empty_tables_and_no_terms(spark):
    assert tries.divergences(frame(spark, [])).count() == 0
    got = tries.divergences(frame(spark, [("a", "x", None), ("a", "y", "1"), (None, "z", "w")])).collect()
    assert sorted((r.source, r.item, r.value, r.rank) for r in got) == [("x", "y", 0, 1), ("y", "x", 0, 1)]


def test_tries_merge_cut_and_survive_being_written():
    r = random.Random(2)
    terms = sorted({w.encode() for w in prose(5, 300)} | {"é".encode(), "日本語".encode(), b"a", b"ab", b"abc" * 200})
    want: Counter = Counter()
    parts = []
    for _ in range(6):
        some = r.sample(range(len(terms)), 80)
        source, n = [r.randint(-(2**62), 2**62) if r.random() < 0.05 else r.randint(0, 3) for _ in some], [r.randint(1, 9) for _ in some]
        want.update({(terms[i], s): v for i, s, v in zip(some, source, n)})
        parts.append(Trie.load(Trie.of(terms, np.array(some), np.array(source), np.array(n), np.ones(80, np.int64)).dump()))
    whole = Trie.merged(parts)
    assert whole.terms == sorted(whole.terms) and int(whole.docs.sum()) == 480
    counters = Counter({(whole.terms[leaf], int(s)): int(v) for leaf, s, v in zip(np.repeat(np.arange(len(whole.k)), whole.k), whole.source, whole.n)})
    assert counters == want
    cut = list(whole.subtries(2))
    assert [p for p, _ in cut] == sorted({t[:2] for t in whole.terms}) and [t for _, x in cut for t in x.terms] == whole.terms
    assert Trie.merged([x for _, x in cut]).n.tolist() == whole.n.tolist()


def test_shares_are_exact_at_any_size():
    r = random.Random(1)
    for _ in range(500):
        total, kept = r.randint(0, 10 ** r.randint(1, 15)), r.randint(1, 10**6)
        n = r.randint(0, total)
        assert shares(np.array([n]), total, kept)[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)
