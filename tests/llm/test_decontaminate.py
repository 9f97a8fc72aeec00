import re

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate as dc
from tests.llm.conftest import prose

ITEMS = [(i, " ".join(prose(i, 20 + i)) + ". " + " ".join(prose(500 + i, 6)) + ".") for i in range(30)]


def index():
    return dc.Index(ITEMS)


def words_of(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def pairs_of(words):
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


def plain_leaks(docs, items):
    """The rules on whole documents, item by item and passage by passage, without an index."""
    own = [(i, t, w) for i, t in items if (w := words_of(t))]
    mean = sum(len(w) for *_, w in own) / len(own)
    df = {}
    for *_, w in own:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = set()
    for doc, text in docs:
        d = words_of(text)
        for item, body, w in own:
            tf = {x: w.count(x) for x in set(w)}
            impact = {x: np.log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in tf.items()}
            chunk = 64
            while chunk < len(w):
                chunk *= 2
            share, q = dc.whole_share(body), len(dc.parts(body)[0])
            for lo in range(0, max(1, len(d) - chunk), chunk):
                passage = d[lo : lo + 2 * chunk]
                if sum(impact[x] for x in impact.keys() & set(passage)) < 0.5 * sum(impact.values()) - 1e-9:
                    continue
                span = 2 * max(8, len(w))
                for at in range(0, max(1, len(passage) - span // 2), max(1, span // 8)):
                    window = passage[at : at + span]
                    there = pairs_of(window) | set(window)
                    part = lambda x: len(pairs_of(x) & there) / len(pairs_of(x)) if x else 1.0  # noqa: E731, B023
                    if part(w[:q]) >= 0.6 and part(w[q:]) >= 0.5 or share and part(w) >= share:
                        out.add((doc, item))
    return out


def test_search_finds_all_that_plain_scores_find():
    x = index()
    (g,) = x.groups
    rng = np.random.default_rng(0)
    for trial in range(60):
        words = [w for k in rng.choice(30, 3) for w in ITEMS[k][1].split()[: rng.integers(5, 30)]]
        h = np.unique(dc._hashes(" ".join(words)))
        at = np.searchsorted(x.terms, h)
        terms = [int(t) for t, v in zip(at, h, strict=True) if t < len(x.terms) and x.terms[t] == v]
        plain = {}
        for t in terms:
            for k, w in zip(g.item[g.at[t] : g.at[t + 1]].tolist(), g.weight[g.at[t] : g.at[t + 1]].tolist(), strict=True):
                plain[k] = plain.get(k, 0.0) + w
        for threshold in (0.2, 0.5, 0.8):
            found = {k: s for b in range(g.blocks) for k, s in g.search(terms, b, threshold)}
            assert found.keys() == {k for k, s in plain.items() if s >= threshold}
            assert all(abs(found[k] - plain[k]) < 1e-9 for k in found)
        reached = {b for _, b in g.candidates(np.zeros(len(terms), np.int64), np.array(terms), 1)}
        assert reached >= {k // dc.BLOCK for k, s in plain.items() if s >= dc.THRESHOLD}


def mixed_documents():
    """Documents with whole, cut, scattered and edited copies of items of very different lengths, and common words."""
    rng = np.random.default_rng(7)
    items = [(i, "of the and " + " ".join(prose(i, int(n))) + (". Then it is so. " if i % 2 else " the of ") + " ".join(prose(900 + i, int(n) // 6 + 2))) for i, n in enumerate([1, 4, 12, 30, 50, 61, 70, 120, 200, 300, 700])]
    docs = []
    for i in range(60):
        words = prose(5000 + i, int(rng.integers(1, 900))) + ["the", "of", "and"] * 5
        for _ in range(2):
            w = items[int(rng.integers(len(items)))][1].split()
            cut = w[int(len(w) * rng.choice([0, 0, 0.1, 0.3])) : int(len(w) * rng.choice([1, 1, 0.9, 0.6])) or 1]
            cut = [x if rng.random() > rng.choice([0, 0.05, 0.2]) else "changed" for x in cut]
            step = int(rng.choice([1, 1, 1, 5]))  # pieces of it scattered over the document
            spread = [x for k in range(0, len(cut), 6) for x in cut[k : k + 6] + words[k : k + 6 * (step - 1)]]
            at = int(rng.integers(len(words)))
            words[at:at] = spread
        docs.append((i, " ".join(words)))
    return docs + [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1])], items


def test_leaks_agree_with_the_rules_on_whole_documents(spark):
    docs, items = mixed_documents()
    expected = plain_leaks(docs, items)
    assert 20 < len(expected) < 150 and {i for _, i in expected} >= {3, 4, 7, 10}
    df, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(df, own).collect()} == expected
    assert {r.doc_id for r in dc.without_leaks(df, own).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_other_items_and_rounds_have_no_say(spark):
    docs, items = mixed_documents()
    spread = [x for k, w in enumerate(items[4][1].split()) for x in [w, *prose(8000 + k, 60)]]
    docs.append((200, " ".join(spread)))  # an item's words, far apart
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda rows, **o: {(r.doc_id, r.item_id) for r in dc.leaks(df, spark.createDataFrame(rows, "item_id long, text string"), **o).collect()}
    alone = found(items)
    assert not any(d == 200 for d, _ in alone)
    assert found([*items, (99, " ".join(prose(77777, 5000)))]) == alone
    assert found(items, round_bytes=2000) == alone


def test_one_index_at_a_time(spark, monkeypatch):
    """Ten rounds and more give what one gives, with one broadcast index alive at any time."""
    docs, items = mixed_documents()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, key int")
    own = spark.createDataFrame(items, "item_id long, text string")
    small = sum(len(t) for _, t in items) // 11
    assert dc.rounds_of(own, small) >= 10
    live, most, made, kind = set(), [0], [0], type(spark.sparkContext.broadcast(0))
    broadcast, destroy = type(spark.sparkContext).broadcast, kind.destroy

    def count(self, value):
        out = broadcast(self, value)
        if isinstance(value, dc.Index):
            live.add(id(out))
            made[0] += 1
            most[0] = max(most[0], len(live))
        return out

    def end(self, *args):
        live.discard(id(self))
        destroy(self, *args)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", count)
    monkeypatch.setattr(kind, "destroy", end)
    found = {(r.doc_id, r.item_id) for r in dc.leaks(df, own, small).collect()}
    clean = dc.without_leaks(df, own, small)
    left = clean.collect()
    assert most == [1] and made[0] >= 10 and not live
    assert found == {(r.doc_id, r.item_id) for r in dc.leaks(df, own).collect()}
    assert clean.columns == df.columns
    assert {r[0] for r in left} == {d for d, _ in docs} - {d for d, _ in found}


def test_very_long_text_and_repeated_rows(spark):
    long = prose(1, 60_000)
    long[41_000:41_000] = ITEMS[9][1].split()
    docs = spark.createDataFrame([(1, " ".join(long)), (2, ITEMS[9][1]), (2, ITEMS[9][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()) == [(1, 9), (2, 9), (2, 9)]


def test_leaks_in_any_place(spark):
    docs, expected = [], set()
    for i in range(40):
        words = prose(9000 + i, 40 * (i % 9))
        if i % 3 == 0:
            item, text = ITEMS[i % 30]
            w = text.upper().split() if i % 2 else text.split("\n")
            if i % 4 == 0:
                w = " ".join(w).split()
                w[len(w) // 2] = "changed"
            words[i % (len(words) + 1) : 0] = w
            expected.add((i, item))
        if i % 3 == 1:  # half an item is no leak
            words += ITEMS[i % 30][1].split()[:8]
        docs.append((i, " ".join(words), 1))
    docs += [(100, None, 1), (101, "", 1), (None, ITEMS[0][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (None, "x y z"), (77, None), (78, "!!"), ITEMS[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(df, items).collect()}
    assert got == expected | {(None, 0)}
    assert {r.doc_id for r in dc.without_leaks(df, items).collect()} == {d for d, *_ in docs if d is not None} - {d for d, _ in expected}


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert dc.leaks(docs, items.limit(0)).collect() == [] and dc.leaks(docs.limit(0), items).collect() == []
    assert dc.without_leaks(docs, items.limit(0)).count() == 1


def test_parts():
    q, a = dc.parts("What is it that all of them were looking for then? It is a thing of some kind.")
    assert len(q) == 11 and len(a) == 7
    assert [len(x) for x in dc.parts("What is it? It is a thing of some kind.")] == [5, 5]
    q, a = dc.parts("Question: one two three four five six seven\nAnswer: eight nine ten eleven twelve")
    assert len(a) == 5
    assert [len(x) for x in dc.parts("one")] == [0, 1]
    assert list(index().leaks(pa.array([None, "", "..."], pa.string()))) == []


def test_copies_that_stop_early_or_are_edited_in_the_tail(spark):
    bare = [(100 + i, " ".join(prose(300 + i, 20 + i))) for i in range(30)]  # no sentence stands for an answer
    docs, expected = [], set()
    for i, text in ITEMS + bare:
        w, around = text.split(), prose(7000 + i, 40)
        edited = list(w)
        edited[-2] = edited[-4] = "changed"
        copies = [w[: -(len(w) // 6)], edited, w[: len(w) // 2]]
        copies += [w[: -(len(w) // 3)], w[len(w) // 4 :]] if i >= 100 else []
        for k, copy in enumerate(copies):
            docs.append((10 * i + k, " ".join(around[:20] + copy + around[20:])))
            if k != 2:  # half an item is no leak
                expected.add((10 * i + k, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + bare, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(df, items).collect()} == expected
    assert {r.doc_id for r in dc.without_leaks(df, items).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_a_marked_answer_must_be_there(spark):
    question, answer = " ".join(prose(1, 40)), " ".join(prose(2, 6))
    items = spark.createDataFrame([(1, f"{question}\nAnswer: {answer}"), (2, " ".join(prose(3, 40)) + "\nAnswer:")], "item_id long, text string")
    docs = [(1, f"{question} {answer}"), (2, question), (3, " ".join(prose(3, 40)[:34]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(df, items).collect()} == {(1, 1), (3, 2)}
