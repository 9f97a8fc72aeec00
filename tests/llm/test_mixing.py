import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def filled(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), epochs=3):
    """Clamp and share out again, round by round."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in size if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * size[s]]
        if not over:
            return share | fixed
        fixed |= {s: float(epochs * size[s]) for s in over}


def corpus(seed, n=300):
    r = random.Random(seed)
    sources = ["b", "a", "é", "zz", None, "B", "tiny", "none"]
    return [(i, r.choices(sources, [40, 5, 10, 3, 2, 1, 0.5, 0])[0], " ".join(["w"] * r.choice([0, 1, 5, 50, 400]))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df, mixing.words(F.col("text"))).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    expected = filled(list(sizes.items()))
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.extra
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - expected[s]) <= 1
    again = mixing.mix(df.repartition(7), mixing.words(F.col("text"))).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_edges(spark):
    schema = "doc_id long, source string, text string, bucket int, target string"
    words = mixing.words(F.col("text"))
    assert mixing.mix(spark.createDataFrame([], schema), words).collect() == []
    nothing = mixing.mix(spark.createDataFrame([(1, "a", None, 1, "t"), (2, None, "", 1, "t")], schema), words).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0)] * 2
    same = mixing.mix(spark.createDataFrame([(None, "a", "x y", 1, "t")] * 3 + [(5, "b", "x", 1, "t")], schema), words).collect()
    assert len(same) == 4 and sum(r.taken for r in same) in (6, 7, 8)


def test_the_mixed_corpus_holds_what_the_plan_takes(spark):
    rows = [(i, s, t, len(t), i) for i, s, t in corpus(7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long, size int")
    plan = {r.doc_id: r for r in mixing.mix(df, mixing.words(F.col("text"))).collect()}
    out = mixing.mixed(df)
    assert out.columns == [*df.columns, "copy"]
    held = defaultdict(list)
    for r in out.orderBy("copy").collect():
        assert r.n_chars == len(r.text) and r.size == r.doc_id and r.source == plan[r.doc_id].source
        held[r.doc_id].append(r)
    for i, _, text, *_ in rows:
        p = plan[i]
        assert [r.copy for r in held[i]] == list(range(1, len(held[i]) + 1))
        assert [r.text for r in held[i][: p.whole]] == ([text] * p.whole if held[i] else [])
        if p.size:
            assert sum(len(r.text.split()) for r in held[i]) == p.taken and len(held[i]) == p.whole + (p.extra > 0)
    assert mixing.mixed(df.limit(0)).collect() == []


def test_a_null_id_in_a_third_of_the_rows_is_split(spark):
    rows = [(None if i % 3 == 0 else i, "a" if i % 2 else "b", " ".join(["w"] * (i % 50))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df, mixing.words(F.col("text"))).collect()
    assert len(out) == 900
    for s in ("a", "b"):
        assert abs(sum(r.taken for r in out if r.source == s) - next(r.target for r in out if r.source == s)) <= 1
