"""Properties of the pure cores, and the ranks that were worked out by hand."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunk as C
from tessera.operators import rewrite as R
from tessera.plans import catalog

WORD = st.text("abcdef", min_size=1, max_size=6)
LINES = st.lists(st.one_of(st.lists(WORD, min_size=1, max_size=30).map(" ".join), st.builds(lambda n, w: "#" * n + " " + w, st.integers(1, 6), WORD), st.just(""), st.just("```"), st.just("| a | b |"), st.just("|---|---|")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(LINES, st.integers(5, 60))
def test_chunks_hold_every_word(lines, most):
    text = "\n".join(lines)
    found = C.Chunker(C.Preset(3, most, 0.0), joiner=" ").chunks(text)
    said = " ".join(c.text for c in found).split()
    bare = {w for line in lines if not line.startswith("#") for w in line.split()}
    assert bare <= set(said)
    assert all(c.text.strip() for c in found)


@settings(max_examples=100, deadline=None)
@given(LINES, st.floats(0.0, 0.5))
def test_overlap_only_adds(lines, overlap):
    text = "\n".join(lines)
    plain = C.Chunker(C.Preset(3, 30, 0.0)).chunks(text)
    more = C.Chunker(C.Preset(3, 30, overlap)).chunks(text)
    assert len(plain) == len(more) and all(b.text.endswith(a.text) for a, b in zip(plain, more, strict=True))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(a, b):
    assert R.within_one(a, b) == (distance(a, b) <= 1)


@given(st.text("配置参数API 讲稿", max_size=20), st.dictionaries(st.sampled_from(["配置", "API", "讲稿", "稿"]), WORD, max_size=3))
def test_rules_replace_what_they_say(query, fixed):
    r = R.by_rules(query, R.Dictionaries({}, fixed, {}))
    assert (r.confidence == 0.95) == any(k in query for k in fixed)
    if not any(k in query for k in fixed):
        assert r.query == query


def test_ranks_worked_out_by_hand(spark):
    rows = sorted(catalog.bm25_search(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r["rank"])[:5]
    assert [(r.doc_id, r.score) for r in rows] == [(499, 2.09886), (583, 2.083708), (704, 2.080089), (179, 2.079049), (435, 2.076446)]
    near = [r for r in catalog.vector_knn(spark, "/root/testdata/sf0.01").where("qid = 0").collect() if r["rank"] <= 4]
    assert [(r.id, r.cosine) for r in sorted(near, key=lambda r: r["rank"])] == [(0, 1.0), (365, 0.369994), (334, 0.362722), (387, 0.331139)]
