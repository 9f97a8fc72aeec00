import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def brute(rows, query):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float64)
    q = dict(rows)[query]
    s = m @ q / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))
    s[ids == query] = -9
    order = np.lexsort((ids, -np.round(s, 12)))[: min(5, len(ids) - 1)]
    return [(int(ids[k]), s[k]) for k in order]


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_POINTS", 500)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(1500, 24)).astype(np.float32)
    m[1000:1400] = m[7]  # a very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    hits = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        expected = brute(rows, q)
        assert [k for k, *_ in own] == list(range(1, len(expected) + 1))
        assert [x for _, _, x in own] == sorted((x for _, _, x in own), reverse=True)
        hits += len({v for _, v, _ in own} & {v for v, _ in expected})
        total += len(expected)
    assert hits / total >= 0.95
    hot = [r.vec_id for r in sorted((r for r in out if r.query_id == 1000), key=lambda r: r["rank"])]
    assert hot == [7, 1001, 1002, 1003, 1004]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [], 1), (None, [1.0, 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.1], 1), (50, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).collect() == []


def test_graph_is_pruned_and_reachable():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(600, 8)).astype(np.float32)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    edges, entry = ann.build(p, degree=12, beam=40)
    seen, todo = {entry}, [entry]
    while todo:
        for k in edges[todo.pop()]:
            if k < 600 and k not in seen:
                seen.add(int(k))
                todo.append(int(k))
    assert len(seen) >= 590
    kept = ann.robust_prune(p, np.array([0]), np.arange(1, 200)[None, :].copy(), 12, 1.2)[0]
    d = lambda a, b: float(2 - 2 * p[a] @ p[b])
    kept = [k for k in kept if k >= 0]
    assert all(1.44 * d(a, b) > d(0, b) for i, b in enumerate(kept) for a in kept[:i])


@pytest.mark.parametrize("spread", [0.25, 3.0])
def test_recall_on_whole_shards(spread):
    """Shards of 4,096 points, sixteen times the beam, of clustered and of even vectors."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(40, 48))[rng.integers(0, 40, ann.SHARD_POINTS + 200)] + spread * rng.normal(size=(ann.SHARD_POINTS + 200, 48))
    points, queries = m[: ann.SHARD_POINTS], m[ann.SHARD_POINTS :]
    edges, entry = ann.build(ann._unit(points))
    count, ids = np.ones(len(points), np.int64), np.full((len(points), ann.KEPT_IDS), -1, np.int64)
    ids[:, 0] = np.arange(len(points))
    shard = {"dim": 48, "ids": count.tobytes() + ids.tobytes(), "points": points.tobytes(), "edges": edges.tobytes(), "entry": entry}
    scores, found = ann._searched(shard, np.arange(-200, 0), queries)
    cosine = queries @ points.T / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(points, axis=1))
    exact = np.argsort(-cosine, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, exact, strict=True)]) >= 0.95
    assert np.allclose(scores, np.take_along_axis(cosine, found, 1))


def test_blocks_of_queries_and_shards_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)).astype(np.float32))]
    rows += [(10_000 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 5)).astype(np.float32))]  # another number of components
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    is_query = F.col("vec_id") % 10 == 0
    one = sorted(map(tuple, ann.nearest(df, is_query).collect()))
    monkeypatch.setattr(ann, "SHARD_POINTS", 150)
    assert sorted(map(tuple, ann.nearest(df, is_query, block_values=100).collect())) == one
    assert all((q >= 10_000) == (v >= 10_000) for q, _, v, _ in one) and len(one) == 82 * 5
