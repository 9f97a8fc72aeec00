import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import bm25, kept, meta
from tessera.sources import store as S
from tessera.sources.store import Change, Conflict, Layout, Store
from tessera.streaming import status

SCHEMA = StructType().add("id", "long").add("text", "string").add("bucket", "integer").add("comes", "string")


def layout(**more):
    return Layout(SCHEMA, ("id",), **({"buckets": 4} | more))


def rows(spark, some):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in some], SCHEMA)


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "id long")


def held(snapshot, name="t"):
    return {r.id: r.text for r in snapshot.table(name).collect()}


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_random_batches_agree_with_a_dictionary(spark, root):
    rng, store, plain, seen = random.Random(3), Store.create(spark, root, {"t": layout()}), {}, [{}]
    for n in range(5):
        new = {rng.randrange(40): f"{n}.{rng.randrange(9)}" for _ in range(rng.randrange(25))}
        out = [rng.randrange(40) for _ in range(rng.randrange(12))]
        store.commit({"t": Change(rows(spark, new.items()), ids(spark, out))})
        plain = {i: t for i, t in plain.items() if i not in out} | new
        seen.append(dict(plain))
    assert store.versions() == list(range(6))
    assert [held(Store(spark, root).snapshot(v)) for v in range(6)] == seen


def test_nulls_ties_repeats_and_columns(spark, root):
    store = Store.create(spark, root, {"t": layout(newest=("bucket",))})
    some = spark.createDataFrame([(1, "a", 1, "x"), (1, "c", 2, "x"), (1, "b", 2, "x"), (None, "n", 9, "x"), (2, None, None, None), (3, "", 1, None)], SCHEMA)
    got = store.commit({"t": Change(some.withColumn("more", F.lit(1)))})
    assert held(got) == {1: "c", 2: None, 3: ""}
    assert held(store.commit({"t": Change(spark.createDataFrame([(3,)], "id int"))})) == {1: "c", 2: None, 3: None}  # missing columns
    assert held(store.commit({"t": Change(gone=spark.createDataFrame([(1,), (None,), (77,)], "id int"))})) == {2: None, 3: None}
    assert held(store.commit({"t": Change(rows(spark, []), ids(spark, []))})) == {2: None, 3: None}
    assert held(store.commit({"t": Change(gone=ids(spark, [2, 3]))})) == {} and store.snapshot().live("t") == {}
    with pytest.raises(ValueError):
        store.commit({"t": Change()})
    with pytest.raises(ValueError):
        store.commit({"t": Change(spark.range(1).toDF("other"))})
    with pytest.raises(FileExistsError):
        Store.create(spark, root, {"t": layout()})
    with pytest.raises(FileNotFoundError):
        store.snapshot(99)


def test_a_change_writes_only_the_buckets_it_touches(spark, root):
    store = Store.create(spark, root, {"t": layout(buckets=16), "u": layout()})
    first = store.commit({"t": Change(rows(spark, [(i, "a") for i in range(200)])), "u": Change(rows(spark, [(1, "u")]))})
    second = store.commit({"t": Change(rows(spark, [(7, "b")]))})
    moved = [b for b in first.live("t") if first.live("t")[b] != second.live("t")[b]]
    assert len(moved) == 1 and first.live("u") == second.live("u")
    assert held(second)[7] == "b" and held(first)[7] == "a" and len(held(second)) == 200
    looked = second.of("t", ids(spark, [7, 999]))
    assert [r.text for r in looked.collect()] == ["b"]
    assert len({f.rsplit("/", 2)[1] for f in looked.inputFiles()}) <= 2


def test_a_write_cut_short_leaves_the_old_state(spark, root, monkeypatch):
    store = Store.create(spark, root, {"t": layout(), "u": layout()})
    store.commit({"t": Change(rows(spark, [(1, "a")])), "u": Change(rows(spark, [(1, "a")]))})
    real, calls = Store._dealt, []

    def cut(self, df, own):
        calls.append(1)
        if len(calls) == 2:  # the first table's files are there
            raise RuntimeError("lost")
        return real(self, df, own)

    monkeypatch.setattr(Store, "_dealt", cut)
    both = {"t": Change(rows(spark, [(1, "b"), (2, "b")])), "u": Change(rows(spark, [(1, "b")]))}
    with pytest.raises(RuntimeError):
        store.commit(both)
    monkeypatch.undo()
    now = Store(spark, root).snapshot()
    assert now.version == 1 and held(now) == held(now, "u") == {1: "a"}

    @F.udf("string")
    def fails(x):
        raise ValueError("task")

    with pytest.raises(Exception, match="task"):
        store.commit({"t": Change(rows(spark, [(1, "b")]).withColumn("text", fails("text")))})
    assert held(store.snapshot()) == {1: "a"}
    assert store.vacuum(keep=1, older=-60) == 1 and held(store.snapshot()) == {1: "a"} and store.versions() == [1]
    assert held(store.commit(both)) == {1: "b", 2: "b"}


def others(monkeypatch, change):
    """Another writer commits just before the first manifest of this one."""
    real, met = Store._publish, []

    def publish(self, manifest):
        if not met:
            met.append(1)
            change()
        return real(self, manifest)

    monkeypatch.setattr(Store, "_publish", publish)


def test_two_writers_lose_nothing(spark, root, monkeypatch):
    store = Store.create(spark, root, {"t": layout()})
    store.commit({"t": Change(rows(spark, [(i, "a") for i in range(20)]))})
    others(monkeypatch, lambda: Store(spark, root).commit({"t": Change(rows(spark, [(1, "b"), (30, "b")]), ids(spark, [2]))}))
    got = store.commit({"t": Change(rows(spark, [(3, "c"), (1, "c")]), ids(spark, [4]))})
    assert got.version == 3
    assert held(got) == {i: "a" for i in range(20) if i not in (2, 4)} | {1: "c", 3: "c", 30: "b"}


def test_what_was_read_must_not_have_changed(spark, root, monkeypatch):
    store = Store.create(spark, root, {"t": layout(), "u": layout()})
    since = store.snapshot()
    others(monkeypatch, lambda: Store(spark, root).commit({"u": Change(rows(spark, [(1, "b")]))}))
    with pytest.raises(Conflict):
        store.commit({"t": Change(rows(spark, [(1, "a")]))}, since=since)
    assert held(store.snapshot()) == {} and held(store.snapshot(), "u") == {1: "b"}


def test_dealt_anew_while_another_writes(spark, root, monkeypatch):
    store = Store.create(spark, root, {"t": layout()})
    store.commit({"t": Change(rows(spark, [(i, "a") for i in range(50)]))})
    others(monkeypatch, lambda: Store(spark, root).rebucket("t", 9))
    got = store.commit({"t": Change(rows(spark, [(3, "c")]))})
    assert got.layout("t").buckets == 9 and held(got) == {i: "a" for i in range(50)} | {3: "c"}
    assert len(got.live("t")) > 4


def test_a_batch_that_comes_again_changes_nothing(spark, root):
    store = Store.create(spark, root, {"t": layout()})
    store.commit({"t": Change(rows(spark, [(1, "a")]))}, source="s", batch=0)
    store.commit({"t": Change(rows(spark, [(1, "b")]))}, source="s", batch=1)
    again = store.commit({"t": Change(rows(spark, [(1, "z")]))}, source="s", batch=1)
    assert again.version == 2 and held(again) == {1: "b"}
    assert held(store.commit({"t": Change(rows(spark, [(1, "y")]))}, source="r", batch=0)) == {1: "y"}


def test_an_index_is_kept(spark, root):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, " "), (None, "a")], "doc_id long, text string")
    index = kept.KeptIndex.create(spark, root, buckets=4)
    index.upsert(docs)
    index.upsert(spark.createDataFrame([(2, "d d"), (4, "e a")], "doc_id long, text string"))
    index.upsert(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "a b d")], "qid long, query string")
    key = lambda i: sorted((r.id, r["rank"], round(r.score, 9)) for r in bm25.search(i, asked).collect())
    plain = lambda some: key(bm25.Index.build(spark.createDataFrame(some, "doc_id long, text string")))
    again = kept.KeptIndex.open(spark, root)
    assert key(again.index()) == plain([(2, "d d"), (4, "e a")])
    assert key(again.index(2)) == plain([(1, "a b a"), (2, "d d"), (4, "e a")])
    again.delete(ids(spark, [2]))
    assert key(index.index()) == plain([(4, "e a")])


def test_a_stream_runs_on_from_its_checkpoint(spark, root, tmp_path):
    events = StructType().add("event_id", "long").add("user_id", "long").add("event_type", "string").add("value", "double").add("ts", "timestamp")
    add = lambda some: spark.createDataFrame(some, "event_id long, user_id long, event_type string, value double, s long").select("event_id", "user_id", "event_type", "value", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add([(1, 1, "a", 0.0, 10), (2, 2, "a", 0.0, 11)])
    newest = status.latest_status(spark.readStream.schema(events).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    store = Store.create(spark, root, {"status": Layout(newest.schema, ("user_id",), newest=("at",), buckets=4)})
    run = lambda: {r.user_id: r.status for r in status.upserted(newest, store, "status", f"{tmp_path}/state").table("status").collect()}
    assert run() == {1: "a", 2: "a"}
    known = store.versions()
    assert run() == {1: "a", 2: "a"} and store.versions() == known  # nothing came
    add([(3, 1, "b", 0.0, 20), (4, 2, "old", 0.0, 5), (5, 3, "c", 0.0, 1)])
    assert run() == {1: "b", 2: "a", 3: "c"}
    assert store.commit({"status": Change(gone=spark.createDataFrame([(1,)], "user_id long"))}, source="stream", batch=0).version == store.versions()[-1]  # a batch of before
    assert run() == {1: "b", 2: "a", 3: "c"}


def test_documents_that_arrive_are_indexed_once(spark, root, tmp_path):
    index, folder = kept.KeptIndex.create(spark, root, id_type="string", buckets=4), tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two")
    took = lambda rows, batch: index.upsert(rows, "file_name", source="files", batch=batch)
    run = lambda: status.ingest(spark, str(folder), took, f"file://{tmp_path}/state").awaitTermination()
    run()
    (folder / "b.txt").write_text("two")
    run()
    took(spark.createDataFrame([("a.txt", "again")], "file_name string, text string"), 0)
    assert sorted((r.id, r.term) for r in index.index().postings.collect()) == [("a.txt", "one"), ("a.txt", "two"), ("b.txt", "two")]


def test_a_cascade_is_one_version(spark, root, monkeypatch):
    docs = spark.createDataFrame([(1, "x", "active"), (2, "x", "active"), (3, "y", "active")], "document_id long, category string, status string")
    of = lambda n: docs.select("document_id", F.explode(F.array_repeat(F.lit(n), 2)).alias("what"))
    t = meta.Tables(docs, of("c"), of("h"), of("p"), spark.createDataFrame([("x",), ("y",)], "name string"), of("v"))
    store = kept.keep(spark, root, t, buckets=4)
    after = kept.tables(kept.delete_documents(store, spark.createDataFrame([(1,), (3,)], "document_id long")))
    for name in ("documents", "chunks", "hashes", "postings", "vectors"):
        assert {r.document_id for r in getattr(after, name).collect()} == {2}, name
    assert after.chunks.count() == 2 and [r.name for r in after.categories.collect()] == ["x"]
    assert store.versions() == [0, 1, 2]
    others(monkeypatch, lambda: Store(spark, root).commit({"chunks": Change(gone=spark.createDataFrame([(2,)], "document_id long"))}))
    with pytest.raises(S.Conflict):
        kept.delete_documents(store, spark.createDataFrame([(2,)], "document_id long"))
    assert kept.tables(store.snapshot()).documents.count() == 1


def test_a_delete_deals_nothing_anew(spark, root, monkeypatch):
    store = Store.create(spark, root, {"t": layout()})
    store.commit({"t": Change(rows(spark, [(i, str(i)) for i in range(200)]))})
    dealt = Store._dealt
    plans = []

    def seen(self, some, lay, **more):
        plans.append((some._jdf.queryExecution().executedPlan().toString(), more))
        return dealt(self, some, lay, **more)

    monkeypatch.setattr(Store, "_dealt", seen)
    after = store.commit({"t": Change(gone=ids(spark, range(0, 200, 3)))})
    assert plans[0][1] == {"as_read": True} and "Exchange hashpartitioning" not in plans[0][0]
    assert held(after) == {i: str(i) for i in range(200) if i % 3}
    monkeypatch.setattr(S, "BROADCAST_KEYS", 5)
    assert held(store.commit({"t": Change(gone=ids(spark, range(100)))})) == {i: str(i) for i in range(100, 200) if i % 3}
    assert plans[1][1] == {} and held(store.commit({"t": Change(gone=ids(spark, range(200)))})) == {}
