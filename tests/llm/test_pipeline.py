from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, minhash, mixing, pii
from tests.llm.conftest import SF, prose


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.written(stage(spark, before, SF), "test")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if k < 4:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 1:
            assert ids == {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
        if k == 2:
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaked = {r.doc_id for r in decontaminate.leaks(before, items).collect()}
            assert ids == {r.doc_id for r in before.collect()} - leaked
        if k == 3:
            assert all(not pii.find(r.text) or "[" in r.text for r in after.collect())
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        if k == 4:
            assert after.columns == [*docs.columns, "copy"]
            took = {r.doc_id: r.words for r in after.groupBy("doc_id").agg(F.sum(mixing.words(F.col("text"))).alias("words")).collect()}
            assert took == {r.doc_id: r.taken for r in mixing.mix(before, mixing.words(F.col("text"))).collect() if r.taken}
        before = after
    assert sorted(corpus_pipeline.run(spark, SF).collect(), key=str) == sorted(before.collect(), key=str)


def test_nulls_extra_columns_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"
    good = " ".join(prose(1, 50))
    rows = [(1, good, None, None, None, 1.0, 2), (2, None, "en", "a", 0, None, 2), (None, good, "en", "a", 5, 1.0, 2), (3, "", "en", "a", 0, 1.0, 2), (1, good, None, None, None, 1.0, 2)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = corpus_pipeline.written(stage(spark, df, SF), "test")
            if k < 4:
                assert df.columns == [c.split()[0] for c in schema.split(", ")]


def test_very_long_texts_and_repeated_ids(spark):
    good = next(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("n_chars")).collect() if not pii.find(r.text))
    long = "\n".join(f"{good} {i}" for i in range(40))
    rows = [(1, long, "en", "a", len(long)), (1, good, "en", "b", len(good)), (2, long + " x", "en", None, len(long) + 2), (3, "a@b.example 1.2.3.4 " + good, "en", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_duplicates(spark, df, SF)
    assert sorted(r.doc_id for r in near.collect()) == [1]  # the row of 1 that is like 3 links it, that like 2 too
    found = {r.text for r in corpus_pipeline.personal_data(spark, df, SF).collect()}
    assert found == {long, good, long + " x", "[EMAIL] [IP] " + good}
    out = corpus_pipeline.source_mixing(spark, df, SF).collect()
    size = lambda t: len(t.split())
    assert abs(sum(size(r.text) for r in out) - sum(size(t) for _, t, *_ in rows)) <= 3
    assert all(r.n_chars == len(r.text) for r in out if r.text not in (long, good, long + " x") and r.doc_id != 3)
