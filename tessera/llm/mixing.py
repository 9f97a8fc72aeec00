"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words in proportion to its weight, but no source is read more than ``epochs``
times. Sources that would be are clamped at that limit and what they can't use is shared out again by weight, until
none is above. With the sources in the order of limit / weight, those clamped are a prefix, so the fixed point of
that loop is found by two running sums over one row per source.

A target is made of whole repetitions of every document and a fractional one. For the latter the documents of a
source stand in a seeded order and are taken until the fraction is full; the document at the edge is taken in part.
The running sum in that order is cut into buckets of the order's key, so a source with a third of all rows is dealt
over thousands of groups and is never sorted by one task. Documents without words take no place in the order.

:func:`mix` says what is taken of each document, :func:`mixed` makes the corpus: every row as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, table, written

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source (source, source_size) to (source, source_size, target).

    The windows without a key run over one row per source, already summed. A source of size 0 has target 0, and so
    has every source if all are empty.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last())
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    above = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(above)
    leveled = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap").cast("double") / F.col("w"), "level"))).over(everything)
    leveled = leveled.withColumn("level", free["level"])
    return leveled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _placed(rows: DataFrame, weights: tuple[int, ...], epochs: int, seed: int, once: bool) -> DataFrame:
    """Rows (doc_id, source, size, ...) with source_size, target, whole and extra. ``once`` writes them first, so that
    what makes the sizes is computed once; else they are computed twice."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), F.col("size").cast("string")).cast("binary"))
    # rows of one id and size stand by ``tie``, where they have it
    rows = rows.withColumn("k", key).withColumn("bucket", F.substring("k", 1, 3))
    rows = written(rows, "sizes") if once else rows
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    aims = targets(cells.groupBy("source").agg(F.sum("held").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("whole", whole)
    aims = aims.withColumn("need", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "t")
    before = F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")
    cells = cells.withColumn("before", before).withColumnsRenamed({"source": "s", "bucket": "b"}).drop("held")
    cells = cells.join(aims, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    inside = Window.partitionBy("source", "bucket").orderBy("k", "doc_id", "size", *["tie"] * ("tie" in rows.columns)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.where("size > 0").withColumn("upto", F.sum("size").over(inside))
    placed = summed.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    left = F.col("need") - F.col("before") - (F.col("upto") - F.col("size"))
    placed = placed.withColumn("extra", F.least(F.greatest(left, F.lit(0).cast("long")), F.col("size"))).drop("upto", "s", "b", "before")
    empty = rows.where("size = 0").join(aims, F.col("source").eqNullSafe(F.col("t"))).drop("t").withColumn("extra", F.lit(0).cast("long"))
    return placed.unionByName(empty).drop("k", "bucket", "need")


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` (doc_id, source) to doc_id, source, size, source_size, target, whole, extra, taken.

    ``whole`` is how often the document is taken entire, ``extra`` how many of its words the fractional repetition
    takes besides, from its start. Null sources are one source, the last. Equal rows share whatever they take in
    unspecified, but equal, places. Other columns of ``docs`` are left out; an empty table gives an empty result.
    """
    placed = _placed(docs.select("doc_id", "source", size.alias("size")), weights, epochs, seed, once=True)
    return placed.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The corpus that :func:`mix` plans for ``docs`` (doc_id, source, text, ...): all columns, a row for each whole
    repetition and one, of the first ``extra`` words, for the fractional one, and ``copy``, from 1. A document that is
    cut has its words joined by single spaces and ``n_chars``, where there is such a column, counted anew."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    row = F.struct(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)))
    placed = _placed(docs.select("doc_id", "source", words(F.col("text")).alias("size"), row.alias("row"), F.xxhash64("text").alias("tie")), weights, epochs, seed, once=False)
    times = F.col("whole") + F.when((F.col("extra") > 0) & (F.col("size") > 0), 1).otherwise(0)
    copies = placed.where(times > 0).select("row", "whole", "extra", "size", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))
    cut = (F.col("copy") > F.col("whole")) & (F.col("extra") < F.col("size"))
    text, chars = names[docs.columns.index("text")], names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    copies = copies.select(*(F.col("row")[n].alias(n) for n in names), "copy", "extra", cut.alias("cut"))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("extra"), F.lit(1)).cast("int")), " ")
    copies = copies.withColumn(text, F.when(F.col("cut"), first).otherwise(F.col(text)))
    if chars:
        copies = copies.withColumn(chars, F.when(F.col("cut"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return copies.select(*names, "copy").toDF(*docs.columns, "copy")


def op6_mixing(spark, sf_dir):
    """What the mix takes of each row of ``documents``; a null text has no words, null sources are one source."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}:' || coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, source_size * {EPOCHS} AS cap,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()
                - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT)::DOUBLE
                / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS level
      FROM r),
f AS (SELECT arg_min(level, cap::DOUBLE / w) AS level FROM l WHERE cap >= level * w),
t AS (SELECT source, source_size, least(cap::DOUBLE, f.level * w) AS target FROM l, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.doc_id, d.source, d.size, n.source_size, n.target, n.whole,
             floor(n.target + 0.5)::BIGINT - n.whole * n.source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(greatest(need - (upto - size), 0), size))::BIGINT AS taken
FROM c
"""
