"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch of t coordinates is filled in rounds: in round i < t every element falls into one of the t bins by a hash of
its own, in round t + i the elements fill bin i, and a coordinate keeps the smallest (round, value) that reached it.
So every coordinate of a set that isn't empty is filled, most sets are done after a round or two, and agreement of
coordinates has at least the concentration of independent minima.

Documents with equal sets are one class from the start, and classes that share a document are linked. Classes that
agree in all coordinates of a band share a bucket. In each bucket the smallest document is tried against the others;
then, in buckets whose members are not yet in one component, the members outside the bucket's largest component are
tried against those of other components, but for pairs that set sizes rule out or that a finer sketch puts well below
the threshold. A pair is a link only if the full sets say so. Within a component no further pairs are needed, so a
large group of near copies costs a star, not a square.

A bucket that would still mean more than ``PAIRS`` trials, such as that of a passage in very many documents, is not
tried pair by pair. Sets as similar as the threshold asks share one of the rarest quarter of their shingles, so all
members of such buckets are joined on these alone, which is exact and leaves out what only common text brings together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import dropped, release, table, written
from tessera.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Bands x rows coordinates: a pair at the threshold shares no band with a chance of 5e-6.
BANDS, ROWS = 32, 4
#: Coordinates of the finer sketch, one bit of each, and how many bits may differ before a pair is not verified: a pair
#: at the threshold has 2048 * 0.125 = 256 expected, with a deviation of 15; 7 of them are allowed above, which a pair at
#: the threshold exceeds with a chance below 1e-11.
BITS, DIFFER = 2048, 361
#: Trials in a bucket, of members outside its largest component against all, beyond which its members are joined on
#: their rarest shingles.
PAIRS = 1 << 17
_U = np.uint64


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of the texts: the first row, the sorted distinct shingle hashes, text after text, and their starts."""
    for lo, hi in tb.pieces(texts):
        w = tb.words(texts.slice(lo, hi - lo), lower=True)
        h = w.hashes()
        g, doc = tb.grams(h, SHINGLE), w.doc[: max(0, len(h) - SHINGLE + 1)]
        keep = doc == w.doc[SHINGLE - 1 :] if len(g) else np.zeros(0, bool)
        g, doc = g[keep], doc[keep]
        at = tb.firsts(w.doc, w.n)
        short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SHINGLE))
        if len(short):  # the whole sequence is the one shingle; its length keeps it apart from others
            own = np.array([tb.mix(tb.grams(h[at[d] : at[d + 1]], at[d + 1] - at[d]) + _U(at[d + 1] - at[d]))[0] for d in short], _U)
            g, doc = np.concatenate([g, own]), np.concatenate([doc, short])
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[first], doc[first]
        yield lo, g, tb.firsts(doc, w.n)


def sketches(g: np.ndarray, at: np.ndarray, t: int, seed: int) -> np.ndarray:
    """Fast similarity sketches of the sets g[at[i]:at[i+1]]: an array of sets x t; a row of an empty set is 0."""
    n = len(at) - 1
    out = np.zeros((n, t), _U)
    most = _U(2**64 - 1)
    full = np.full(n * t, most)
    todo = np.flatnonzero(np.diff(at) > 0)
    left, which = g, np.repeat(np.arange(n), np.diff(at))
    for i in range(2 * t):
        if not len(todo):
            break
        h = tb.mix(left ^ _U((0x632BE59BD9B4E019 * (seed * 1000 + i + 1)) & (2**64 - 1)))
        bins = (h % _U(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = tb.mix(h) >> _U(16) | _U(i << 48)  # the round is the high part: an earlier one is smaller
        np.minimum.at(full, which * t + bins, value)
        done = (full.reshape(n, t)[todo] != most).all(axis=1)
        if done.any():
            todo = todo[~done]
            alive = np.zeros(n, bool)
            alive[todo] = True
            keep = alive[which]
            left, which = left[keep], which[keep]
    filled = np.diff(at) > 0
    out[filled] = full.reshape(n, t)[filled]
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = BANDS * ROWS
    for b in batches:
        for lo, g, at in shingle_sets(b.column("text")):
            n = len(at) - 1
            full = sketches(g, at, t, 1)
            bands = full.reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), _U)
            for r in range(ROWS):
                key = tb.mix(key * _U(0x9E3779B97F4A7C15) + bands[:, :, r])
            key = tb.mix(key + np.arange(1, BANDS + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
            total, mixed = _sums(g, at), _sums(tb.mix(g ^ _U(0xA5A5A5A5A5A5A5A5)), at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(lo, n),
                    pa.array(np.diff(at)),
                    pa.array(total.view(np.int64)),
                    pa.array(mixed.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(key.view(np.int64).ravel())),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "bands"],
            )


def _sums(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v) + 1, _U)
    np.cumsum(v, out=total[1:])
    return tb.mix(total[at[1:]] - total[at[:-1]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, g, at in shingle_sets(b.column("text")):
            total, mixed = _sums(g, at), _sums(tb.mix(g ^ _U(0xA5A5A5A5A5A5A5A5)), at)
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(mixed.view(np.int64)), sets], ["s1", "s2", "set"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, set) to (c, h0, h1, ...): the finer sketch, 64 bits a column."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            sets = b.column("set").slice(lo, 256)
            at = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))])
            full = sketches(sets.flatten().to_numpy(zero_copy_only=False).view(_U), at, BITS, 2)
            packed = np.packbits((tb.mix(full) & _U(1)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("c").slice(lo, 256), *(pa.array(np.ascontiguousarray(h)) for h in packed.T)], ["c", *_LONGS])


_LONGS = [f"h{j}" for j in range(BITS // 64)]


def _near() -> Column:
    """The finer sketches of x and y are close, and the bucket is the first that the two share."""
    differ = sum((F.bit_count(F.col(f"x.{h}").bitwiseXOR(F.col(f"y.{h}"))) for h in _LONGS[1:]), F.bit_count(F.col("x.h0").bitwiseXOR(F.col("y.h0"))))
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
    return (differ <= DIFFER) & (first == F.col("x.k"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough."""
    left, right = sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), sets.select(F.col("c").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * PERCENT).select("a", "b")


def _apart(members: DataFrame, key: str) -> DataFrame:
    """Members (key, c, root, ...) of the groups that hold several components, with the largest of these as ``main`` and
    the trials, of those outside it against all, as ``trials``."""
    per = members.groupBy(key, "root").agg(F.count(F.lit(1)).alias("held"))
    most, total = F.max(F.struct("held", "root")), F.sum("held")
    main = per.groupBy(key).agg(most["root"].alias("main"), ((total - most["held"]) * total).alias("trials"), F.count(F.lit(1)).alias("many"))
    return members.join(main.where("many > 1").drop("many"), key)


def _across(members: DataFrame, key: str, more: Column) -> DataFrame:
    """Pairs (a, b) of members, x and y, of different components in one group, of which ``more`` holds."""
    x, y = members.where(F.col("root") != F.col("main")).alias("x"), members.alias("y")
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * PERCENT) & (F.col("y.n") * 100 >= F.col("x.n") * PERCENT)
    pairs = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.root") != F.col("y.root")) & sizes & more)
    return pairs.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _by_rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (c, root, n) of different components whose sets can be as similar as PERCENT, by a join on
    the n - ceil(PERCENT of n) + 1 rarest shingles of each, two sets of that similarity having one of them in common.
    Of the first they share, no more can follow in either than makes up what both must share."""
    shingles = members.join(sets, "c").select("c", "root", "n", F.explode("set").alias("s"))
    often = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("often"))
    ordered = shingles.join(often, "s").groupBy("c", "root", "n").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("by"))
    first = F.slice("by", 1, (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int"))
    rare = ordered.select("c", "root", "n", F.posexplode(first).alias("pos", "f")).where("f.often > 1").select("c", "root", "n", "pos", F.col("f.s").alias("s"))
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return _across(_apart(written(rare, "rare"), "s"), "s", left * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT)


def _same_document(signed: DataFrame, leaders: DataFrame) -> DataFrame:
    """(doc_id, a, b, bare) for the documents whose rows differ: a row for each class b of their rows, with the smallest
    such class, a, and whether some of their rows have no words."""
    key = F.when(F.col("n_shingles") > 0, F.struct("s1", "s2"))
    per = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), (F.min("n_shingles") == 0).alias("bare"))
    mixed = per.where(F.col("lo").isNotNull() & ((F.col("lo") != F.col("hi")) | F.col("bare"))).select("doc_id", "bare")
    rows = signed.where("n_shingles > 0").select("doc_id", "s1", "s2").join(mixed, "doc_id").distinct()
    rows = rows.join(leaders.select("s1", "s2", F.col("c").alias("b")), ["s1", "s2"])
    least = rows.groupBy("doc_id").agg(F.min("b").alias("a"))
    return rows.join(least, "doc_id").select("doc_id", "a", "b", "bare")


def near_duplicates(docs: DataFrame, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id long, text) to (doc_id, n_shingles, component_id, kept), a row for each row.

    Null and empty texts have an empty set and are linked with nothing. A null doc_id is linked with nothing, its
    component_id is null and it is kept. Rows that share a doc_id count as one document, whatever their texts: what one
    of them is linked with, all are.
    """
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    signed = written(docs.mapInArrow(_signatures, schema), "signatures")
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # a class: the documents with one set; the smallest leads. Classes are numbered in the order of their leaders
    columns = ["n_shingles", "bands"]
    leaders = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("lead"), *(F.first(c).alias(c) for c in columns))
    leaders = written(leaders.orderBy("lead", "s1", "s2").withColumn("c", F.monotonically_increasing_id()), "classes")
    same = written(_same_document(signed, leaders), "same")
    shared = same.where("a < b").select("a", "b")
    members = leaders.select(F.posexplode("bands").alias("k", "band"), "c", F.col("n_shingles").alias("n"))
    pivots = members.groupBy("band").agg(F.min("c").alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    joined = written(members.join(pivots, "band"), "buckets")
    star = joined.where(F.col("c") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct()
    wanted = leaders.join(joined.select("c").distinct(), "c", "left_semi").select(F.col("lead").alias("doc_id"))
    texts = docs.join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "s1 long, s2 long, set array<long>").groupBy("s1", "s2").agg(F.min("set").alias("set"))
    release(docs.sparkSession)
    sets = written(sets.join(leaders.select("s1", "s2", "c"), ["s1", "s2"]).select("c", "set"), "sets")
    first, links = components(_confirmed(star, sets).unionByName(shared))
    release(docs.sparkSession)
    placed = joined.join(first.withColumnRenamed("id", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    open_ = written(_apart(placed.drop("pivot"), "band").withColumn("k", F.col("k") + 1), "open")
    few = open_.where(F.col("trials") <= most_pairs)
    fine = sets.join(few.select("c").distinct(), "c", "left_semi").mapInArrow(_fine, ", ".join(["c long", *(f"{h} long" for h in _LONGS)]))
    fine = written(fine.join(leaders.select("c", "bands"), "c"), "fine")
    rest = _across(few.join(fine, "c"), "band", _near())
    crowded = open_.where(F.col("trials") > most_pairs).select("c", "root", "n").distinct()
    if not crowded.isEmpty():
        rest = rest.unionByName(_by_rarest(crowded, sets)).distinct()
    rest = rest.join(star, ["a", "b"], "left_anti")
    roots, all_ = components(links.unionByName(_confirmed(rest, sets)))
    dropped(all_, links, open_, fine, first, joined, sets)
    # the class of smallest number has the component's smallest leader
    roots = roots.join(leaders.select(F.col("c").alias("root"), F.col("lead").alias("top")), "root").select(F.col("id").alias("c"), "top")
    classes = leaders.select("s1", "s2", "c", "lead").join(roots, "c", "left").withColumn("root", F.coalesce("top", "lead"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2")
    bare = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    put = out.where(~bare).join(classes.select("s1", "s2", "root"), ["s1", "s2"], "left").select("doc_id", "n_shingles", "root")
    known = same.where("bare AND a = b").select("doc_id", F.col("a").alias("c")).join(classes, "c").select("doc_id", "root")
    put = put.unionByName(out.where(bare).select("doc_id", "n_shingles").join(known, "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = put.select("doc_id", "n_shingles", component.alias("component_id"))
    release(docs.sparkSession)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose document leads its component; of rows that share a doc_id one
    stays, that with the smallest text. Rows with a null doc_id stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    drop = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    left = rows.where(F.col(doc_id).isNotNull()).join(drop, doc_id, "left_anti")
    repeated = left.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(doc_id)
    ranked = left.join(repeated, doc_id, "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy(doc_id).orderBy(text)))
    once = left.join(repeated, doc_id, "left_anti").select(names).unionByName(ranked.where("rank = 1").select(names))
    return once.unionByName(rows.where(F.col(doc_id).isNull())).toDF(*docs.columns)


def op8_minhash(spark, sf_dir):
    """The component of near duplicates of every document of ``documents``, from whole texts; see
    :func:`near_duplicates` for null ids, empty texts and repeated rows."""
    return near_duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))


OP8_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS c, s FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT x.c AS a, y.c AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.c < y.c GROUP BY x.c, y.c),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM r JOIN l ON l.a = r.b OR l.b = r.b),
t AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(t.root, s.doc_id) AS component_id, s.doc_id = coalesce(t.root, s.doc_id) AS kept
FROM s LEFT JOIN c USING (s) LEFT JOIN t ON t.a = c.c
"""
