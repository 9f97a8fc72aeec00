"""How the sources of a language differ in their words, by tries of terms that partitions build and merge.

A task counts its documents' terms in a radix trie whose leaves hold, for each source, how often the term occurs and in
how many documents. The trie is cut into the subtries of short prefixes; these are dealt by ranges of prefixes, so a task
merges the subtries of one prefix after the other in the order of their bytes, which is that of UTF-8, and keeps the leaves
that enough documents have. The kept leaves are walked once more, with the totals of their language's sources, for the
divergence of each pair of sources and each source's most surprising terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, pieces_of, table, text_or_empty, written

#: Terms of a task's trie before it starts another one; bytes of the prefix of a subtrie.
TERMS, DEPTH = 1_000_000, 4
#: Leaves of a piece of the merged trie, cells of a matrix of a piece's counts, bytes of subtries merged at once.
LEAVES, CELLS, MERGED = 4096, 1 << 22, 8 << 20
#: Documents of its language that a kept term has at least; terms listed of a source; the unit of shares.
DOCUMENTS, LISTED, UNIT = 10, 10, 1_000_000_000

#: What bytes are to terms: letters, capitals made small; all beyond ASCII; the rest parts terms.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Trie:
    """A radix trie in depth-first order, which is that of the terms' bytes: ``terms``, and for each leaf ``k`` counters, of a
    ``source``'s key each: ``n`` occurrences in ``docs`` documents. A written leaf holds the length of the path that it
    shares with the leaf before, and the bytes of its own edge."""

    def __init__(self, terms: list[bytes], k: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.terms, self.k, self.source, self.n, self.docs = terms, k, source, n, docs

    @classmethod
    def of(cls, terms: list[bytes], which: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Trie:
        """Of counters in any order, ``which`` the place of each one's term among ``terms``, all different. Counters of one
        term and source are added up; terms without any are left out."""
        used = np.unique(which)
        order = sorted(used.tolist(), key=terms.__getitem__)
        place = np.zeros(len(terms), np.int64)
        place[order] = np.arange(len(order))
        keys, s = np.unique(source, return_inverse=True)
        at, inverse = np.unique(place[which] * max(1, len(keys)) + s, return_inverse=True)
        leaf, s = np.divmod(at, max(1, len(keys)))
        add = lambda x: _sums(inverse, x, len(at))
        return cls([terms[i] for i in order], np.bincount(leaf, minlength=len(order)), keys[s], add(n), add(docs))

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        held: dict[bytes, int] = defaultdict()
        held.default_factory = held.__len__
        leaf = [np.repeat(np.fromiter(map(held.__getitem__, t.terms), np.int64, len(t.terms)), t.k) for t in tries]
        one = lambda name: np.concatenate([getattr(t, name) for t in tries])
        return cls.of(list(held), np.concatenate(leaf), one("source"), one("n"), one("docs"))

    def ends(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.k)))

    def documents(self) -> np.ndarray:
        """In how many documents each term is; a document has one source."""
        return np.diff(np.concatenate(([0], np.cumsum(self.docs)))[self.ends()])

    def part(self, lo: int, hi: int) -> Trie:
        x, y = self.ends()[[lo, hi]]
        return Trie(self.terms[lo:hi], self.k[lo:hi], self.source[x:y], self.n[x:y], self.docs[x:y])

    def kept(self, least: int) -> Trie:
        some = self.documents() >= least
        own = np.repeat(some, self.k)
        return Trie([self.terms[i] for i in np.flatnonzero(some)], self.k[some], self.source[own], self.n[own], self.docs[own])

    def subtries(self, depth: int) -> Iterator[tuple[bytes, Trie]]:
        """The subtries below each path of ``depth`` bytes; a shorter term is one of its own."""
        starts = [i for i, t in enumerate(self.terms) if not i or t[:depth] != self.terms[i - 1][:depth]]
        for lo, hi in pairwise([*starts, len(self.terms)]):
            yield self.terms[lo][:depth], self.part(lo, hi)

    def dump(self) -> bytes:
        shared = [0] * len(self.terms)
        for i, (x, y) in enumerate(pairwise(self.terms), 1):
            n = min(len(x), len(y))
            shared[i] = n if x[:n] == y[:n] else next(j for j in range(n) if x[j] != y[j])
        tails = [t[s:] for t, s in zip(self.terms, shared, strict=True)]
        numbers = [shared, list(map(len, tails)), self.k, self.source, self.n, self.docs]
        head = np.array([len(self.terms), len(self.source)], "<i8").tobytes()
        return zstandard.compress(head + b"".join(np.asarray(x, "<i8").tobytes() for x in numbers) + b"".join(tails), 1)

    @classmethod
    def load(cls, data: bytes) -> Trie:
        raw = zstandard.decompress(data)
        leaves, counters = np.frombuffer(raw, "<i8", 2).tolist()
        at, columns = 16, []
        for length in (leaves, leaves, leaves, counters, counters, counters):
            columns.append(np.frombuffer(raw, "<i8", length, at).astype(np.int64))
            at += 8 * length
        terms, last = [], b""
        for shared, length in zip(columns[0].tolist(), columns[1].tolist(), strict=True):
            last = last[:shared] + raw[at : at + length]
            at += length
            terms.append(last)
        return cls(terms, *columns[2:])


def _sums(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by group."""
    out = np.zeros(n, np.int64)
    np.add.at(out, group, x)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source's key, text) to the subtries of the tries of each language."""
    held: dict[bytes, int] = defaultdict()
    held.default_factory = held.__len__
    langs: dict[str, int] = {}
    parts: list[tuple[np.ndarray, ...]] = []  # language, source's key, term, occurrences, documents

    def compact() -> None:
        lang, source, term, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((source, lang, term))
        lang, source, term, n, docs = (x[order] for x in (lang, source, term, n, docs))
        new = np.concatenate(([True], (np.diff(lang) != 0) | (np.diff(source) != 0) | (np.diff(term) != 0)))
        at = np.flatnonzero(new)
        parts[:] = [(lang[at], source[at], term[at], np.add.reduceat(n, at), np.add.reduceat(docs, at))]

    def close() -> Iterator[pa.RecordBatch]:
        terms = list(held)
        if parts:
            compact()
        for name, number in langs.items() if parts else ():
            lang, source, term, n, docs = (x[parts[0][0] == number] for x in parts[0])
            rows = [(name, prefix, sub.dump()) for prefix, sub in Trie.of(terms, term, source, n, docs).subtries(DEPTH)] if len(lang) else []
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 4096], strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "prefix", "trie"])
        held.clear()
        langs.clear()
        parts.clear()

    for b in batches:
        words = [t.encode().translate(_LETTERS).split() for t in b.column("text").to_pylist()]
        length = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter((i for w in words for i in map(held.__getitem__, w)), np.int64, int(length.sum()))
        if len(ids):
            both, n = np.unique((np.repeat(np.arange(len(words)), length) << 32) | ids, return_counts=True)
            row, term = both >> 32, both & 0xFFFFFFFF
            lang = np.array([langs.setdefault(x, len(langs)) for x in b.column("lang").to_pylist()], np.int64)
            source = b.column("key").to_numpy()
            parts.append((lang[row], source[row], term, n.astype(np.int64), np.ones(len(n), np.int64)))
            if len(parts) >= 16:
                compact()
        if len(held) >= TERMS:
            yield from close()
    yield from close()


def _merged(least: int):
    """Subtries in order of (lang, prefix) to pieces of the kept trie, with each source's occurrences in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, done, lang = None, [], 0, [], None

        def piece(name: str, tries: list[Trie]) -> Iterator[pa.RecordBatch]:
            whole = Trie.merged(tries)
            for lo in range(0, len(whole.terms), LEAVES):
                own = whole.part(lo, lo + LEAVES if lo + LEAVES < len(whole.terms) else len(whole.terms))
                keys, inverse = np.unique(own.source, return_inverse=True)
                row = {"lang": name, "trie": own.dump(), "leaves": len(own.terms), "keys": keys.tolist(), "n": _sums(inverse, own.n, len(keys)).tolist()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("lang", pa.string()), ("trie", pa.binary()), ("leaves", pa.int64()), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

        for b in batches:
            for now, data in zip(zip(b.column("lang").to_pylist(), b.column("prefix").to_pylist(), strict=True), b.column("trie").to_pylist(), strict=True):
                if now != at:
                    if held and (left := Trie.merged(held).kept(least)).terms:
                        done.append(left)
                    if done and (now[0] != lang or sum(len(t.terms) for t in done) >= LEAVES):
                        yield from piece(lang, done)
                        done = []
                    at, held, size, lang = now, [], 0, now[0]
                held.append(Trie.load(data))
                if (size := size + len(data)) >= MERGED:
                    held, size = [Trie.merged(held)], 0
        if held and (left := Trie.merged(held).kept(least)).terms:
            done.append(left)
        if done:
            yield from piece(lang, done)

    return run


def shares(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), by three digits at a time, so that nothing overflows."""
    rest, whole, of = n + 2, np.zeros_like(n), total + 2 * kept
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the kept trie with their language's sources (names, keys, totals) and number of kept terms to rows: a
    pair's divergence over the piece's terms, and a source's first terms of the piece."""
    for b in batches:
        for r in b.to_pylist():
            trie, names, keys = Trie.load(r["trie"]), [s["source"] for s in r["sources"]], np.array([s["key"] for s in r["sources"]])
            total, by_key = np.array([s["n"] for s in r["sources"]]), np.argsort(keys)
            at = by_key[np.searchsorted(keys, trie.source, sorter=by_key)]
            step, ends = max(1, CELLS // len(names)), trie.ends()
            sums = np.zeros((len(names), len(names)), np.int64)
            best: list[list[tuple[int, bytes]]] = [[] for _ in names]
            for lo in range(0, len(trie.terms), step):
                hi = min(lo + step, len(trie.terms))
                n = np.zeros((hi - lo, len(names)), np.int64)
                n[np.repeat(np.arange(hi - lo), trie.k[lo:hi]), at[ends[lo] : ends[hi]]] = trie.n[ends[lo] : ends[hi]]
                p, q = shares(n, total, r["kept"]), shares(n.sum(axis=1), int(total.sum()), r["kept"])
                for i in range(len(names)):
                    sums[i, i + 1 :] += divergence(p[:, i, None], p[:, i + 1 :]).sum(axis=0)
                    some = np.flatnonzero((n[:, i] > 0) & (p[:, i] > q))
                    f = divergence(p[some, i], q[some])
                    first = np.argsort(-f, kind="stable")[:LISTED]  # ties stay in the walk's order
                    best[i] = sorted(best[i] + [(-x, trie.terms[lo + t]) for x, t in zip(f[first].tolist(), some[first].tolist(), strict=True)])[:LISTED]
            sums += sums.T
            rows = [(r["lang"], names[i], "pair", names[j], int(sums[i, j])) for i in range(len(names)) for j in range(len(names)) if i != j]
            rows += [(r["lang"], names[i], "term", t.decode(), -x) for i, own in enumerate(best) for x, t in own]
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(zip(*rows[lo : lo + 4096], strict=True))], ["lang", "source", "part", "item", "value"])


def kept_terms(docs: DataFrame, key, least: int = DOCUMENTS) -> DataFrame:
    """The merged trie of documents (lang, source, text) in pieces: lang, trie, leaves, and of its terms the occurrences
    ``n`` of the sources ``keys``. ``key`` makes a source's key of the column ``source``."""
    rows = docs.select(text_or_empty("lang").alias("lang"), key(text_or_empty("source")).alias("key"), text_or_empty("text").alias("text"))
    tries = written(rows.mapInArrow(_counted, "lang string, prefix binary, trie binary"), "tries")
    placed = tries.repartitionByRange(pieces_of(tries, 4, 16 << 20), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    out = written(placed.mapInArrow(_merged(least), "lang string, trie binary, leaves long, keys array<long>, n array<long>"), "kept")
    dropped(tries)
    return out


def divergences(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """Documents (lang, source, text) to lang, source, part, item, value, rank: of each source of a language all others by
    divergence (``pair``), and its terms that are most beyond the language's share (``term``, up to 10). Sources without
    kept terms are there too. Nulls are empty strings; a language's sources are held as one row."""
    names = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    names = written(names, "sources")
    seed = 0
    while not names.select("source").distinct().groupBy(F.xxhash64("source", F.lit(seed))).count().where("count > 1").isEmpty():
        seed += 1  # until no two sources have one key
    key = lambda c: F.xxhash64(c, F.lit(seed))
    kept = kept_terms(docs, key, least)
    total = kept.select("lang", F.explode(F.arrays_zip("keys", "n")).alias("x")).groupBy("lang", F.col("x.keys").alias("key")).agg(F.sum("x.n").alias("n"))
    known = names.withColumn("key", key(F.col("source"))).join(total, ["lang", "key"], "left").fillna(0, ["n"])
    by_lang = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "key", "n"))).alias("sources"))
    by_lang = by_lang.join(kept.groupBy("lang").agg(F.sum("leaves").alias("kept")), "lang")
    said = written(kept.select("lang", "trie").join(by_lang, "lang").mapInArrow(_walked, "lang string, source string, part string, item string, value long"), "said")
    sums = said.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = names.join(names.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pairs = both.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = said.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = written(pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.select(columns)), "divergences")
    dropped(names, kept, said)
    return out


def op11_sources(spark, sf_dir):
    """All ``documents``. Null lang, source and text count as empty strings, an empty text's source is there too, repeated rows
    count as often as they occur, an empty table gives no rows; other columns don't matter."""
    return divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v))::HUGEINT AS p
      FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, sum(total) AS total FROM t GROUP BY lang),
q AS (SELECT k.lang, k.term, (1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(l.total) + 2 * any_value(v)))::HUGEINT AS q
      FROM k JOIN c USING (lang, term) JOIN v USING (lang) JOIN l USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
