"""Removal of repeated passages with suffix automata and matching statistics.

``remove_known`` is the plain form: reference texts of a proven size are cut into shards, the automaton of each shard
is broadcast, and every document streams through it; maximal spans whose matching statistic reaches the threshold go.

``remove_repeated`` holds a corpus against itself. All documents as reference would mean every document against
every shard, so automata are built of what can match and only the text that may match is streamed to them:

1. In every window of 13 words the 5-word gram of smallest hash is its anchor. Equal windows have equal anchors, so
   windows with an anchor that no other document has are unique and need no automaton.
2. Consecutive windows with one anchor are one passage of 13 to 21 words. Passages are grouped by anchor and content,
   and one of each content, from the smallest document that has it, is reference.
3. References are dealt to shards: all contents of an anchor to one, so that equal windows meet. Where an anchor has one
   content, neighbouring passages of a document go as one run. A shard's automaton keeps, for every state, the smallest
   document that holds its strings; its references stream through it, with the match length kept at 13 words by suffix
   links, and each window gets the smallest document it starts in.
4. An anchor with very many contents, such as that of a phrase that everybody uses, is dealt out by window: equal
   windows are first grouped to the smallest document, before the shuffle, and then one of each goes to a shard, so no
   shard grows with the corpus.

A passage counts once a document, however often it repeats there. What is shared is found by sums that are
pre-aggregated before the shuffle (per anchor, then per content) and joined back, so an anchor in a third of all
documents is split like any skewed join, and no task holds all rows of one anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import WORD, release, table, written

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: An anchor with more contents than this is dealt out by window.
MANY = 256
#: Words of a reference shard, and windows of a run at most.
SHARD, RUN = 20_000, 2_000
_U = np.uint64
_WORD = re.compile(WORD)


class Automaton:
    """Suffix automaton of several sequences; each state knows the smallest number given with a sequence that holds it."""

    def __init__(self, sequences: Iterable[tuple[list, int]]):
        # one loop over local names: a shard's time goes here
        self.next, self.link, self.length = follow, link, length = [{}], [-1], [0]
        ends: list[tuple[int, int]] = []
        for symbols, number in sequences:
            last = 0
            for c in symbols:
                q = follow[last].get(c)
                if q is None:
                    cur = len(length)
                    follow.append({})
                    length.append(length[last] + 1)
                    p = last
                    while p != -1 and c not in follow[p]:
                        follow[p][c] = cur
                        p = link[p]
                    if p == -1:
                        link.append(0)
                    else:
                        q = follow[p][c]
                        link.append(q)
                        if length[q] != length[p] + 1:
                            link[cur] = self._clone(p, q, c)
                    last = cur
                else:
                    last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                ends.append((last, number))
        self.least = least = [None] * len(length)
        for state, number in ends:
            if least[state] is None or number < least[state]:
                least[state] = number
        for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            up, mine = link[state], least[state]
            if mine is not None and (least[up] is None or mine < least[up]):
                least[up] = mine

    def _clone(self, p: int, q: int, c) -> int:
        new = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def firsts(self, symbols: list, most: int) -> list[int]:
        """For each window of ``most`` symbols of a sequence that the automaton holds, the smallest number of a sequence
        that holds the window: what :meth:`statistics` says where nothing is unknown."""
        follow, link, length, least = self.next, self.link, self.length, self.least
        state, out = 0, []
        for c in symbols[: most - 1]:
            state = follow[state][c]
        for c in symbols[most - 1 :]:
            state = follow[state][c]
            while length[link[state]] >= most:
                state = link[state]
            out.append(least[state])
        return out

    def statistics(self, symbols: Iterable, most: int | None = None) -> Iterator[tuple[int, int]]:
        """For each symbol the length of the longest match that ends there, ``most`` at the highest, and its state."""
        follow, link, length = self.next, self.link, self.length
        state = matched = 0
        for c in symbols:
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            if c in follow[state]:
                state, matched = follow[state][c], matched + 1
            if most and matched >= most:
                matched = most
                while length[link[state]] >= most:
                    state = link[state]
            yield matched, state


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the anchors of each document: (fp, doc_id)."""
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi in tb.pieces(b.column("text")):
            w = tb.words(b.column("text").slice(lo, hi - lo))
            start, _, anchor, g = _runs(w.hashes(), w.doc)
            yield pa.RecordBatch.from_arrays([pa.array(g[anchor].view(np.int64)), pa.array(ids[lo + w.doc[start]])], ["fp", "doc_id"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text) to (fp, ph, doc_id, at): anchor, content, and where: 27 bits of the tag, position, windows."""
    for b in batches:
        ids, tags = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tag").to_numpy(zero_copy_only=False)
        for lo, hi in tb.pieces(b.column("text")):
            w = tb.words(b.column("text").slice(lo, hi - lo))
            h = w.hashes()
            start, count, fp, ph = passages(h, w.doc)
            order = np.lexsort((ph, w.doc[start]))
            new = np.ones(len(order), bool)
            new[1:] = (ph[order][1:] != ph[order][:-1]) | (w.doc[start[order]][1:] != w.doc[start[order]][:-1])
            one = order[new]
            start, count, fp, ph = start[one], count[one], fp[one], ph[one]
            doc = w.doc[start]
            pos = start - tb.firsts(w.doc, w.n)[doc]
            at = tags[lo + doc] << 36 | pos << 4 | count
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(ids[lo + doc]), pa.array(at)], ["fp", "ph", "doc_id", "at"])


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their documents to passages: first word, number of windows, place of the anchor; and all grams."""
    m = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none, none, np.zeros(0, _U)
    g = tb.grams(h, GRAM)
    # the first of the smallest of SPAN grams, by windows of 2, 4 and 8, and the last gram
    best, where, span = g, np.arange(len(g), dtype=np.int32), 1
    while 2 * span <= SPAN:
        n = len(best) - span
        less = best[span:] < best[:n]
        best, where, span = np.minimum(best[:n], best[span:]), np.where(less, where[span:], where[:n]), 2 * span
    shift = SPAN - span
    where = np.where(best[shift : shift + m] < best[:m], where[shift : shift + m], where[:m])
    window = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    if not len(window):
        return none, none, none, g
    anchor = where[window].astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[window[1:]] != doc[window[:-1]])
    first = np.flatnonzero(new)
    return window[first], np.diff(np.append(first, len(window))), anchor[first], g


def passages(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their documents to passages: first word, number of windows, hash of the anchor and of the content."""
    start, count, anchor, g = _runs(h, doc)
    up, down = tb._power(len(h) + 1)
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    content = (sums[start + count + WINDOW - 1] - sums[start]) * down[start]
    return start, count, g[anchor], tb.mix(content + tb.mix((count * 16 + anchor - start).astype(_U)))


def _wanted(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of (doc_id, text, wanted) by pieces: word hashes, and of each wanted passage its document's id and number, first
    word, number of windows, anchor, content and the anchor's number of contents."""
    ids = b.column("doc_id").to_numpy(zero_copy_only=False)
    for lo, hi in tb.pieces(b.column("text")):
        w = tb.words(b.column("text").slice(lo, hi - lo))
        wanted = b.column("wanted").slice(lo, hi - lo)
        doc = np.repeat(np.arange(hi - lo), wanted.value_lengths().to_numpy(zero_copy_only=False))
        fp, ph, at, contexts = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
        yield w.hashes(), ids[lo + doc], doc, tb.firsts(w.doc, w.n)[doc] + (at >> 4 & 0xFFFFFFFF), at & 15, fp, ph, contexts


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted) to references as word hashes, with the passages they are made of: (route, first, fp, ph, n,
    words)."""
    for b in batches:
        for h, ids, doc, start, count, fp, ph, contexts in _wanted(b):
            order = np.lexsort((start, doc, contexts == 1))  # those that go alone come first
            ids, doc, start, count, fp, ph = (x[order] for x in (ids, doc, start, count, fp, ph))
            alone = contexts[order] > 1
            new = np.ones(len(doc), bool)
            new[1:] = alone[1:] | alone[:-1] | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])
            before = np.cumsum(count) - count
            run = (before - before[new][np.cumsum(new) - 1]) // RUN if len(doc) else before
            new[1:] |= run[1:] != run[:-1]
            row = np.flatnonzero(new)
            size = np.add.reduceat(count, row) + WINDOW - 1 if len(row) else count
            held = np.append(row, len(doc))
            route = np.where(alone[row], fp[row], ph[row])
            for k in range(0, len(row), 10_000):
                part = slice(k, k + 10_000)
                words = h[np.repeat(start[row[part]], size[part]) + _steps(size[part])].view(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(size[part])]), pa.int32())
                inner = held[k : k + len(row[part]) + 1]
                own, cuts = slice(inner[0], inner[-1]), pa.array(inner - inner[0], pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x[own].astype(np.int64))) for x in (fp, ph, count)]
                yield pa.RecordBatch.from_arrays([pa.array(route[part]), pa.array(ids[row[part]]), *lists, pa.ListArray.from_arrays(ends, pa.array(words))], ["route", "first", "fp", "ph", "n", "words"])


REFERENCE = "route long, first long, fp array<long>, ph array<long>, n array<long>, words array<long>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted) to the windows of the wanted passages: (window, fp, ph, off, first, words)."""
    for b in batches:
        for h, ids, _, start, count, fp, ph, _ in _wanted(b):
            row, off = np.repeat(np.arange(len(start)), count), _steps(count)
            for k in range(0, len(row), 20_000):
                own, at = row[k : k + 20_000], off[k : k + 20_000]
                words = h[(start[own] + at)[:, None] + np.arange(WINDOW)]
                window = tb.grams(words.ravel(), WINDOW)[::WINDOW]
                ends = pa.array(np.arange(len(own) + 1) * WINDOW, pa.int32())
                cols = [pa.array(window.view(np.int64)), pa.array(fp[own]), pa.array(ph[own]), pa.array(at, pa.int32()), pa.array(ids[own])]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, pa.array(words.ravel().view(np.int64)))], ["window", "fp", "ph", "off", "first", "words"])


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, ... below each count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References sorted by route; each shard, of whole routes, is answered by its automaton: (fp, ph, off, firsts)."""

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        automaton = Automaton((words, first) for _, first, *_, words in rows)
        out: tuple[list, list, list] = ([], [], [])
        for _, _, fps, phs, counts, words in rows:
            firsts, at = automaton.firsts(words, WINDOW), 0
            for fp, ph, n in zip(fps, phs, counts, strict=True):
                out[0].append(fp)
                out[1].append(ph)
                out[2].append(firsts[at : at + n])
                at += n
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([0] * len(out[0]), pa.int32()), pa.array(out[2], pa.list_(pa.int64()))], ["fp", "ph", "off", "firsts"])

    held: list[tuple] = []
    size = 0
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("route", "first", "fp", "ph", "n", "words")]
        for row in zip(*cols, strict=True):
            if size >= SHARD and row[0] != held[-1][0]:
                yield answer(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield answer(held)


def _answered(references: DataFrame) -> DataFrame:
    parts = references.repartition("route").sortWithinPartitions("route")
    return parts.mapInArrow(_shards, "fp long, ph long, off int, firsts array<long>")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, gone) to what is left of each text."""
    for b in batches:
        for lo, hi in tb.pieces(b.column("text")):
            texts, gone = b.column("text").slice(lo, hi - lo), b.column("gone").slice(lo, hi - lo)
            w = tb.words(texts)
            at = tb.firsts(w.doc, w.n)
            counts = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cover = np.zeros(len(w.doc), np.int64)
            if counts.any():
                start, _, _, ph = passages(w.hashes(), w.doc)
                code = gone.flatten().to_numpy(zero_copy_only=False)
                key = _of_document(code, np.repeat(np.arange(hi - lo), counts))
                order = np.argsort(key, kind="stable")
                key, first = np.unique(key[order], return_index=True)  # one content may come in several rows
                bits = np.bitwise_or.reduceat(code[order] & ((1 << SPAN) - 1), first)
                own = _of_document(ph.view(np.int64), w.doc[start])
                near = np.minimum(np.searchsorted(key, own), len(key) - 1)
                bits = np.where(key[near] == own, bits[near], 0)
                begin = np.concatenate([start[bits >> j & 1 > 0] + j for j in range(SPAN)])
                edges = np.bincount(begin, minlength=len(cover) + WINDOW) - np.bincount(begin + WINDOW, minlength=len(cover) + WINDOW)[: len(cover) + WINDOW]
                cover = np.cumsum(edges)[: len(cover)]
            stays = cover == 0
            removed = np.diff(np.concatenate([[0], np.cumsum(~stays)])[at])
            raw, kept = w.data.tobytes(), []
            for d in range(w.n):
                words = raw[w.offsets[d] : w.offsets[d + 1]].split()  # bytes are split at what parts words, and only there
                kept.append(b" ".join(compress(words, stays[at[d] : at[d + 1]].tolist()) if removed[d] else words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _of_document(content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A content's hash, but for the bits that tell its windows, as one of a document's."""
    return tb.mix((content >> SPAN).astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + doc.astype(_U))


def remove_repeated(docs: DataFrame, most_contents: int = MANY) -> DataFrame:
    """(doc_id long, text) to (doc_id, n_words, n_removed, kept), a row for each row.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id. Null and
    empty texts, and those under 13 words, lose nothing. A null doc_id is smaller than none and has none that are
    smaller. Rows that share a doc_id are told apart by their text; their windows count as of one document.
    """
    tag = F.shiftright(F.xxhash64("text"), 37).bitwiseAND(F.lit((1 << 27) - 1))
    rows = docs.select("doc_id", "text", tag.alias("tag"))
    known = rows.where(F.col("doc_id").isNotNull())
    found = known.mapInArrow(_anchors, "fp long, ph long, doc_id long, at long")
    shared = known.select("doc_id", "text").mapInArrow(_documents, "fp long, doc_id long").groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("fp")
    hits = written(found.join(shared, "fp"), "hits")
    release(docs.sparkSession)
    contents = hits.groupBy("fp", "ph").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    contents = written(contents.select("fp", "ph", "first.doc_id", "first.at"), "contents")
    many = contents.groupBy("fp").agg(F.count(F.lit(1)).alias("contexts"))
    of_doc = F.shiftright("at", 36).alias("tag")

    def told(which: Column) -> DataFrame:
        wanted = contents.join(many.where(which), "fp").groupBy("doc_id", of_doc).agg(F.collect_list(F.struct("fp", "ph", "at", "contexts")).alias("wanted"))
        return rows.join(wanted, ["doc_id", "tag"]).select("doc_id", "text", "wanted")

    answers = _answered(told(F.col("contexts") <= most_contents).mapInArrow(_references, REFERENCE))
    crowded = many.where(F.col("contexts") > most_contents)
    if not crowded.isEmpty():
        windows = written(told(F.col("contexts") > most_contents).mapInArrow(_windows, "window long, fp long, ph long, off int, first long, words array<long>"), "windows")
        once = windows.groupBy("window").agg(F.min("first").alias("first"), F.first("words").alias("words"))
        one = lambda c: F.array(F.col(c).cast("long"))
        found = _answered(once.select(F.col("window").alias("route"), "first", one("window").alias("fp"), one("window").alias("ph"), F.array(F.lit(1).cast("long")).alias("n"), "words"))
        found = windows.select("window", "fp", "ph", "off").join(found.select(F.col("fp").alias("window"), "firsts"), "window")
        answers = answers.unionByName(found.select("fp", "ph", "off", "firsts"))
    answers = written(answers, "answers", 8)
    release(docs.sparkSession)
    bit = F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    bits = F.call_function("shiftleft", F.aggregate(bit, F.lit(0), lambda a, x: a + x), F.col("off")).cast("long")
    judged = hits.join(answers, ["fp", "ph"]).select("doc_id", of_doc, "ph", bits.alias("bits")).where("bits > 0")
    # the content's hash, but for its low bits, which tell the windows that go
    code = F.shiftleft(F.shiftright("ph", SPAN), SPAN) + F.col("bits")
    gone = judged.groupBy("doc_id", "tag").agg(F.collect_set(code).alias("gone"))
    whole = rows.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "gone")
    return whole.mapInArrow(_left, "doc_id long, n_words long, n_removed long, kept string")


def remove_known(docs: DataFrame, references: DataFrame, least: int = WINDOW, shard_words: int = 200_000, most_shards: int = 64) -> DataFrame:
    """(doc_id, text) to (doc_id, kept): without the words of maximal spans of ``least`` words or more that also stand
    in a text of ``references``. The references' words are counted first; more than ``most_shards`` shards are refused,
    since each is broadcast and every document streams through each."""
    spark = docs.sparkSession
    words = references.select(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+").alias("w"))
    total = words.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    if total > shard_words * most_shards:
        raise ValueError(f"{total} words of reference; at most {shard_words * most_shards} can be broadcast")
    automata, held = [], []
    for (text,) in references.select("text").toLocalIterator():
        held.append((_WORD.findall(text or ""), 0))
        if sum(len(s) for s, _ in held) >= shard_words:
            automata.append(spark.sparkContext.broadcast(Automaton(held)))
            held = []
    if held:
        automata.append(spark.sparkContext.broadcast(Automaton(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for text in b.column("text").to_pylist():
                own = _WORD.findall(text or "")
                gone = np.zeros(len(own), bool)
                for a in automata:
                    for i, (n, _) in enumerate(a.value.statistics(own)):
                        if n >= least:
                            gone[i - n + 1 : i + 1] = True
                kept.append(" ".join(w for w, g in zip(own, gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept string")


def op4_substring(spark, sf_dir):
    """What is left of every whole text of ``documents`` without the words of windows that stand in a smaller document;
    see :func:`remove_repeated` for null ids, empty texts and repeated rows."""
    out = remove_repeated(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM g JOIN f USING (g) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN r USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
