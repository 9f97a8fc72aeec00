"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of every document.

The items are the indexed side. Impacts are divided by an item's score for its own text, so one threshold fits items
of every length. A passage is two neighbouring chunks of a document; an item's chunks are the smallest of 64, 128,
256, ... words that hold it, so a copied item lies whole in some passage, and what other items there are has no say in
it. Items of one chunk length stand in blocks, and the index keeps the largest impact of each term in each block that
holds it. Terms in many blocks whose maxima together stay below a slack in every block can't lift a block to the
threshold alone, so a passage's block bounds are summed over its other terms first, by numpy for all passages of a
batch, and only where they come within the slack of the threshold are the common terms of the passage added. Blocks
whose bound reaches the threshold are searched, by WAND with pivots, and every item at or above the threshold is
retrieved: there is no top k.

A retrieved item counts as leaked if enough of its question's and of its answer's word pairs stand within a window of
twice its own length. Where no mark tells the answer, what stands for it is only the item's tail, whose lack doesn't
clear a copy: enough of the whole item's pairs do as well.

The index is broadcast, and the documents stream through it once; of items beyond ``ROUND_BYTES`` of text there are
several indexes, each of that size, one at a time: what one finds is written and the workers give it back before the
next is made. Statistics are taken over all items before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import dropped, table, written

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved, and of its parts' word pairs that must be there.
THRESHOLD, QUESTION, ANSWER = 0.5, 0.6, 0.5
#: Share of all its word pairs that does as well if no mark tells its answer, and if its last sentence may be one.
WHOLE, SENTENCE = 0.6, 0.8
#: Words that an answer has at least, if the item has twice as many.
ANSWER_WORDS = 5
BLOCK = 4
CHUNK = 64
#: What the maxima of a block's common terms may come to together.
SLACK = 0.2
#: Cells of passages and blocks that are summed at a time.
CELLS = 1 << 22
#: Bytes of item text in one index, at about: what a broadcast and every worker hold grows with no more than this.
ROUND_BYTES = 16 << 20
_U = np.uint64
_MARK = re.compile(r"\n\s*(?:answer|a)\s*:", re.I)
_SENTENCE = re.compile(r"[.?!]\s+")


def _tokens(texts: pa.Array) -> tb.Words:
    return tb.words(pc.utf8_lower(pc.fill_null(texts, "")), tb.ALNUM)


def _hashes(text: str) -> np.ndarray:
    return _tokens(pa.array([text], pa.string())).hashes()


def parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer: parted at an answer mark, else before the last sentence. An answer
    too short to be told from chance takes words from the question's end."""
    words = _hashes(text)
    marks = [m.end() for m in _MARK.finditer(text)] or [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    answer = len(_hashes(text[marks[-1] :])) if marks else len(words) // 3
    answer = min(max(answer, ANSWER_WORDS), max(1, len(words) // 2))
    return words[: len(words) - answer], words[len(words) - answer :]


def whole_share(text: str) -> float | None:
    """Share of all of an item's word pairs that makes a leak without its answer; none if a mark, with words behind it,
    tells the answer. A last sentence long enough to be an answer asks for more."""
    marks, ends = ([m.end() for m in x.finditer(text.rstrip())] for x in (_MARK, _SENTENCE))
    if marks and len(_hashes(text[marks[-1] :])):
        return None
    return SENTENCE if ends and len(_hashes(text[ends[-1] :])) >= ANSWER_WORDS else WHOLE


def _pairs(h: np.ndarray) -> np.ndarray:
    return np.unique(tb.grams(h, 2) if len(h) > 1 else h)


def _statistics(h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Terms, in how many of the items each is, number of items and their mean length."""
    terms, df = np.unique(np.concatenate([np.unique(x) for x in h]), return_counts=True)
    return terms, df, len(h), sum(map(len, h)) / len(h)


def _chunk(n: int) -> int:
    """Words of a chunk for an item of n words."""
    size = CHUNK
    while size < n:
        size *= 2
    return size


class Group:
    """The items of one chunk length in blocks, with postings and block maxima by term (its place in ``terms``)."""

    def __init__(self, chunk: int, items: list[int], weights: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.chunk, self.items = chunk, items
        self.blocks = -(-len(items) // BLOCK)
        term = np.concatenate([t for t, _ in weights])
        item = np.repeat(np.arange(len(items)), [len(t) for t, _ in weights])
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], np.concatenate([w for _, w in weights])[order]
        term = term[order]
        self.at = np.searchsorted(term, np.arange(terms + 1))
        cell = term * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.most, cell = np.maximum.reduceat(self.weight, first), cell[first]
        self.block, of = cell % self.blocks, cell // self.blocks
        self.block_at = np.searchsorted(of, np.arange(terms + 1))
        self.common = np.zeros(terms, bool)
        self.slack = np.zeros(self.blocks)
        for t in np.argsort(-np.diff(self.block_at), kind="stable").tolist():
            own = slice(self.block_at[t], self.block_at[t + 1])
            if own.stop - own.start < 2 or (self.slack[self.block[own]] + self.most[own]).max() > SLACK:
                break
            self.slack[self.block[own]] += self.most[own]
            self.common[t] = True
        self.place = np.cumsum(self.common) - 1
        self.usual = np.zeros((self.blocks, int(self.common.sum())))  # maxima of the common terms, in most blocks each
        for t in np.flatnonzero(self.common).tolist():
            own = slice(self.block_at[t], self.block_at[t + 1])
            self.usual[self.block[own], self.place[t]] = self.most[own]

    def candidates(self, passage: np.ndarray, term: np.ndarray, passages: int) -> Iterator[tuple[int, int]]:
        """(passage, block) whose bound reaches the threshold, from different pairs of passage, sorted, and term."""
        usual = self.common[term]
        there = np.zeros((passages, self.usual.shape[1]), bool)
        there[passage[usual], self.place[term[usual]]] = True
        passage, term = passage[~usual], term[~usual]
        step = max(1, CELLS // self.blocks)
        for lo in range(0, passages, step):
            a, b = np.searchsorted(passage, (lo, lo + step))
            count = self.block_at[term[a:b] + 1] - self.block_at[term[a:b]]
            cuts = np.concatenate([[0], np.searchsorted(np.cumsum(count), np.arange(CELLS, int(count.sum()) + CELLS, CELLS))])
            bound = np.zeros(min(step, passages - lo) * self.blocks)
            for x, y in zip(cuts, cuts[1:], strict=False):  # pieces of bounded size
                own = count[x:y]
                at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.block_at[term[a + x : a + y]], own)
                cell = np.repeat(passage[a + x : a + y] - lo, own) * self.blocks + self.block[at]
                bound += np.bincount(cell, self.most[at], len(bound))
            reach = np.flatnonzero(bound.reshape(-1, self.blocks) >= THRESHOLD - 1e-6 - self.slack)
            for k in range(0, len(reach), 1 << 14):
                some = reach[k : k + (1 << 14)]
                row, block = lo + some // self.blocks, some % self.blocks
                whole = bound[some] + (self.usual[block] * there[row]).sum(axis=1) >= THRESHOLD - 1e-6
                yield from zip(row[whole].tolist(), block[whole].tolist(), strict=True)

    def search(self, terms: list[int], block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """Items of a block, as places in ``items``, that reach the threshold, with scores: WAND over the postings of
        the terms in the block."""
        lists = []
        for t in terms:
            a, b = self.at[t], self.at[t + 1]
            x, y = a + np.searchsorted(self.item[a:b], (block * BLOCK, (block + 1) * BLOCK))
            if x < y:
                lists.append((self.item[x:y].tolist(), self.weight[x:y].tolist(), float(self.weight[x:y].max())))
        at = [0] * len(lists)
        while True:
            alive = sorted((x[0][at[i]], i) for i, x in enumerate(lists) if at[i] < len(x[0]))
            bound, pivot = 0.0, None
            for item, i in alive:
                bound += lists[i][2]
                if bound >= threshold - 1e-6:
                    pivot = item
                    break
            if pivot is None:
                return
            if alive[0][0] == pivot:
                score = 0.0
                for item, i in alive:
                    if item == pivot:
                        score += lists[i][1][at[i]]
                        at[i] += 1
                if score >= threshold:
                    yield pivot, score
            else:
                for item, i in alive:
                    while at[i] < len(lists[i][0]) and lists[i][0][at[i]] < pivot:
                        at[i] += 1


class Index:
    """Items (item_id, text) of one round; ``statistics`` are those of all items, by default of these."""

    def __init__(self, items: list[tuple[int, str]], statistics: tuple[np.ndarray, np.ndarray, int, float] | None = None):
        self.ids = [i for i, _ in items]
        words = [_hashes(t) for _, t in items]
        self.length = list(map(len, words))
        self.parts = [tuple(map(_pairs, parts(t))) for _, t in items]
        self.whole = [(_pairs(h), whole_share(t)) for (_, t), h in zip(items, words, strict=True)]
        self.terms, df, count, mean = statistics or _statistics(words)
        self.slot = np.zeros(1 << 20, bool)
        self.slot[(self.terms >> _U(44)).astype(np.int64)] = True
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        weights = []
        for h in words:
            own, tf = np.unique(h, return_counts=True)
            at = np.searchsorted(self.terms, own)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
            weights.append((at, impact / impact.sum()))
        sizes = np.array([_chunk(n) for n in self.length])
        self.groups = [Group(int(c), (own := np.flatnonzero(sizes == c).tolist()), [weights[k] for k in own], len(self.terms)) for c in np.unique(sizes)]

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float] | None:
        """Overlaps of an item's question and answer in the best window of a passage's word hashes, if it is a leak."""
        span = 2 * max(8, self.length[item])
        whole, share = self.whole[item]

        def judged(own: np.ndarray) -> tuple[float, float] | None:
            pairs = np.concatenate([tb.grams(own, 2), own])
            q, a = (float(np.isin(p, pairs).mean()) if len(p) else 1.0 for p in self.parts[item])
            return (q, a) if (q >= QUESTION and a >= ANSWER) or (share and np.isin(whole, pairs).mean() >= share) else None

        if not judged(passage):  # what no passage holds, no window of it does
            return None
        return max((x for lo in range(0, max(1, len(passage) - span // 2), max(1, span // 8)) if (x := judged(passage[lo : lo + span]))), default=None)

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item_id, score, question overlap, answer overlap) of every leaked item of each text, its best passage."""
        w = _tokens(texts)
        if not len(w.start) or not len(self.terms):
            return
        h = w.hashes()
        first = tb.firsts(w.doc, w.n)
        maybe = np.flatnonzero(self.slot[(h >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == h[maybe]
        place, found = maybe[hit], at[hit]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for g in self.groups:
            own = np.diff(g.at)[found] > 0
            doc, term = w.doc[place[own]], found[own]
            chunks = -(-np.diff(first) // g.chunk)
            base = np.concatenate([[0], np.cumsum(chunks)])
            chunk = base[doc] + (place[own] - first[doc]) // g.chunk
            # passage c is the chunks c and c + 1 of a document; the last of several chunks starts none of its own
            starts = (chunk == base[doc]) | (chunk < base[doc + 1] - 1)
            follows = chunk > base[doc]
            n = len(self.terms)
            key = np.unique(np.concatenate([chunk[starts] * n + term[starts], (chunk[follows] - 1) * n + term[follows]]))
            passage, term = key // n, key % n
            held = None
            for c, block in g.candidates(passage, term, int(base[-1])):
                if held is None or held[0] != c:
                    a, b = np.searchsorted(passage, (c, c + 1))
                    row = int(np.searchsorted(base, c, "right")) - 1
                    begin = first[row] + (c - base[row]) * g.chunk
                    held = c, term[a:b].tolist(), row, h[begin : min(begin + 2 * g.chunk, first[row + 1])]
                for k, score in g.search(held[1], block, THRESHOLD):
                    if over := self.overlaps(item := g.items[k], held[3]):
                        best[held[2], item] = max(best.get((held[2], item), (0.0, 0.0, 0.0)), (score, *over))
        for (row, item), values in sorted(best.items()):
            yield row, self.ids[item], *values


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (term, words): a row for each term of each item, and one without a term for its length."""
    for b in batches:
        w = _tokens(b.column("text"))
        key = np.unique(np.rec.fromarrays([w.doc, w.hashes()]))
        length = np.bincount(w.doc, minlength=w.n)
        term = pa.concat_arrays([pa.array(key["f1"].view(np.int64)), pa.nulls(len(length), pa.int64())])
        yield pa.RecordBatch.from_arrays([term, pa.array(np.concatenate([np.zeros(len(key), np.int64), length]))], ["term", "words"])


def rounds_of(items: DataFrame, round_bytes: int = ROUND_BYTES) -> int:
    """Over how many indexes of about ``round_bytes`` of text the items (item_id, text) are dealt."""
    total = _usable(items).agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    return -(-(total["bytes"] or 0) // round_bytes)


def _usable(items: DataFrame) -> DataFrame:
    return items.where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]")).select("item_id", "text").distinct()


def indexes(items: DataFrame, rounds: int) -> Iterator[Index]:
    """The indexes of (item_id long, text), made one after the other as they are asked for. Items without id or words are
    left out; of several texts of one id each is an item."""
    items = _usable(items)
    dealt = items.withColumn("round", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, rounds))))
    if rounds > 1:
        df = items.mapInArrow(_item_terms, "term long, words long").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("words").alias("words"))
        df = written(df, "item-terms")
        n = items.count()
        mean = df.where("term IS NULL").first()["words"] / n
    for s in range(rounds):
        own = dealt.where(F.col("round") == s).select("item_id", "text")
        rows = sorted((r["item_id"], r["text"]) for r in own.collect())  # bounded by the bytes of a round
        rows = [(i, t) for i, t in rows if len(_hashes(t))]
        if not rows:
            continue
        if rounds == 1:
            yield Index(rows)
        else:
            here = own.mapInArrow(_item_terms, "term long, words long").select("term").distinct()
            known = np.array([(r["term"], r["df"]) for r in df.where("term IS NOT NULL").join(here, "term").collect()], np.int64)
            terms = known[:, 0].copy().view(_U)
            order = np.argsort(terms)
            yield Index(rows, (terms[order], known[order, 1], n, mean))
    if rounds > 1:
        dropped(df)


SCHEMA = "item_id long, score double, question_overlap double, answer_overlap double"


def _searched(held, kind: str):
    """What a task does with (doc_id, text) and one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tb.pieces(b.column("text")):
                found = list(held.value.leaks(b.column("text").slice(lo, hi - lo)))
                if found:
                    ids = b.column("doc_id").take(pa.array([lo + f[0] for f in found]))
                    cols = [pa.array([f[i] for f in found]) for i in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return lambda docs: docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def _kept(held, at: int):
    """What a task does with whole rows, the texts in column ``at``, and one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, hi in tb.pieces(b.column(at)):
                keep[[lo + f[0] for f in held.value.leaks(b.column(at).slice(lo, hi - lo))]] = False
            yield b.filter(pa.array(keep))

    return lambda docs: docs.mapInArrow(run, docs.schema)


def leaks(docs: DataFrame, items: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_id, text) and (item_id long, text) to one row for each document and item leaked into it: doc_id, item_id,
    score, question_overlap, answer_overlap. An item without an answer mark may have a low overlap of its question or of
    its answer, which then is its tail, if that of all its words is high. Rows without text leak nothing; without items
    there are no rows. A row with a null doc_id is searched like others; equal rows give equal results each.

    If the items need several rounds, each one's leaks are written and its index is taken back from the workers before
    the next is made."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rounds = rounds_of(items, round_bytes)
    out = None
    for index in indexes(items, rounds):
        held = spark.sparkContext.broadcast(index)
        found = _searched(held, kind)(docs)
        if rounds > 1:
            found = written(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, {SCHEMA}")


def _hashes_of_leaks(held):
    """What a task does with texts and one index: the hashes of those that something leaked into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tb.pieces(b.column(0)):
                part = b.column(0).slice(lo, hi - lo)
                rows = sorted({f[0] for f in held.value.leaks(part)})
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(part[r].as_py().encode()).hexdigest() for r in rows], pa.string())], ["key"])

    return lambda docs: docs.select("text").mapInArrow(run, "key string")


def without_leaks(docs: DataFrame, items: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, into whose text no item has leaked. Each row is judged by its own text, in
    place: nothing is shuffled. If the items need several rounds, each writes the hashes of the texts it leaked into, and
    the rows are joined against all of them."""
    spark = docs.sparkSession
    rounds = rounds_of(items, round_bytes)
    if rounds <= 1:
        for index in indexes(items, rounds):
            docs = _kept(spark.sparkContext.broadcast(index), docs.columns.index("text"))(docs)
        return docs
    keys = None
    for index in indexes(items, rounds):
        held = spark.sparkContext.broadcast(index)
        found = written(_hashes_of_leaks(held)(docs).distinct(), "leaks")
        held.destroy()
        keys = found if keys is None else keys.unionByName(found)
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*names).withColumn("key", F.sha2(names[docs.columns.index("text")], 256))
    return keyed.join(keys.distinct(), "key", "left_anti").select(names).toDF(*docs.columns)


def op5_decontamination(spark, sf_dir):
    """The items of ``benchmark`` that have leaked into each whole text of ``documents``; see :func:`leaks`."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
