"""Tokens of two tokenizers that cover the same bytes.

Both tokenizers tile a text's bytes. The union of both arrays of ends cuts the bytes into elementary intervals; a search
in each array names the interval's owners, so each interval is one overlap of a token of A with a token of B, and an
interval that ends in both closes a group. Pieces of texts (see :mod:`tessera.llm.tokens`) end in both tokenizers, so a
piece is aligned once a worker and a text's groups are those of its pieces.

How often the corpus links an id of A with one of B is counted in blocks of documents: a block holds its pieces, its
documents as numbers of pieces and its distinct id pairs with their counts. Only these pairs are shuffled, to be summed
and to bring the sums back to their block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, table, trim, written
from tessera.llm.tokens import ByteLevel, PieceModel, Pieces, encoded, spread, vocabulary

#: Bytes of text in a block at about; a longer text is a block's last. Pieces that a worker keeps, and aligns at a time.
BLOCK_BYTES, KEPT, STEP = 8 << 20, 150_000, 4096


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two tilings of the same bytes, given where their tokens end: each interval's end, the
    tokens of A and of B that it belongs to, and whether it closes a group."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    closes = (ends_a[a] == cuts) & (ends_b[b] == cuts) if len(cuts) else np.zeros(0, bool)
    return cuts, a, b, closes


class Pair:
    """Two tokenizers, and what a worker remembers of pieces: numbers of rows of some growing arrays."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, plain=True), PieceModel(path_b)
        self.times = len(self.b.entries)
        self.clear()

    def clear(self) -> None:
        self.pieces = Pieces(self.aligned, kept=2 * KEPT)  # let go of together with the arrays
        self.shown: list[bytes] = []  # groups in decimal
        self.numbers = np.zeros((0, 4), np.int32)  # tokens of A and B, groups, links
        self.at, self.keys = np.zeros(1, np.int64), np.zeros(0, np.int64)  # links of each piece: id of A times the ids of B, plus that of B

    def forget(self) -> None:
        """Let go of what was met last; what was met first is what is met often."""
        self.pieces.held = dict(islice(self.pieces.held.items(), KEPT // 2))
        top = max(self.pieces.held.values(), default=-1) + 1
        self.shown, self.numbers, self.at = self.shown[:top], self.numbers[:top], self.at[: top + 1]
        self.keys = self.keys[: self.at[-1]]

    def encoded(self, pieces: list[str]) -> tuple[list, list]:
        """Ids by both of a space and each piece, None where these aren't the piece's bytes."""
        return encoded(lambda texts: self.a.encode([" " + t for t in texts]), self.a.lengths, pieces, self.a.entries), encoded(self.b.encode, self.b.lengths, pieces, self.b.entries)

    def aligned(self, new: list[str]) -> list[int]:
        """Align pieces, some at a time, and add them to the arrays: their rows, -1 for those whose bytes differ."""
        return [row for k in range(0, len(new), STEP) for row in self._aligned(new[k : k + STEP])]

    def _aligned(self, new: list[str]) -> list[int]:
        a, b = self.encoded(new)
        right = [x is not None and y is not None for x, y in zip(a, b, strict=True)]
        a, b = [x for x, ok in zip(a, right, strict=True) if ok], [x for x, ok in zip(b, right, strict=True) if ok]
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        cuts, own_a, own_b, closes = intervals(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))
        to_a, to_b = own_a[closes] + 1, own_b[closes] + 1  # tokens up to the end of each group
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        groups = np.searchsorted(to_a, np.cumsum(n_a), "right")  # up to the end of each piece
        links = np.searchsorted(own_a, np.cumsum(n_a), "left")
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        sides, x, y = [], 0, 0
        for u, v in zip(to_a.tolist(), to_b.tolist(), strict=True):
            sides.append(f"{','.join(text_a[x:u])}|{','.join(text_b[y:v])}")
            x, y = u, v
        first, start = len(self.shown), 0
        for end in groups.tolist():
            self.shown.append(";".join(sides[start:end]).encode())
            start = end
        self.numbers = np.concatenate((self.numbers, np.stack((n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)), axis=1).astype(np.int32)))
        self.at = np.concatenate((self.at, self.at[-1] + links))
        self.keys = np.concatenate((self.keys, ids_a[own_a] * self.times + ids_b[own_b]))
        rows = iter(range(first, len(self.shown)))
        return [next(rows) if ok else -1 for ok in right]

    def rows_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all texts' pieces, text after text, and how many each text has; none for null and empty texts and
        where bytes differ."""
        if len(self.pieces.held) > KEPT or len(self.shown) > 2 * KEPT:
            self.forget()
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        count = np.zeros(len(texts), np.int64)
        own = texts.filter(pa.array(some))
        if self.b.cuts:
            values, index, at, _ = self.pieces.of(own, lead=True)
            flat = np.array([-1 if v is None else v for v in values], np.int64)[index]
        else:  # every text is a piece
            flat, at = np.array(self.aligned(own.to_pylist()), np.int64), np.arange(len(own) + 1)
        count[some] = np.diff(at)
        if (flat < 0).any():  # as a whole, in case pieces alone are to blame
            parts = np.split(flat, at[1:-1])
            for d in np.unique(np.searchsorted(at, np.flatnonzero(flat < 0), "right") - 1).tolist():
                rows = self.aligned([own[d].as_py()])
                parts[d] = np.array([] if rows == [-1] else rows, np.int64)
            flat = np.concatenate(parts)
            count[some] = [len(p) for p in parts]
        return flat, count


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    return _pairs[paths]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Small numbers by byte of their places, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCK_SCHEMA = "block long, doc_id array<long>, numbers array<long>, groups_sha256 array<string>, pieces binary, n_pieces binary, n_pairs binary, pair_of binary, pair array<long>, n array<long>"


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Documents (doc_id, text) to blocks of aligned documents, see the module. Deterministic but for the blocks' bounds,
    so to be written before it is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, size, held = 0, 0, []
        for b in batches:
            held.append(b)
            if (size := size + b.column("text").nbytes) >= BLOCK_BYTES:
                yield _block(pair, held, seq)
                seq, size, held = seq + 1, 0, []
                trim()
        if sum(b.num_rows for b in held):
            yield _block(pair, held, seq)

    class Lazy:  # loaded by the worker that needs it
        def __getattr__(self, name):
            return getattr(_pair(paths), name)

    pair = Lazy()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _block(pair: Pair, held: list[pa.RecordBatch], seq: int) -> pa.RecordBatch:
    part = next(b.column("part")[0].as_py() for b in held if b.num_rows)
    n_pieces, sha, numbers, ids, keys, weights, inverse, lengths = [], [], [], [], [], [], [], []
    pieces, pairs_at = [], 0
    while held:  # rows of pieces hold for one batch: what is remembered may be let go of between two
        b = held.pop(0)  # its texts go with it
        flat, count = pair.rows_of(b.column("text"))
        to = np.cumsum(count)
        shown = list(map(pair.shown.__getitem__, flat.tolist()))
        sha += [hashlib.sha256(b";".join(shown[x:y])).hexdigest() if y > x else "" for x, y in zip((to - count).tolist(), to.tolist(), strict=True)]
        ends = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(pair.numbers[flat], axis=0, dtype=np.int64)))
        numbers.append(ends[to] - ends[to - count])
        often = np.bincount(flat, minlength=len(pair.shown))
        own = np.flatnonzero(often)
        own = own[np.argsort(-often[own], kind="stable")]  # common pieces get small numbers
        place = np.zeros(len(often), np.int32)
        place[own] = np.arange(len(own)) + sum(map(len, lengths))
        pieces.append(place[flat])
        n_pieces.append(count)
        length = pair.at[own + 1] - pair.at[own]
        lengths.append(length)
        keys.append(pair.keys[spread(pair.at[own], length)])
        weights.append(np.repeat(often[own], length))
        ids.append(b.column("doc_id"))
        del b, flat, shown, ends, often, own, place
        trim()
    one = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    distinct, inverse = np.unique(one(keys), return_inverse=True)
    n = np.bincount(inverse, one(weights), len(distinct)).astype(np.int64)
    row = {
        "block": (part << 32) + seq,
        "doc_id": pa.chunked_array(ids).to_pylist(),
        "numbers": np.concatenate(numbers).ravel(),
        "groups_sha256": sha,
        "pieces": _squeezed(one(pieces)),
        "n_pieces": _squeezed(one(n_pieces)),
        "n_pairs": _squeezed(one(lengths)),
        "pair_of": _squeezed(inverse),
        "pair": distinct,
        "n": n,
    }
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))


def pair_counts(held: DataFrame, times: int) -> DataFrame:
    """Blocks to the corpus's links: pair, n, and whether no id of A has more links with the pair's id of B."""
    counted = held.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("n"))
    counted = written(counted.withColumn("b", F.col("pair") % times), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    out = counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    out.stored_at = counted.stored_at
    return out


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (body, n, best), a block's body before what the corpus says of its pairs in their order, to documents."""
    _pairs.clear()  # this worker has aligned texts before
    trim()
    body, said = None, []
    for b in batches:
        starts = np.flatnonzero(b.column("body").is_valid().to_numpy(zero_copy_only=False)).tolist()
        bounds = [0, *starts, b.num_rows]
        for x, y in zip(bounds, bounds[1:], strict=False):  # the first part belongs to the body of an earlier batch
            if own := x in starts and y > x:
                if body is not None:
                    yield _summed(body, said)
                body, said = b.column("body")[x].as_py(), []
            part = b.slice(x + own, y - x - own)
            said.append((part.column("n").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(np.int64)))
    if body is not None:
        yield _summed(body, said)


def _summed(body: dict, said: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The documents of a block, given each pair's count and whether it is a best one."""
    many, best = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (list(zip(*said, strict=True)) or ((), ())))
    of, length = _unsqueezed(body["pair_of"]), _unsqueezed(body["n_pairs"])
    ends = np.cumsum(length)
    both = np.zeros((len(of) + 1, 2), np.int64)
    np.cumsum(np.stack((best[of], many[of]), axis=1), axis=0, out=both[1:])
    each = both[ends] - both[ends - length]  # of each piece
    pieces, count = _unsqueezed(body["pieces"]), _unsqueezed(body["n_pieces"])
    total = np.zeros((len(pieces) + 1, 2), np.int64)
    np.cumsum(each[pieces] if len(each) else np.zeros((0, 2), np.int64), axis=0, out=total[1:])
    to = np.cumsum(count)
    sums = total[to] - total[to - count]
    numbers = np.array(body["numbers"], np.int64).reshape(-1, 4)
    columns = [pa.array(body["doc_id"], pa.int64()), *(pa.array(c) for c in numbers.T), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(body["groups_sha256"], pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def alignment(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Documents (doc_id, text) to one row each: how many tokens of each tokenizer, groups and links they have, how many
    links are a best one of their B id, the sum of the links' counts, and the hash of the groups."""
    held = written(blocks(docs, paths), "blocks")
    times = len(PieceModel(paths[1]).entries)
    counted = pair_counts(held, times)
    pairs = held.select("block", F.posexplode("pair").alias("pos", "pair"))
    said = pairs.join(counted, "pair").select("block", "pos", F.lit(None).alias("body"), "n", "best")
    body = F.struct("doc_id", "numbers", "groups_sha256", "pieces", "n_pieces", "n_pairs", "pair_of")
    rows = held.select("block", F.lit(-1).alias("pos"), body.alias("body"), F.lit(None).alias("n"), F.lit(None).alias("best")).unionByName(said)
    rows = rows.repartition("block").sortWithinPartitions("block", "pos")  # a block's pairs pass by, none is gathered in the JVM
    out = written(rows.select("body", "n", "best").mapInArrow(_judged, RESULT), "aligned")
    dropped(held, counted)
    return out


def groups(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Documents (doc_id, text) to doc_id and their groups, each with its byte range in a space and the text (end exclusive)
    and the ids of both; null where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32())}))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                a, b = (x[0] for x in pair.encoded([text])) if text else (None, None)
                if a is None or b is None:
                    out.append(None)
                    continue
                cuts, own_a, own_b, closes = intervals(np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b]))
                ends = [x[closes].tolist() for x in (cuts, own_a + 1, own_b + 1)]
                starts = [[0, *x[:-1]] for x in ends]
                out.append([{"start": s, "end": e, "a": a[x:u], "b": b[y:v]} for s, e, x, u, y, v in zip(starts[0], ends[0], starts[1], ends[1], starts[2], ends[2], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "groups"])

    schema = "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def products(found: DataFrame) -> DataFrame:
    """What :func:`groups` returns to every pair of a token of A and one of B within a group: doc_id, start, a, b."""
    each = found.select("doc_id", F.explode("groups").alias("g"))
    return each.select("doc_id", "g.start", F.explode("g.a").alias("a"), "g.b").select("doc_id", "start", "a", F.explode("b").alias("b"))


def op12_align(spark, sf_dir):
    """Every ``documents`` text by both tokenizers. Null and empty texts, and those whose bytes a tokenizer changes, have zeros
    and an empty hash; repeated rows count and are returned as often as they occur; an empty table gives no rows; other
    columns don't matter."""
    return alignment(table(spark, sf_dir, "documents"), (vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")))
