"""Token ids of many texts by public tokenizers, a word's ids computed once a worker.

Both tokenizers work on pieces that begin at a space which no other space precedes and no white space follows: the
byte-level one splits there before it merges, whatever other white space may stand before, and no entry of the other
holds a space after anything else (checked when it is loaded). A text is cut there, each new piece is encoded by the
tokenizer itself, and the text's ids are those of its pieces in order. Pieces are kept up to a bounded number.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Pieces that a worker keeps, and characters of the longest of them; new pieces encoded as one text.
KEPT, LONGEST, TOGETHER = 600_000, 48, 256


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def loose(piece: str) -> bool:
    """Whether a piece begins with, or is, white space, and so can't stand after others."""
    return not piece or piece[0].isspace()


def cut(parts: list[str]) -> list[str]:
    """``parts``, a text split at every space, joined again wherever it may not be cut."""
    out = parts[:1]
    for p in parts[1:]:
        if not loose(p) and out[-1] and out[-1][-1] != " ":
            out.append(p)
        else:
            out[-1] += " " + p
    return out


class Pieces:
    """What ``make`` says of pieces, each a text without its leading space, remembered for later ones. ``make`` gets new
    pieces and returns a value for each."""

    def __init__(self, make: Callable[[list[str]], list], kept: int = KEPT, longest: int = LONGEST):
        self.make, self.kept, self.longest = make, kept, longest
        self.held: dict[str, object] = {}

    def of(self, texts: pa.Array, lead: bool) -> tuple[list, np.ndarray, np.ndarray, list[str]]:
        """The values of different pieces, the places among these of all texts' pieces, text after text, where each text's
        begin, and the end, and the first piece of each. ``lead``: of a space and the text; else the first piece, which no
        space precedes, is not among the places. Nulls are empty texts."""
        if len(self.held) > self.kept:  # what was met first is what is met often
            self.held = dict(islice(self.held.items(), self.kept // 2))
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        flat = lists.flatten().dictionary_encode()
        names, index = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        first = np.zeros(len(index) + 1, bool)
        first[at[:-1]] = True
        own = np.ones(len(index), bool) if lead else ~first[:-1]
        odd = np.fromiter(map(loose, names), bool, len(names))
        if odd.any() and (bad := np.unique(np.searchsorted(at, np.flatnonzero(odd[index] & own), "right") - 1)).size:
            index, own, at = self._cut(names, index, own, at, bad, lead)
        used = np.zeros(len(names), bool)
        used[index[own]] = True
        held = self.held
        if new := [names[i] for i in np.flatnonzero(used).tolist() if names[i] not in held]:
            held.update(zip(new, self.make(new), strict=True))
        values = [held.get(n) for n in names]
        for n in new:  # those too long to keep
            if len(n) > self.longest:
                del held[n]
        kept = np.concatenate(([0], np.cumsum(own)))
        return values, index[own], kept[at], [names[i] for i in index[at[:-1]].tolist()]

    @staticmethod
    def _cut(names: list[str], index: np.ndarray, own: np.ndarray, at: np.ndarray, bad: np.ndarray, lead: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with some texts' pieces joined again where these may not be cut; their new names are added."""
        known = {n: i for i, n in enumerate(names)}
        parts, flags, length = np.split(index, at[1:-1]), np.split(own, at[1:-1]), np.diff(at)
        for d in bad.tolist():
            joined = cut([names[i] for i in parts[d].tolist()])
            parts[d] = np.array([known.setdefault(p, len(known)) for p in joined], index.dtype)
            flags[d] = np.ones(len(joined), bool)
            flags[d][0] = lead
            length[d] = len(joined)
        names += list(known)[len(names) :]
        return np.concatenate(parts), np.concatenate(flags), np.concatenate(([0], np.cumsum(length)))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each length, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def together(encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, pieces: list[str], entries: list[bytes] | None = None) -> Iterator[tuple[list[int], np.ndarray | None, list[int]]]:
    """Ids of a space and each piece: the places of some pieces, the ids of all these, and where each one's end; no ids for a
    piece of which they aren't the bytes. ``encode`` does it for texts, ``lengths`` are the ids' numbers of bytes; where
    bytes may be changed they are held against ``entries``. Pieces are encoded many together and parted by their bytes."""
    firm = [i for i, p in enumerate(pieces) if not loose(p)]
    groups = [firm[k : k + TOGETHER] for k in range(0, len(firm), TOGETHER)] + ([[i] for i, p in enumerate(pieces) if loose(p)] if len(firm) < len(pieces) else [])
    while groups:
        again = []
        parts = [[pieces[i] for i in g] for g in groups]
        for g, part, ids in zip(groups, parts, encode([" ".join(p) for p in parts]), strict=True):
            own = np.array(ids, np.int64)
            ends = np.cumsum(lengths[own])
            cuts = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            at = np.searchsorted(ends, cuts)
            same = entries is None or b"".join(map(entries.__getitem__, ids)) == b" " + " ".join(part).encode()
            if same and len(own) and at[-1] == len(own) - 1 and (ends[at] == cuts).all():
                yield g, own, (at + 1).tolist()
            elif len(g) > 1:
                again += [[i] for i in g]
            else:
                yield g, None, []
        groups = again


def encoded(encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, pieces: list[str], entries: list[bytes]) -> list[np.ndarray | None]:
    """What :func:`together` says, piece by piece."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    for g, own, to in together(encode, lengths, pieces, entries):
        if own is not None:
            for i, x, y in zip(g, [0, *to], to, strict=False):
                out[i] = own[x:y]
    return out


class ByteLevel:
    """The byte-level tokenizer of a file of the tokenizers library. ``plain``: strings of special tokens within texts are
    ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.entries = self.bytes_of()
        self.lengths = np.array([len(x) for x in self.entries], np.int64)
        self.pieces = Pieces(self.made)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.width).tobytes() for ids in self.encode(texts)]

    def made(self, pieces: list[str]) -> list[bytes]:
        """Ids of a space and each piece."""
        out, wide = [b""] * len(pieces), self.width.itemsize
        for g, own, to in together(lambda texts: self.encode([" " + t for t in texts]), self.lengths, pieces):
            if own is None:  # not parted by bytes after all
                out[g[0]] = self.packed([" " + pieces[g[0]]])[0]
                continue
            raw = own.astype(self.width).tobytes()
            for i, x, y in zip(g, [0, *to], to, strict=False):
                out[i] = raw[x * wide : y * wide]
        return out

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each whole text, little-endian numbers of ``width``; of null and empty ones none."""
        values, index, at, heads = self.pieces.of(texts, lead=False)
        known = [v or b"" for v in values]
        length = np.fromiter(map(len, known), np.int64, len(known)) // self.width.itemsize
        all_ids = np.frombuffer(b"".join(known), self.width)
        mine = length[index]
        raw = all_ids[spread((np.cumsum(length) - length)[index], mine)].tobytes()
        ends = (np.concatenate(([0], np.cumsum(mine)))[at] * self.width.itemsize).tolist()
        return [h + raw[x:y] for h, x, y in zip(self.packed(heads), ends, ends[1:], strict=False)]

    def bytes_of(self) -> list[bytes]:
        """Bytes of each id: an entry's characters stand for bytes, one each."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        out = [b""] * self.tokenizer.get_vocab_size()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        for entry, i in self.tokenizer.get_vocab().items():
            out[i] = entry.encode() if i in special else bytes(byte[c] for c in entry)
        return out


class PieceModel:
    """The tokenizer of a file of the sentencepiece library, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether texts may be cut before a space.
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.entries = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.entries], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
