"""Words, shingles and n-grams of many texts at once, as 64-bit hashes computed by numpy on the UTF-8 bytes.

No Python object is made for a word. The hash of a run of bytes is a polynomial over a random value for each byte,
modulo 2**64, taken from one running sum (the multiplier is odd, so its powers can be divided out), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_powers: dict[str, np.ndarray] = {}
#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words where punctuation parts words too: ASCII letters, digits, and all of other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, PIECE + 65536)
        inverse = pow(_MULT, -1, 1 << 64)
        for name, base in (("up", _MULT), ("down", inverse)):
            p = np.full(size, U(base & _MASK))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of some texts: byte positions in ``data``, the number of the text, and the hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sums: np.ndarray

    def hashes(self) -> np.ndarray:
        return mix(self.hash_of(self.start, self.end))

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hash of the bytes from start to end."""
        return (self.sums[end] - self.sums[start]) * _power(len(self.data))[1][start]

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def _strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; a null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(from, to) of the rows of pieces of about ``most`` bytes."""
    _, offsets = _strings(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def words(texts: pa.Array, part: np.ndarray | None = None, lower: bool = False) -> Words:
    """Maximal runs of bytes that belong to words: those not in SPACE, or those in ``part``. ``lower`` turns A-Z into a-z."""
    data, offsets = _strings(texts)
    if lower:
        data = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    inside = ~SPACE[data] if part is None else part[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * _power(n)[0][:n], out=sums[1:])
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, start, end, doc, sums)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, U)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(_MULT)
        out += h[j : j + n]
    return mix(out)


def firsts(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of n documents starts among rows sorted by document, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))
