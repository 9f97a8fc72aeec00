"""Chunking: Markdown by headings, rows of tables, and the route by content category.

The Markdown chunker works on one document and is plain Python, run in Arrow batches: a document is a tree of sections;
a section that fits is one chunk, a larger one gives its own text in pieces and then its children, and each level
merges neighbours that are too small.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import classify

# Fixed patterns.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M | re.A)
TABLE = re.compile(r"(^\|.+)\n(\|?[-:| ]+)\n((?:\|.+\n?)+)", re.M)
FENCE = re.compile(r"```[a-zA-Z0-9_]*\s*[\s\S]*?```", re.A)
BLANK_LINE = re.compile(r"\n\s*\n", re.A)
TAIL_BREAK = re.compile(r"\n\s*\n|\n\s*---\s*\n|\n\s*\*\*\*\s*\n", re.A)
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
#: As the pattern of :func:`tessera.functions.text.token_count`.
_TOKEN = re.compile(r"\w+|[^\w\x20\t\n\x0B\f\r]")


@dataclass(frozen=True)
class Preset:
    """Bounds in tokens, the overlap's share, and from which cosine on a sentence continues a chunk (None: any)."""

    least: int
    most: int
    overlap: float
    threshold: float | None = None


# Fixed values of the presets.
PRESETS = {"TECHNICAL": Preset(200, 1000, 0.10), "LEGAL": Preset(300, 1200, 0.25, 0.75), "TABLE_HEAVY": Preset(100, 800, 0.05), "GENERAL": Preset(100, 512, 0.10)}


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def hashed_embedder(sentence: str, dim: int = 64) -> np.ndarray:
    """The default embedder: signed hashed words, without a model."""
    import zlib

    out = np.zeros(dim)
    for w in re.findall(r"\w+", sentence.lower()):
        h = zlib.crc32(w.encode())
        out[h % dim] += 1 if h >> 31 else -1
    return out


@dataclass
class Section:
    level: int
    title: str
    content: str
    children: list[Section] = field(default_factory=list)

    def text(self) -> str:
        own = "".join(f"{x}\n" for x in (self.title, self.content) if x)
        return (own + "".join(f"{c.text()}\n" for c in self.children)).rstrip()

    def tokens(self, count: Callable[[str], int]) -> int:
        return sum(count(x) for x in (self.title, self.content) if x) + sum(c.tokens(count) for c in self.children)


@dataclass
class Chunk:
    text: str
    tokens: int
    prefix: str


def sections(text: str, literal: bool = False) -> list[Section]:
    """The tree of sections. Text before the first heading is a section above all. Headings within fences are text,
    unless ``literal``."""
    fences = [] if literal else [m.span() for m in FENCE.finditer(text)]
    heads = [m for m in HEADING.finditer(text) if not any(a <= m.start() < b for a, b in fences)]
    if not heads:
        return [Section(0, "", text.strip())]
    before = text[: heads[0].start()].strip()
    ends = [m.start() for m in heads[1:]] + [len(text)]
    flat = [Section(0, "", before)] if before else []
    flat += [Section(len(m[1]), m[0], text[m.end() : end].strip()) for m, end in zip(heads, ends, strict=True)]
    roots: list[Section] = []
    path: list[Section] = []
    for s in flat:
        path = path[: next((i for i, p in enumerate(path) if p.level >= s.level), len(path))]
        (path[-1].children if path else roots).append(s)
        path.append(s)
    return roots


class Chunker:
    def __init__(self, preset: Preset, count: Callable[[str], int] = count_tokens, embed: Callable[[str], np.ndarray] | None = None, joiner: str = ""):
        self.p, self.count, self.joiner = preset, count, joiner
        self.embed = embed if preset.threshold is not None else None

    def chunks(self, text: str | None) -> list[Chunk]:
        return self._overlapped(self._level(sections(text), "")) if (text or "").strip() else []

    def _level(self, level: list[Section], prefix: str) -> list[Chunk]:
        out: list[Chunk] = []
        for s in level:
            name = re.sub(r"^#+\s+", "", s.title, count=1).strip()
            own = prefix if not s.title else f"{prefix} > {name}" if prefix else name
            if s.tokens(self.count) <= self.p.most:
                if (text := s.text()).strip():
                    out.append(self._chunk(text, self.count(text), own))
                continue
            if not s.children or s.title or s.content:
                out += self._pieces(s.title + "\n" if s.title else "", s.content, own)
            if s.children:
                out += self._level(s.children, own)
        return self._merged(out)

    def _chunk(self, text: str, tokens: int, prefix: str) -> Chunk:
        return Chunk(f"**上下文**: {prefix}\n\n{text}" if prefix else text, tokens, prefix)

    def _pieces(self, head: str, content: str, prefix: str) -> list[Chunk]:
        """A long section's text: blocks gathered up to the bound, each piece under the section's title."""
        out: list[Chunk] = []
        base = self.count(head)
        held, size = head, base

        def close() -> None:
            nonlocal held, size
            out.append(self._chunk(held.rstrip(), size, prefix))
            held, size = head, base

        for block, divisible in blocks(content):
            n = self.count(block)
            if n > self.p.most:
                if held != head:
                    close()
                out += self._sentences(head, block, prefix) if divisible else [self._chunk(head + block, base + n, prefix)]
                continue
            if size + n > self.p.most:
                close()
            held, size = f"{held}{block}\n", size + n
        if held != head:
            close()
        return out

    def _vectors(self, parts: list[str]) -> list[np.ndarray | None] | None:
        """Vectors of sentences, None for one without any; None at all, so that length alone cuts, if the embedder fails."""
        if not self.embed:
            return None
        try:
            return [self.embed(s) for s in parts]
        except Exception:  # whatever a model raises
            return None

    def _sentences(self, head: str, block: str, prefix: str) -> list[Chunk]:
        parts = [s for s in (x.strip() for x in SENTENCE.split(block)) if s] or [block.strip()]
        vectors = self._vectors(parts)
        base = self.count(head)
        out: list[Chunk] = []
        held: list[int] = []
        size, mean = base, None

        def close() -> None:
            out.append(self._chunk((head + self.joiner.join(parts[i] for i in held)).rstrip(), size, prefix))

        for i, s in enumerate(parts):
            n = self.count(s)
            own = vectors[i] if vectors is not None else None
            shift = vectors is not None and held and (own is None or mean is None or cosine(mean, own) < self.p.threshold)
            if held and (size + n > self.p.most or shift):
                close()
                held, size, mean = [], base, None
            if own is not None:
                mean = own.astype(float) if mean is None else (mean * len(held) + own) / (len(held) + 1)
            held.append(i)
            size += n
        if held:
            close()
        return out

    def _merged(self, chunks: list[Chunk]) -> list[Chunk]:
        out: list[Chunk] = []
        for c in chunks:
            last = out[-1] if out else None
            if last and last.tokens < self.p.least and last.tokens + c.tokens <= self.p.most and last.prefix == c.prefix:
                text = f"{last.text}\n\n{c.text}"
                out[-1] = Chunk(text, self.count(text), c.prefix)
            else:
                out.append(c)
        return out

    def _overlapped(self, chunks: list[Chunk]) -> list[Chunk]:
        """Each chunk but the first led by the last paragraphs of the one before it, as it was."""
        out = chunks[:1]
        for before, c in zip(chunks, chunks[1:], strict=False):
            room = min(math.ceil(before.tokens * self.p.overlap), self.p.most - c.tokens)
            tail = self._tail(before.text, room) if self.p.overlap > 0 and room > 0 else ""
            text = f"{tail}\n{c.text}"
            out.append(Chunk(text, self.count(text), c.prefix) if tail else c)
        return out

    def _tail(self, text: str, room: int) -> str:
        taken: list[str] = []
        used = 0
        for p in reversed([x.strip() for x in TAIL_BREAK.split(text) if x.strip()]):
            n = self.count(p)
            if taken and used + n > room:
                break
            taken.insert(0, p)
            used += n
        return "\n\n".join(taken)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def blocks(content: str) -> Iterator[tuple[str, bool]]:
    """Fences and pipe tables whole, the rest by paragraphs: (text, whether it may be divided)."""
    spans = [m.span() for m in FENCE.finditer(content)]
    spans += [m.span() for m in TABLE.finditer(content) if not any(a < m.end() and b > m.start() for a, b in spans)]
    at = 0
    for start, end in [*sorted(spans), (len(content), len(content))]:
        for p in BLANK_LINE.split(content[at:start].strip()):
            if p.strip():
                yield p.strip() + "\n", True
        if end > start:
            yield content[start:end] + "\n", False
        at = end


CHUNKS = "array<struct<text:string,tokens:int,prefix:string>>"
_CHUNKS = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32()), ("prefix", pa.string())]))


#: Bytes of text whose chunks a worker holds at a time, unless one text is longer.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices of PART_BYTES of text, at about, so that what is made of them doesn't grow with Spark's
    batches, which hold 10,000 rows however long."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(batch):
        upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, side="right"))
        yield batch.slice(at, max(upto - at, 1))
        at = max(upto, at + 1)


def cut(docs: DataFrame, presets: dict[str, Preset] | None = None, count=count_tokens, embed=hashed_embedder, joiner: str = "", safe: bool = False) -> DataFrame:
    """(doc_id, text), and ``category`` where known, to (doc_id, chunks, error), a row for each row. If ``safe``, what a
    document's chunking raises is its error and it has no chunks; else it ends the job."""
    presets = presets or PRESETS
    routed = docs.select("doc_id", "text", "category") if "category" in docs.columns else classify.categorised(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunkers = {k: Chunker(p, count, embed, joiner) for k, p in presets.items()}
        for b in (part for whole in batches for part in parts(whole)):
            out, errors = [], []
            for text, kind in zip(b.column("text").to_pylist(), b.column("category").to_pylist(), strict=True):
                try:
                    out.append([vars(c) for c in chunkers.get(kind, chunkers["GENERAL"]).chunks(text)])
                    errors.append(None)
                except Exception as e:  # whatever a hook raises
                    if not safe:
                        raise
                    out.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, _CHUNKS), pa.array(errors, pa.string())], ["doc_id", "chunks", "error"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return routed.select("doc_id", "text", "category").mapInArrow(run, f"doc_id {kind}, chunks {CHUNKS}, error string")


def markdown_chunks(docs: DataFrame, presets: dict[str, Preset] | None = None, **options) -> DataFrame:
    """(doc_id, text), and ``category`` where known, to (doc_id, chunk_index, chunk_total, text, tokens, prefix); options
    are those of :func:`cut`."""
    found = cut(docs, presets, **options)
    return found.select("doc_id", F.size("chunks").alias("chunk_total"), F.posexplode("chunks").alias("chunk_index", "c")).select("doc_id", "chunk_index", "chunk_total", "c.*")


def row_chunks(docs: DataFrame) -> DataFrame:
    """Tables as text: each row that isn't blank under the first line; texts of one line give nothing."""
    lines = F.split(F.regexp_replace("text", r"\n+$", ""), "\n")
    rows = docs.select("doc_id", lines.alias("lines")).where(F.size("lines") > 1)
    rows = rows.select("doc_id", F.trim(F.element_at("lines", 1)).alias("head"), "lines").select("doc_id", "head", F.posexplode("lines").alias("row", "line"))
    rows = rows.where((F.col("row") > 0) & (F.trim("line") != ""))
    text = F.concat("head", F.lit("\n"), F.trim("line"))
    return rows.select("doc_id", "row", text.alias("text"), T.token_count(text).alias("tokens"), F.lit("ExcelRow").alias("prefix"))


def routed(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(doc_id, format, text): tables by rows, all else by category; short tables count as text. Chunks, and (doc_id,
    error) of the documents whose chunking failed."""
    table = F.coalesce(F.upper("format").isin("EXCEL", "CSV", "XLS", "XLSX"), F.lit(False)) & (F.size(F.split(F.regexp_replace("text", r"\n+$", ""), "\n")) > 1)
    rows = row_chunks(docs.where(table)).select("doc_id", (F.col("row") - 1).alias("chunk_index"), "text", "tokens", "prefix")
    found = cut(docs.where(~F.coalesce(table, F.lit(False))), safe=True, **options)
    rest = found.select("doc_id", F.posexplode("chunks").alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.text", "c.tokens", "c.prefix")
    return rows.unionByName(rest), found.where("error IS NOT NULL").select("doc_id", "error")


def routed_chunks(docs: DataFrame, **options) -> DataFrame:
    """The chunks of :func:`routed`."""
    return routed(docs, **options)[0]
