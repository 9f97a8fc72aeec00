"""Alignment of two tokenizers against a plain double loop over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tessera.llm import align
from tessera.llm.tokens import vocabulary
from tests.llm.conftest import SF

PATHS = (vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
TEXTS = ["", None, " ", "a", "  two  spaces ", "<|endoftext|> <s> </s> <unk>", "a▁b", "tab\tand\nline", "naïve é é ﬁ", "日本語のテキスト 🙂", "don't 12,345", "\x00 \x1c", "　wide", "the the the", "ionaiai retion" * 40]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    byte = {}
    for b in range(256):  # how the byte-level alphabet is told: printable ones stand for themselves
        byte[b] = chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b else None
    rest = iter(range(256, 600))
    back = {(byte[b] or chr(next(rest))): b for b in range(256)}
    names = {i: t for t, i in a.get_vocab().items()}
    return a, names, back, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(docs, tokenizers):
    """The contract, read word by word."""
    a, names, back, b = tokenizers
    found, counts = [], Counter()
    for doc_id, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in names[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a = ids_b = bytes_a = bytes_b = []
        spans = []
        for own in (bytes_a, bytes_b):
            ends = np.cumsum([0, *map(len, own)]).tolist()
            spans.append(list(zip(ends, ends[1:])))
        links = [(x, y) for x, (s, e) in enumerate(spans[0]) for y, (u, v) in enumerate(spans[1]) if s < v and u < e]
        counts.update((ids_a[x], ids_b[y]) for x, y in links)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        parts = []
        for s, e in zip([0, *both], both):
            sides = [",".join(str(i) for i, (u, v) in zip(ids, own) if s <= u and v <= e) for ids, own in ((ids_a, spans[0]), (ids_b, spans[1]))]
            parts.append("|".join(sides))
        found.append((doc_id, ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in links], parts))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (d, len(x), len(y), len(parts), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "")
        for d, x, y, links, parts in found
    )


def test_query_equals_a_double_loop(spark, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = spark.createDataFrame([(d, t) for d, t in docs if t is None or len(t) < 4000], "doc_id long, text string")
    assert sorted(map(tuple, align.alignment(short, PATHS).collect())) == plain([(d, t) for d, t in docs if t is None or len(t) < 4000], tokenizers)
    got = entry.queries()["op12_align"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and got.count() == len(docs)


@pytest.mark.parametrize("block, kept", [(1, 3), (1 << 24, 250_000)])
def test_odd_texts_and_blocks(spark, tokenizers, monkeypatch, block, kept):
    """Texts whose bytes a tokenizer changes, repeated rows, null ids, blocks of one batch, little memory."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (50, "  two  spaces "), (51, "the ion")]
    r = random.Random(5)
    rows += [(100 + k, "".join(r.choice(["a", "the", " ", " ", "\n", "é", "9", "　", "▁", "ion"]) for _ in range(r.randint(0, 30)))) for k in range(60)]
    pair = align.Pair(*PATHS)
    monkeypatch.setattr(align, "KEPT", kept)
    pair.clear()
    want = plain(rows, tokenizers)
    for k in range(0, len(rows), 10):
        flat, count = pair.rows_of(pa.array([t for _, t in rows[k : k + 10]]))
        for (d, text), mine in zip(rows[k : k + 10], np.split(flat, np.cumsum(count)[:-1]), strict=True):
            sums = pair.numbers[mine].sum(axis=0).tolist()
            sha = hashlib.sha256(b";".join(pair.shown[x] for x in mine)).hexdigest() if len(mine) else ""
            assert any(w[0] == d and list(w[1:5]) == sums and w[7] == sha for w in want), (d, text)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_a int").repartition(3)
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    assert sorted(map(tuple, align.alignment(docs, PATHS).collect())) == want


def test_null_ids_and_empty_tables(spark):
    got = align.alignment(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), PATHS).collect()
    assert sorted((r.doc_id, r.n_a, r.n_links) for r in got) == [(None, 0, 0), (None, 2, 2)]
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), PATHS).count() == 0


def test_groups_hold_the_texts_bytes_and_expand(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    pair = align.Pair(*PATHS)
    found = align.groups(docs, PATHS)
    for r in found.collect():
        for g in r.groups or []:
            cut = (" " + TEXTS[r.doc_id]).encode()[g.start : g.end]
            assert b"".join(pair.a.entries[i] for i in g.a) == cut == b"".join(pair.b.entries[i] for i in g.b)
    assert align.products(found).count() == sum(len(g.a) * len(g.b) for r in found.collect() for g in r.groups or [])


def test_intervals_by_hand():
    cuts, a, b, closes = align.intervals(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert (cuts.tolist(), a.tolist(), b.tolist(), closes.tolist()) == ([2, 3, 5, 6], [0, 1, 1, 2], [0, 0, 1, 2], [False, False, True, True])


def test_a_block_aligns_few_pieces_at_a_time_and_lets_go_of_its_texts(monkeypatch):
    pair, most, trims = align.Pair(*PATHS), [], []
    whole = pair.encoded
    monkeypatch.setattr(pair, "encoded", lambda pieces: most.append(len(pieces)) or whole(pieces))
    monkeypatch.setattr(align, "trim", lambda: trims.append(1))
    text = " ".join(f"w{i} {i}" for i in range(align.STEP))
    held = [pa.RecordBatch.from_pydict({"doc_id": [d], "text": [text + f" end{d}"], "part": [0]}) for d in range(3)]
    rows = [pair.rows_of(b.column("text"))[0].tolist() for b in held]
    assert max(most) <= align.STEP < sum(most)
    assert rows[0][:-1] == rows[1][:-1] and len(set(rows[0])) == len(rows[0]) == 2 * align.STEP + 1
    align._block(pair, held, 0)
    assert held == [] and len(trims) == 3
