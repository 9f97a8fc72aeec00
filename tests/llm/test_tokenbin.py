"""Files of token ids against plain encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tessera.llm import tokenbin
from tessera.llm.common import shared_folder
from tessera.llm.tokenbin import EliasFano, Shard
from tessera.llm.tokens import ByteLevel, PieceModel, Pieces, cut, vocabulary
from tests.llm.conftest import SF, prose

PATH = vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\n\n b\tc", " lead", "trail ", "x<|endoftext|>y <|endoftext|> z", "don't you'll  '", "日本語 テキスト", "naïve  é é", "1234 567,8", "  a  b", "a" * 3000, "\x1c a \x1c"]


def plain(rows):
    """(doc_id, text) in order to (doc_id, start, n_tokens, crc)."""
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("values", [[0], [0, 0, 0, 0], [0, 1, 2, 3], [5, 5, 1 << 40, (1 << 62) + 7], list(range(0, 5000, 7)), []])
def test_elias_fano_round_trip(values):
    got, end = EliasFano.load(memoryview(data := EliasFano.of(np.array(values, np.uint64)).dump()))
    assert end == len(data) and got.select(np.arange(len(values))).tolist() == values


def test_elias_fano_is_small_and_selects_anywhere():
    r = np.random.default_rng(1)
    values = np.cumsum(r.integers(0, 3000, 200_000))
    held = EliasFano.of(values)
    some = r.integers(0, len(values), 999)
    assert held.select(some).tolist() == values[some].tolist()
    assert len(held.dump()) * 8 / len(values) < 2.2 + np.log2(values[-1] / len(values)) + 1  # bits a value, of 64 in a table


def test_pieces_give_what_whole_texts_give():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["a", "Bc", " ", " ", "\n", "é", "'s", "9", "!", "　", "日"]) for _ in range(r.randint(0, 60))) for _ in range(800)]
    encoder, whole = ByteLevel(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from what it remembers
        assert [np.frombuffer(x, encoder.width).tolist() for x in encoder.ids(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_bounded():
    held = Pieces(lambda new: new, kept=5, longest=4)
    for k in range(10):
        held.of(pa.array([f"a{k} b{k} longer{k}"]), lead=True)
        assert len(held.held) <= 8 and not any(len(p) > 4 for p in held.held)
    assert cut(["", "a", "", "b\n", "c", "d"]) == [" a  b\n", "c", "d"]
    values, index, at, heads = held.of(pa.array(["x y", None, "", " z", "u  v w"]), lead=False)
    assert [[values[i] for i in index[a:b]] for a, b in zip(at, at[1:])] == [["y"], [], [], ["z"], ["w"]] and heads == ["x", "", "", "", "u  v"]


def test_a_shard_reads_one_document_at_a_time():
    data = Shard.pack([None, -5, 2**62], [2, 1, 3], [np.array(x, "<u2").tobytes() for x in ([7, 2], [2], [9, 8, 2])], 2)
    s = Shard(data)
    assert s.doc_ids() == [None, -5, 2**62] and [s.document(i).tolist() for i in range(3)] == [[7, 2], [2], [9, 8, 2]] and s.offsets().tolist() == [0, 2, 3, 6]
    for bad in (data[:-1], b"X" + data[1:]):
        with pytest.raises(ValueError):
            Shard(bad)


def test_query_equals_plain_encoding(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(map(tuple, entry.queries()["op13_tokenbin"](spark, SF).collect())) == plain(docs)


def test_files_of_odd_rows(spark):
    """Null and repeated ids, null texts, many files, columns that clash."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, "a\n\n b\tc"), (-(2**62), "far"), (2**62, "far"), (9, None)] + [(100 + k, " ".join(prose(k, 40))) for k in range(50)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, start string, h int")
    folder = shared_folder(spark, "tokens")
    manifest = tokenbin.write(docs, folder, PATH, shard=500)
    got = tokenbin.read(manifest, folder, ids=True).collect()
    assert manifest.count() > 3 and len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    whole = Tokenizer.from_file(PATH)
    encoded = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((d or 0, encoded(t)) for d, t in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens


def test_files_of_failed_attempts_are_not_read(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    folder = shared_folder(spark, "tokens")
    first = tokenbin.write(docs, folder, PATH)
    again = tokenbin.write(docs, folder, PATH)  # the same folder, as if the first had been lost
    assert tokenbin.read(again, folder).count() == 2 == tokenbin.read(first, folder).count()
    store, root = fs.FileSystem.from_uri(folder)
    assert len(store.get_file_info(fs.FileSelector(root))) > manifest_files(again)


def manifest_files(manifest):
    return manifest.select("name").distinct().count()


def test_an_empty_table_gives_no_rows(spark):
    folder = shared_folder(spark, "tokens")
    assert tokenbin.read(tokenbin.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH), folder).count() == 0


def test_piece_model_may_be_cut_at_spaces():
    assert PieceModel(vocabulary("piece_bpe_32k.model")).cuts
