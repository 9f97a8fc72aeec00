import base64
import hashlib
import io

import pytest
import zstandard

from tessera.llm import warc

PAGES = [(3, "http://a/1", "<p>same</p>"), (1, "http://a/2", "<p>same</p>"), (2, None, None), (4, "http://a/ü\n", ""), (5, "http://a/5", "<p>é😀</p>" * 5000), (5, "http://a/5", "<p>é😀</p>" * 5000), (None, "http://n", "<p>same</p>"), (6, "u", "a\r\n\r\nWARC/1.1\r\n")]


def rows(spark, pages=PAGES):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_round_trip(spark):
    df = rows(spark).withColumnsRenamed({}).selectExpr("*", "1 AS digest", "2 AS first")
    out = warc.read(warc.archives(df, b"")).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        again = first is not None and i != first
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=str)
    assert {bytes(r.payload) for r in out if r.record_type == "response"} == {(h or "").encode() for _, _, h in PAGES}


def test_dictionary_and_least_bytes(spark):
    pages = [(i, f"http://h/{i}", f"<html><body>page {i} of the site with the usual frame {i * 7}</body></html>" * 9) for i in range(200)]
    df = rows(spark, pages + [(900, "u", "xy"), (901, "u", "xy")])
    data = warc.train_dictionary(df)
    assert data
    out = {r.page_id: r for r in warc.read(warc.archives(df, data, least=3, size=4000)).collect()}
    assert len(out) == 202 and out[901].record_type == "response" and bytes(out[7].payload).decode() == pages[7][2]


def test_empty_table(spark):
    assert warc.read(warc.archives(rows(spark).limit(0), warc.train_dictionary(rows(spark).limit(0)))).collect() == []


def test_files_from_a_folder(spark, tmp_path):
    data = warc.dictionary_frame(b"plain bytes as a dictionary " * 20) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"plain bytes as a dictionary " * 20)).compress(warc.record(8, "u", b"x", None))
    (tmp_path / "a.warc.zst").write_bytes(data)
    assert [r.page_id for r in warc.read(warc.files(spark, str(tmp_path))).collect()] == [8]


def test_files_that_this_library_wrote(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    few = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(5)]  # too few to train a dictionary from
    many = [(100 + i, f"http://h/{i}", f"<html><body>page {i} of the site with the usual frame {i * 7}</body></html>" * 9) for i in range(200)]
    for pages in (few, many):
        df = rows(spark, pages)
        found = warc.archives(df, warc.train_dictionary(df), size=20_000)
        manifest = warc.save(found, folder)
        assert sorted(r.name for r in manifest.collect()) == sorted(p.name for p in (tmp_path / "archives").iterdir())
        names = sorted(p.name for p in (tmp_path / "archives").iterdir())
        assert all(n.endswith(".warc.zst") for n in names)
        for n in names:
            data = (tmp_path / "archives" / n).read_bytes()
            assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        out = {r.page_id: bytes(r.payload).decode() for r in warc.read(warc.files(spark, folder)).collect()}
        assert out == {i: h for i, _, h in pages}
        for n in names:
            (tmp_path / "archives" / n).unlink()


def test_a_repeated_attempt_with_another_cut(spark, tmp_path):
    """What an attempt left that wasn't committed is not read, also if it cut the pages otherwise or broke off."""
    folder = f"file://{tmp_path}/archives"
    df = rows(spark, [(i, f"http://h/{i}", f"<p>{i}</p>" * 20) for i in range(200)])
    warc.save(warc.archives(df, b"", size=2_000), folder)  # its manifest is lost
    (tmp_path / "archives" / "part-000000-000000-cut.warc.zst").write_bytes(b"(\xb5/\xfd")
    assert len(list((tmp_path / "archives").iterdir())) > 3
    manifest = warc.save(warc.archives(df, b"", size=1 << 20), folder)
    found = warc.read(warc.stored(manifest, folder)).collect()
    assert sorted(r.page_id for r in found) == list(range(200))


def packed(*records):
    return b"".join(zstandard.ZstdCompressor().compress(r) for r in records)


@pytest.mark.parametrize(
    "data",
    [
        packed(warc.record(1, "u", b"x", None))[:-3],
        packed(warc.record(1, "u", b"x", None)[:-1]),
        packed(warc.record(1, "u", b"xyz", None).replace(b"xyz", b"xyy")),
        packed(b"HTTP/1.1\r\n\r\n"),
        packed(warc.record(1, "u", b"x", None).replace(b"WARC-Date: ", b"Other: ")),
        b"\x00\x01\x02\x03",
        (0x184D2A5D).to_bytes(4, "little") + (100).to_bytes(4, "little") + b"short",
    ],
)
def test_malformed_archives_are_errors(data):
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.records(io.BytesIO(data)))


def test_frames_that_expand_too_far():
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(packed(warc.record(1, "u", b"x" * 10**6, None))), most=1000))
