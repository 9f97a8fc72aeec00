"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself possibly compressed, and then
one frame a record. The reader takes frames off a stream as they come, so its memory holds one record, and checks
version line, required headers, lengths and digests.

Pages with equal payloads are written once: the smallest page_id is the response, the others are revisit records that
refer to it and keep its HTTP headers. Archives have a bounded size; :func:`save` writes them as files, to any store
that pyarrow can write to, and :func:`files` reads files with Spark's own ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table, written

# Fixed values of the formats.
#: How names of archive files end.
ENDING = ".warc.zst"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 4 << 20
#: The dictionary, of raw content, where there are too few pages to train one from.
BUILT_IN = b"".join(
    [
        b"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><meta name=\"viewport\" content=\"width=device-width, initial-scale=1\"><title></title>",
        b"<link rel=\"stylesheet\" href=\"/style.css\"><script src=\"/script.js\"></script></head><body><nav><ul><li><a href=\"/\"></a></li></ul></nav>",
        b"<div class=\"\"><h1></h1><p></p><span></span><img src=\"\" alt=\"\"><table><tr><td></td></tr></table></div><footer></footer></body></html>",
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: https://www.",
        b"\r\nWARC-Payload-Digest: sha1:\r\nWARC-Block-Digest: sha1:\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ",
        b"\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ",
    ]
)
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Pages from which the dictionary is trained, at most so many bytes of each, and its size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 16, 1 << 16
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or frame that isn't as the formats want it."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, gap, payload = self.block.partition(b"\r\n\r\n")
        if not gap:
            raise WarcError("HTTP headers without end")
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(value: str) -> str:
    return "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{x:02X}" for x in c.encode()) for c in value)


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page ``refers_to``, as bytes."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _safe(url) if url else urn(page_id)[1:-1]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    """One record; WarcError if it is not whole and consistent."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError(f"not a record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:40]!r}")
        headers[name] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise WarcError(f"without {', '.join(missing)}")
    length = headers["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    out = Record(headers, rest[:-4])
    if (said := headers.get("WARC-Block-Digest")) and said != f"sha1:{digest(out.block)}":
        raise WarcError("block digest differs")
    if headers["WARC-Type"] == "response" and (said := headers.get("WARC-Payload-Digest")) and said != f"sha1:{digest(out.http[1])}":
        raise WarcError("payload digest differs")
    return out


def dictionary_frame(dictionary: bytes) -> bytes:
    data = zstandard.ZstdCompressor().compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


class _Stream:
    """A stream that can take bytes back."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.back = raw, b""

    def read(self, n: int) -> bytes:
        out, self.back = self.back[:n], self.back[n:]
        return out + self.raw.read(n - len(out)) if len(out) < n else out


def records(raw: BinaryIO, most: int = 1 << 31) -> Iterator[Record]:
    """Records of an archive. A frame that expands to more than ``most`` bytes is an error, as is anything cut short."""
    stream = _Stream(raw)
    decoder = zstandard.ZstdDecompressor()
    first = True
    while magic := stream.read(4):
        number = int.from_bytes(magic, "little")
        if 0x184D2A50 <= number <= 0x184D2A5F:
            size = int.from_bytes(stream.read(4), "little")
            data = stream.read(size)
            if len(data) != size:
                raise WarcError("skippable frame cut short")
            if number == DICTIONARY_MAGIC and first:
                if data[:4] == FRAME_MAGIC:
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        elif magic == FRAME_MAGIC:
            one, out, size, data = decoder.decompressobj(), [], 0, magic
            while not one.eof:
                if not data:
                    raise WarcError("frame cut short")
                out.append(one.decompress(data))
                size += len(out[-1])
                if size > most:
                    raise WarcError(f"a frame of more than {most} bytes")
                data = b"" if one.eof else stream.read(1 << 16)
            stream.back = one.unused_data + stream.back
            yield parse(b"".join(out))
        else:
            raise WarcError(f"unknown frame {magic.hex()}")
        first = False


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from SAMPLE_PAGES pages at most, those of smallest hash, or the one built in if they are too few
    or too alike to train from. The hashes are ranked alone, so the payloads that meet in the driver are those of the sample only."""
    rows = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "html").alias("k"), "html")
    last = [r["k"] for r in rows.select("k").distinct().orderBy("k").limit(SAMPLE_PAGES).collect()]
    if len(last) < 16:
        return BUILT_IN
    picked = rows.where(F.col("k") <= last[-1]).groupBy("k").agg(F.first(F.encode(F.substring("html", 1, SAMPLE_BYTES), "UTF-8")).alias("d"))
    sample = [bytes(r["d"]) for r in sorted(picked.collect())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return BUILT_IN


def archives(pages: DataFrame, dictionary: bytes, least: int = LEAST_BYTES, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id long, url, html) to archives (name, content), one record a row.

    A null html is an empty payload. A null page_id is never referred to; a payload that only such rows have is a
    response in each. Rows that repeat both the smallest page_id and its payload are all responses.
    """
    dictionary = dictionary or BUILT_IN
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    small = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = small.distinct().join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    placed = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        lead = dictionary_frame(dictionary)
        part, n, held = TaskContext.get().partitionId(), 0, [lead]

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}{ENDING}"]), pa.array([b"".join(held)], pa.binary())], ["name", "content"])

        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                held.append(packer.compress(record(page_id, url, html.encode(), refers)))
                if sum(map(len, held)) - len(lead) >= size if len(held) % 64 == 0 else len(held[-1]) >= size:
                    yield close()
                    n, held = n + 1, [lead]
        if len(held) > 1:
            yield close()

    return placed.mapInArrow(run, "name string, content binary")


def save(found: DataFrame, folder: str) -> DataFrame:
    """Write archives (name, content) as files of a folder that all executors reach; the manifest of them (name). An
    attempt's files have names that no other attempt gives, and the manifest, which Spark commits, lists those of the
    attempts that ended well: what a lost executor leaves behind, whole or cut, stands in the folder but in no manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            names = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                names.append(f"{name.removesuffix(ENDING)}-{uuid.uuid4().hex}{ENDING}")
                with store.open_output_stream(f"{root}/{names[-1]}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return written(found.mapInArrow(run, "name string"), "archive-names")


def stored(manifest: DataFrame, folder: str) -> DataFrame:
    """The archives (name, content) of a manifest, from the folder that :func:`save` wrote."""
    n, cores = manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([file.read()], pa.binary())], ["name", "content"])

    return manifest.select("name").repartition(max(1, min(n, 8 * cores), n // 16), "name").mapInArrow(run, "name string, content binary")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files under a path, in any store that Spark reads, as (name, content)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(path)
    return found.select(F.col("path").alias("name"), "content")


def _page(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def read(found: DataFrame) -> DataFrame:
    """Archives (name, content) to their records: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload, null for a revisit. A malformed archive is an error. A worker holds the archives of one input split."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows: list[tuple] = []
                for r in records(io.BytesIO(b.column("content")[i].as_py())):
                    head, payload = r.http
                    kind = r.headers["WARC-Type"]
                    size = len(payload) if kind == "response" else int(head["content-length"])
                    if kind == "response" and int(head["content-length"]) != size:
                        raise WarcError("payload of another length than its HTTP header says")
                    rows.append((_page(r.headers["WARC-Record-ID"]), r.headers.get("WARC-Target-URI"), size, r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, _page(r.headers.get("WARC-Refers-To")), payload if kind == "response" else None))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return found.select("content").mapInArrow(run, schema)


def op3_warc(spark, sf_dir):
    """A record for each row of ``pages``, written to archive files and read back from them; see :func:`archives` for null
    and repeated rows."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    folder = shared_folder(spark, "archives")
    manifest = save(archives(pages, train_dictionary(pages)), folder)
    return read(stored(manifest, folder)).drop("url", "payload")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::INT, 5))::INT) AS v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM d)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(v, lambda x: a[(x >> 15) + 1] || a[((x >> 10) & 31) + 1] || a[((x >> 5) & 31) + 1] || a[(x & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM b
"""
