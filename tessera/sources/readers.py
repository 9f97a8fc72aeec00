"""Reading documents: text files, Word files, tables as text, and the route by extension."""

from __future__ import annotations

import io
import json
import re
import subprocess
import tempfile
import threading
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

MOST_MB = 500
# Formats by extension.
FORMATS = {"pdf": "PDF", "docx": "DOCX", "doc": "DOCX", "md": "MD", "txt": "TXT", "html": "HTML", "htm": "HTML", "xlsx": "EXCEL", "xls": "EXCEL", "excel": "EXCEL", "csv": "CSV", "png": "IMAGE_PNG", "jpg": "IMAGE_JPG", "jpeg": "IMAGE_JPG"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def format_of(name: Column | str) -> Column:
    extension = T.file_extension(name)
    out = F.when(extension == "md", "MD")
    for e, kind in FORMATS.items():
        out = out.when(extension == e, kind)
    return out.otherwise("UNKNOWN")


def files(spark: SparkSession, path: str, most_mb: int = MOST_MB) -> DataFrame:
    """Files under a path as (path, file_name, format, length, content). Larger ones are left out by Spark before they
    are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_mb << 20)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("file_name"), format_of(name).alias("format"), "length", "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, each one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then rows of tables with cells joined by bars."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")

    def words(e) -> str:
        return "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in e.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    out = [t for p in body.findall(f"{_W}p") if (t := words(p)).strip()]
    for row in body.iterfind(f"{_W}tbl/{_W}tr"):
        cells = [t for c in row.findall(f"{_W}tc") if (t := "\n".join(words(p) for p in c.findall(f"{_W}p")).strip())]
        if cells:
            out.append(" | ".join(cells))
    return "\n".join(out)


def reply_text(reply: Column | str) -> Column:
    """The text in a parsing service's reply: the first of its known places, else the reply."""
    c = F.col(reply) if isinstance(reply, str) else reply
    return F.coalesce(*(F.get_json_object(c, p) for p in ("$.content", "$.data.content", "$.markdown", "$.md_content")), c)


def command_service(command: list[str], most_mb: int = 100, timeout: float = 1800) -> Callable[[bytes, str], str]:
    """A service for :func:`parse` that runs a command on each file, given as its last argument, and reads its reply.

    What the command prints may have noise around one JSON object, {"success", "content" or "error"}, whose content is
    JSON again and holds the text as md_content, else as results. More output than ``most_mb``, more seconds than
    ``timeout``, another exit code than 0, no JSON or no success is an error (OSError or ValueError). The file lies in a
    folder of the worker's machine while the command runs there.
    """

    def service(data: bytes, name: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder, re.sub(r"[/\\]", "_", name))
            path.write_bytes(data)
            with subprocess.Popen([*command, str(path)], stdout=subprocess.PIPE, stderr=subprocess.STDOUT) as run:
                end = threading.Timer(timeout, run.kill)
                end.start()
                out = run.stdout.read((most_mb << 20) + 1)
                if len(out) > most_mb << 20:
                    run.kill()
                    end.cancel()
                    raise OSError(f"more than {most_mb} MB of output")
                code, late = run.wait(), not end.is_alive()
                end.cancel()
        if late and code:
            raise OSError(f"no reply within {timeout} seconds")
        if code:
            raise OSError(f"exit code {code}: {out[-200:].decode(errors='replace')}")
        return bridge_text(out.decode("utf-8", errors="replace"))

    return service


def bridge_text(reply: str) -> str:
    """The text in a command's output; see :func:`command_service`. ValueError if there is none."""
    outer = json.loads(reply[reply.find("{") : reply.rfind("}") + 1])
    if not outer.get("success"):
        raise ValueError(f"not parsed: {outer.get('error')}")
    inner = json.loads(outer.get("content") or "{}")
    todo = [inner]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("md_content"), str):
                return x["md_content"]
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    results = inner.get("results") if isinstance(inner, dict) else None
    return results if isinstance(results, str) else ""


def parse(found: DataFrame, service: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """Files to (path, file_name, format, text, error). Text, Markdown, tables as text and HTML are decoded, Word files
    unpacked; all else goes to ``service``, a hook from bytes and name to text, without which it is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, kind, data in zip(*(b.column(c).to_pylist() for c in ("file_name", "format", "content")), strict=True):
                try:
                    if kind in ("TXT", "MD", "CSV", "HTML"):
                        rows.append((data.decode("utf-8"), None))
                    elif kind == "DOCX" and name.lower().endswith("docx"):
                        rows.append((docx_text(data), None))
                    elif service:
                        rows.append((service(data, name), None))
                    else:
                        rows.append((None, f"no parser for {kind}"))
                except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ET.ParseError, OSError, ValueError) as e:
                    rows.append((None, f"{type(e).__name__}: {e}"))
            texts_, errors = ([r[i] for r in rows] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "file_name", "format")), pa.array(texts_, pa.string()), pa.array(errors, pa.string())], ["path", "file_name", "format", "text", "error"])

    parsed = found.select("path", "file_name", "format", "content").mapInArrow(run, "path string, file_name string, format string, text string, error string")
    cleaned = F.when(F.col("format").isin("TXT", "MD", "CSV", "DOCX"), F.col("text")).otherwise(T.clean_parsed(F.col("text")))
    return parsed.withColumn("text", cleaned)
