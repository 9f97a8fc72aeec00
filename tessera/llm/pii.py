"""Personal data and secrets: patterns propose spans, validators confirm them, words nearby adjust their score.

All patterns are matched in time that grows with the text: an address is found from its ``@`` outwards, a dotted quad
only at the start of a run of digits, which gives the same leftmost matches as trying every character, tokens only in
long runs of their characters, and signed tokens part by part. Nothing is too long to be found. Texts are worked on in pieces of bounded size, so a worker holds little at a time.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import table

# Fixed patterns of the base kinds.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Kinds that this operator adds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")
#: Where a token may stand, and tokens of known formats in it.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}")
TOKEN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])"
)
#: A part of a signed token, and where its first one may begin.
SIGNED_PART, SIGNED = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"(?<![A-Za-z0-9])eyJ(?=[A-Za-z0-9_-])")
ASSIGNED = re.compile(r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{8,})", re.I)
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "private_key", "token", "secret")
#: Score of a confirmed span without context, and what a context word nearby adds.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.8, "ssn": 0.3, "private_key": 0.9, "token": 0.7, "secret": 0.3}
CONTEXT_ADDS = 0.3
CONTEXT_CHARS = 40
#: Added kinds are kept from this score on; spans of the base kinds always are.
LEAST = 0.5
_SECRET_WORDS = re.compile(r"passw|pwd|secret|token|credential|bearer|auth|api.?key|\bkey\b", re.I)
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel|llama", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "ssn": re.compile(r"\bssn\b|social security|tax", re.I),
    "private_key": _SECRET_WORDS,
    "token": _SECRET_WORDS,
    "secret": _SECRET_WORDS,
}
#: Bits a character that a string must hold to look random, if it is hexadecimal or else; its least length; and how
#: often letters and digits must alternate in it, which names and dates don't do.
ENTROPY_HEX, ENTROPY, HEX_CHARS, RANDOM_CHARS, TURNS = 3.0, 3.5, 32, 20, 4
#: Sorted by start, then by the place of the kind in KINDS.
ORDER = {k: i for i, k in enumerate(KINDS)}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1  # an address can't reach across an @, so nothing before it is looked at again
            at = text.find("@", at + 1)


def entropy(s: str) -> float:
    """Bits a character of a string that isn't empty, by the shares of its own characters."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def looks_random(s: str) -> bool:
    if HEX.fullmatch(s) and DIGIT.search(s) and not s.isdigit():
        return len(s) >= HEX_CHARS and entropy(s) >= ENTROPY_HEX
    kinds = [c.isdigit() for c in s if c.isalnum()]
    return len(s) >= RANDOM_CHARS and sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= TURNS and entropy(s) >= ENTROPY


def _json_head(token: str) -> bool:
    """Whether the first part of a signed token is the JSON that names its algorithm."""
    head = token.partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Blocks from BEGIN to END with a body of base64, headers aside, of 64 characters at least."""
    at = 0
    while m := KEY_BEGIN.search(text, at):
        at = m.end()
        stop = text.find("-----", at)
        if stop < 0:
            return
        end = KEY_END.match(text, stop)
        body = "".join(x for x in text[at:stop].replace("\\n", "\n").split() if ":" not in x)
        if end and len(body) >= 64 and re.fullmatch(r"[A-Za-z0-9+/=,-]+", body):
            yield m.start(), end.end()
            at = end.end()


def signed_tokens(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Three parts with dots between, of which the last may be empty and the first is the JSON that names an algorithm. Each
    part is looked at once, so the time grows with the text whatever is in it."""
    if text.find(".", start, end) < 0:
        return
    parts = [m.span() for m in SIGNED_PART.finditer(text, start, end)]
    dotted = lambda k: k + 1 < len(parts) and parts[k + 1][0] == parts[k][1] + 1 and text[parts[k][1]] == "."
    after = 0
    for k, (lo, hi) in enumerate(parts):
        if k < after or not dotted(k) or text[parts[k + 1][1] : parts[k + 1][1] + 1] != ".":
            continue
        if (head := SIGNED.search(text, lo, hi)) and _json_head(text[head.start() : hi]):
            last = dotted(k + 1)
            yield head.start(), parts[k + 2][1] if last else parts[k + 1][1] + 1
            after = k + 2 + last


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Tokens of known formats, and strings that look random or are assigned to the name of a secret."""
    taken: list[tuple[int, int]] = []
    for run in RUN.finditer(text):
        known: list[tuple[int, int]] = []
        for span in sorted([*(m.span() for m in TOKEN.finditer(text, *run.span())), *signed_tokens(text, *run.span())]):
            if not known or span[0] >= known[-1][1]:
                known.append(span)
        for span in known:
            yield "token", *span
        own = run.group().rstrip(".")
        if known:
            taken += known
        elif looks_random(own):
            taken.append((run.start(), run.start() + len(own)))
            yield "secret", *taken[-1]
    if any(x in text.lower() for x in ("passw", "pwd", "secret", "token", "api")):
        at = 0
        for m in ASSIGNED.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            value = m.group(1).rstrip(".,;)")
            a, b = m.start(1), m.start(1) + len(value)
            if len(value) >= 8 and DIGIT.search(value) and any(c.isalpha() for c in value) and entropy(value) >= 2.5 and all(b <= s or a >= e for s, e in taken[at : at + 4]):
                yield "secret", a, b


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    if "-----BEGIN " in text:
        for start, end in private_keys(text):
            yield "private_key", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]  # an int of thousands of digits would be refused
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if 15 <= len(code := m.group().replace(" ", "")) <= 34 and mod97(code):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", *m.span()
    yield from tokens(text)


def find(text: str | None) -> list[Span]:
    """All spans of a text in code points, end exclusive. None and the empty text have none."""
    out = []
    for kind, start, end in _proposed(text or ""):
        near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        score = min(1.0, SCORES[kind] + CONTEXT_ADDS * bool(CONTEXT[kind].search(near)))
        if kind in BASE or score >= LEAST:
            out.append(Span(kind, start, end, score))
    return sorted(out, key=lambda s: (s.start, ORDER[s.kind]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, spans): a row for each row, null and empty texts with no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tb.pieces(b.column("text")):
                found = [[s._asdict() for s in find(t)] for t in b.column("text").slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(found, SPANS)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then the longest."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
            at = s.end
        elif s.end > at:
            at = s.end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` redacted and, where there is one, ``n_chars`` counted anew. Null and empty
    texts stay as they are, repeated rows become equal rows, an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in tb.pieces(b.column(at)):
                part = b.slice(lo, hi - lo)
                texts = pa.array([redacted(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark, sf_dir):
    """All spans of every whole text of ``documents``, counted by base kind and in all (``n_spans``). A null text is
    empty and has none; every row, repeated ones and those without doc_id too, has a row."""
    found = detect(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.size("spans").cast("long").alias("n_spans"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def pii_base(spark, sf_dir):
    """What :func:`op7_pii` says of the base kinds, which plain patterns in SQL can say too."""
    return op7_pii(spark, sf_dir).drop("n_spans", "spans")


def _sql(place: int, kind: str, pattern: str, holds: str) -> str:
    """Matches of a pattern with their places: what parts them adds up to where each begins."""
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, pos AS start, pos + length(m) AS stop, {holds} AS holds FROM (
  SELECT doc_id, m, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(regexp_split_to_array(text, '{pattern}')[1 : len(ms)]) AS p, generate_subscripts(ms, 1) AS i
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT ELSE {_DIGITS}[i]::INT * 2 - CASE WHEN {_DIGITS}[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
PII_BASE_SQL = f"""
WITH a AS ({_sql(0, "email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true")}
UNION ALL {_sql(1, "ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0")}
UNION ALL {_sql(2, "card", "[0-9]([\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}")}
UNION ALL {_sql(3, "phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}),
g AS (SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_email, count(*) FILTER (WHERE place = 1) AS n_ip, count(*) FILTER (WHERE place = 2) AS n_card, count(*) FILTER (WHERE place = 3) AS n_phone,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS line FROM a WHERE holds GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(line, '')) AS base_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""
