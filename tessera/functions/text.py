"""Text functions as column builders. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words in the order of the configuration.
STOPWORDS_ZH = "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 它 他 她".split()
STOPWORDS_EN = "the a an is are was were be been being have has had do does did will would could should may might must for and nor but or yet so as at by in of on to with without".split()

# Fixed patterns.
SEPARATORS = r"[\s\p{Punct}]+"
LATIN_RUN = r"([a-zA-Z0-9_]+)"
CJK_RUN = r"([一-鿿]+)"
EXCLUDE = r"(?:不包含|除了|不要|排除|不含)[\s]*([一-龥a-zA-Z0-9]+(?:[、，,和&\s]+[一-龥a-zA-Z0-9]+)*)"
EXCLUDE_SEPARATORS = r"[、，,和&\s]+"
EXCLUDE_PARTICLES = r"[的了吗呢吧啊呀嘛]+"
PUNCTUATION = "[，,、。.！!？?；;：:\"“”()（）]"
FILE_WITH_EXTENSION = r"([\w\-一-龥]+\.(?:md|pdf|docx|txt|pptx|xlsx|doc|ppt|xls))"
FILE_AFTER_ACTION = r"(?:只看|打开|查看|搜索)\s*([一-龥\w\-]+?)\s*(?:里的|中的|文档|文件|$)"
FILE_BEFORE_PLACE = r"([一-龥\w\-]+?)\s*(?:里|中)\s*的"
QUERY_PHRASES = r"(?:只看|打开|查看|搜索|里的|中的|文档|文件)"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\t\n\x0B\f\r]"
HEADING_OR_TABLE = r"^(#{1,6}\s+.+|\s*\|.*\|\s*)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latin_tokens(text: Column | str) -> Column:
    """Lower-case words between whitespace and ASCII punctuation; null for null."""
    return F.array_remove(F.split(F.lower(col(text)), SEPARATORS), "")


def contains_cjk(text: Column | str) -> Column:
    return col(text).rlike(r"[\x{4e00}-\x{9fff}]")


def is_stopword(token: Column) -> Column:
    return F.lower(F.trim(token)).isin(*STOPWORDS_ZH, *STOPWORDS_EN)


def useful(tokens: Column) -> Column:
    """Tokens of at least two characters that are no stop words."""
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~is_stopword(t))


def _pairs(run: Column) -> Column:
    """Overlapping pairs of characters of a run; a run of up to three characters counts whole besides."""
    n = F.length(run)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
    return F.when(n == 3, F.concat(F.array(run), pairs)).otherwise(pairs)


def cjk_tokens(text: Column | str) -> Column:
    """Latin runs first, then Chinese runs as overlapping pairs: the segmenter used where no dictionary is given."""
    latin = F.regexp_extract_all(col(text), F.lit(LATIN_RUN))
    chinese = F.flatten(F.transform(F.regexp_extract_all(col(text), F.lit(CJK_RUN)), _pairs))
    return useful(F.concat(latin, chinese))


def analyze(text: Column | str, keep_case: bool = False) -> Column:
    """Index terms: :func:`latin_tokens` for texts without Chinese characters, else :func:`cjk_tokens`, in lower case
    unless ``keep_case``."""
    other = cjk_tokens(text)
    other = other if keep_case else F.transform(other, F.lower)
    return F.when(contains_cjk(text), other).otherwise(latin_tokens(text))


def part_of_speech(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^\d+$"), "NUM")
        .when(token.rlike(r"^[a-zA-Z0-9_]+$"), "ENG")
        .when(token.rlike("[如何怎么怎样哪什么谁几]"), "PRON")
        .when(token.rlike("[的得了着过地得]"), "AUX")
        .when(token.rlike("[不没无非]"), "NEG")
        .otherwise("NOUN")
    )


def simple_keywords(text: Column | str, most: int = 5) -> Column:
    parts = F.split(F.regexp_replace(col(text), PUNCTUATION, " "), r"\s+")
    return F.slice(useful(F.transform(parts, F.trim)), 1, most)


def exclude_keywords(query: Column | str) -> Column:
    """Words that a query asks to leave out; every piece of two characters or more."""
    groups = F.regexp_extract_all(col(query), F.lit(EXCLUDE), F.lit(1))
    pieces = F.flatten(F.transform(groups, lambda g: F.flatten(F.transform(F.split(g, EXCLUDE_SEPARATORS), lambda p: F.split(F.trim(p), EXCLUDE_PARTICLES)))))
    return F.filter(F.transform(pieces, F.trim), lambda p: F.length(p) >= 2)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def file_name(query: Column | str) -> Column:
    """A file name with extension, else what follows an action verb, else what stands before a place word."""
    q = F.trim(col(query))
    # only the first place counts, and only if it has two characters
    place = _found(q, FILE_BEFORE_PLACE)
    return F.coalesce(_found(q, FILE_WITH_EXTENSION), _found(q, FILE_AFTER_ACTION), F.when(F.length(place) >= 2, place))


def content_query(query: Column | str, name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.replace(col(query), col(name), F.lit(""))), QUERY_PHRASES, ""))


def remove_extension(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"^(.+)\.[^.]*$", "$1")


def file_extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(name), r"^.+\.([^.]+)$", 1))


def sanitize_filename(name: Column | str) -> Column:
    return F.when(col(name).isNull() | (col(name) == ""), "unknown.txt").otherwise(F.regexp_replace(F.replace(col(name), F.lit(".."), F.lit("_")), r"[/\\]", "_"))


def unique_filename(name: Column | str, identity: Column | None = None) -> Column:
    return F.concat(F.substring(F.uuid() if identity is None else identity, 1, 8), F.lit("_"), col(name))


def source_of_chunk(chunk: Column | str) -> Column:
    return F.regexp_replace(col(chunk), r"^(.+)_[^_]*$", "$1")


def fusion_key(text: Column | str, source: Column | str) -> Column:
    return F.concat_ws("|", F.substring(col(text), 1, 100), F.coalesce(col(source), F.lit("unknown")))


def clean_parsed(text: Column | str) -> Column:
    """Parser output without tags and bracketed notes, with single spaces and at most one empty line."""
    c = F.regexp_replace(col(text), "<[^>]+>", " ")
    c = F.regexp_replace(c, "【[^】]*】", " ")
    c = F.trim(F.regexp_replace(c, r"[^\S\n]+", " "), F.lit(" \n"))
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_markdown(text: Column | str) -> Column:
    """Markdown without image places, the rights notice and page numbers, and with single empty lines."""
    c = F.regexp_replace(col(text), r"!\[\]\(images/.*?\)", "")
    c = F.regexp_replace(c, r"(?s)版权所有.*?保留一切权利。", "")
    c = F.regexp_replace(F.regexp_replace(c, r"第\s*\d+\s*页", ""), r"(?i)Page\s*\d+", "")
    return F.trim(F.regexp_replace(c, r"\n\s*\n+", "\n\n"), F.lit(" \n\t\r"))


def with_context(text: Column | str, prefix: Column | str) -> Column:
    return F.when(F.coalesce(F.length(col(prefix)), F.lit(0)) > 0, F.concat(F.lit("**上下文**: "), col(prefix), F.lit("\n\n"), col(text))).otherwise(col(text))


def likely_markdown(text: Column | str) -> Column:
    lines = F.split(col(text), "\n", 50)
    return (F.length(col(text)) >= 10) & F.exists(lines, lambda x: x.rlike(HEADING_OR_TABLE))


def content_type(name: Column | str) -> Column:
    low = F.lower(col(name))
    out = F.when(low.endswith(".pdf"), "application/pdf")
    # Media types by extension.
    for ends, kind in (((".png",), "image/png"), ((".jpg", ".jpeg"), "image/jpeg"), ((".gif",), "image/gif"), ((".bmp",), "image/bmp"), ((".txt",), "text/plain; charset=UTF-8"), ((".md",), "text/markdown; charset=UTF-8")):
        for e in ends:
            out = out.when(low.endswith(e), kind)
    return out.otherwise("application/octet-stream")


def disposition(name: Column | str) -> Column:
    return F.when(F.lower(col(name)).rlike(r"\.(pdf|png|jpg|jpeg|gif|bmp)$"), "inline").otherwise("attachment")


def preview(text: Column | str, most: int = 20, empty: str = "空会话") -> Column:
    c = col(text)
    return F.when(c.isNull(), empty).when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(col(text)) + F.regexp_count(col(text), F.lit(r"[\x{10000}-\x{10FFFF}]"))


def token_count(text: Column | str) -> Column:
    """The default estimate of a text's tokens: runs of letters, digits and underscores of any script, and single marks."""
    return F.regexp_count(col(text), F.lit(TOKEN))


def sha256(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def json_sources(c: Column | str) -> Column:
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))
