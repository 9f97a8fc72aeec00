"""Content category and legal flag of documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import col, contains_cjk

# Fixed patterns and weights of the category scores.
FENCE = r"```[a-zA-Z]*\s*[\s\S]*?```"
INLINE = r"`[^`]+`"
STATUTE = r"(?:第[零一二三四五六七八九十百千0-9]+条|依据《|本法|本条例|司法解释)"
CONTRACT = r"(?:甲方|乙方|签订|违约|赔偿|保密|知识产权|合同.*条款|受.*约束)"
TABLE_LINE = r"^\s*\|.*\|\s*$"
SAMPLE = 3000
# Fixed patterns of the legal flag.
LEGAL_STRONG = r"第[零一二三四五六七八九十百千]+条|第[0-9]+条|依据《[^》]+》|本法|本条例|本规定|司法解释|最高人民法院|人民检察院|律师|诉讼|仲裁|判决"
LEGAL_MEDIUM = r"甲方|乙方|签订|履行|违约|赔偿|生效日期|保密义务|知识产权归属"
LEGAL_WEAK = r"合同.*条款|受.*约束|免责声明|法律允许.*范围|依据.*法律"
TECHNICAL_WORDS = r"API|SDK|调用|接口|参数|返回值|方法|类|配置|部署|实例|Bucket|Object|Region|Zone"
LEGAL_SAMPLE = 2000


def ascii_words(latin: list[str], chinese: list[str] = ()) -> str:
    """A pattern for whole words where only ASCII letters, digits and _ count as parts of words: Latin words stand
    between others, Chinese ones between such characters."""
    out = rf"(?<![A-Za-z0-9_])(?:{'|'.join(latin)})(?![A-Za-z0-9_])"
    return out + (rf"|(?<=[A-Za-z0-9_])(?:{'|'.join(chinese)})(?=[A-Za-z0-9_])" if chinese else "")


CATEGORY_TECH_WORDS = ascii_words(["API", "SDK", "HTTP", "JSON", "XML", "Bucket", "Region"], ["部署", "实例"])
LEGAL_TECH_WORDS = ascii_words(["API", "SDK", "HTTP", "TCP", "JSON", "XML", "Cloud", "Instance"])


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def category_scores(text: Column | str) -> Column:
    """struct(tech, legal, tables) of the start of a text."""
    sample = F.substring(col(text), 1, SAMPLE)
    lines = F.split(F.regexp_replace(sample, r"\n+$", ""), "\n")
    # most texts have no mark of a kind at all, which a plain search tells sooner than a pattern
    where = lambda mark, pattern: F.when(mark, _count(sample, pattern)).otherwise(0.0)
    ticks, chinese, bars = F.contains(sample, F.lit("`")), contains_cjk(sample), F.contains(sample, F.lit("|"))
    fences, inline = where(ticks, FENCE), where(ticks, INLINE)
    tech = F.least(F.lit(10.0), fences * 3 + inline * 0.5)
    tech = F.when((fences == 1) & (inline < 2), F.least(F.lit(2.0), tech)).otherwise(tech)
    legal = where(chinese, STATUTE) * 3 + where(chinese, CONTRACT)
    legal = F.when(chinese & (_count(sample, CATEGORY_TECH_WORDS) > 5), legal * 0.5).otherwise(legal)
    rows = F.when(bars, F.size(F.filter(lines, lambda x: x.rlike(TABLE_LINE)))).otherwise(0).cast("double")
    share = F.try_divide(rows, F.size(lines).cast("double"))
    tables = F.when(share > 0.2, F.least(F.lit(10.0), share * 15)).otherwise(0.0) + F.when(rows > 10, 2.0).otherwise(0.0)
    return F.struct(tech.alias("tech"), legal.alias("legal"), tables.alias("tables"))


def categorised(docs: DataFrame, text: str = "text", scores: str | None = None) -> DataFrame:
    """``docs`` with ``category``, and the scores if they get a name. The scores are one column, so each pattern runs
    once a text."""
    rows = docs.withColumn(scores or "_scores", category_scores(text))
    rows = rows.withColumn("category", category(text, F.col(scores or "_scores")))
    return rows if scores else rows.drop("_scores")


def category(text: Column | str, s: Column | None = None) -> Column:
    """TECHNICAL, LEGAL, TABLE_HEAVY or GENERAL; GENERAL for null and blank texts, low scores and mixed ones."""
    s = category_scores(text) if s is None else s
    tech, legal, tables = s["tech"], s["legal"], s["tables"]
    top = F.greatest(tech, legal, tables)
    second = tech + legal + tables - top - F.least(tech, legal, tables)
    unclear = col(text).isNull() | (F.trim(col(text), F.lit(" \t\r\n")) == "") | (top < 2) | ((top - second < 1.5) & (top < 6))
    return F.when(unclear, "GENERAL").when(tech == top, "TECHNICAL").when(legal == top, "LEGAL").otherwise("TABLE_HEAVY")


def legal_score(text: Column | str) -> Column:
    sample = F.substring(col(text), 1, LEGAL_SAMPLE)
    has = lambda pattern, points: F.when(sample.rlike(pattern), points).otherwise(0)
    many = F.when(_count(sample, LEGAL_TECH_WORDS) >= 3, -3).otherwise(0)
    return has(LEGAL_STRONG, 3) + has(LEGAL_MEDIUM, 2) + has(LEGAL_WEAK, 1) + has(TECHNICAL_WORDS, -5) + many


def is_legal(text: Column | str) -> Column:
    return legal_score(text) >= 3
