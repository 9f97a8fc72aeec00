import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import classify, intent
from tessera.plans import samples


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(c.alias("x")).first().x


@pytest.mark.parametrize(
    "query,words",
    [
        ("查询方法不包含删除", ["删除"]), ("查询方法除了新增", ["新增"]), ("推荐书籍不要小说", ["小说"]), ("搜索结果排除广告", ["广告"]), ("查询方法不包含删除、修改", ["删除", "修改"]),
        ("推荐不包含小说和诗歌", ["小说", "诗歌"]), ("查找不含糖的饮料", ["饮料"]), ("查询方法列表", []), ("不包含删、改", []), ("不要Java和Python", ["Java", "Python"]),
        ("除了苹果、香蕉和橘子", ["苹果", "香蕉", "橘子"]), ("不要讨论和平条约", ["讨论", "平条约"]),
    ],
)
def test_exclude_keywords(spark, query, words):
    from tessera.operators.rewrite import excluded

    assert one(spark, T.exclude_keywords("q"), q=query) == words == excluded(query)


@pytest.mark.parametrize(
    "query,name",
    [("打开 章程.pdf", "章程.pdf"), ("打开章程.pdf里的配置说明", "打开章程.pdf"), ("只看 产品手册", "产品手册"), ("查看 技术文档 文档", "技术"), ("章程 里的 配置", "章程"), ("公司年假制度里的规定", "公司年假制度"), ("中国中部的天气", None)],
)
def test_file_names(spark, query, name):
    assert one(spark, T.file_name("q"), q=query) == name


@pytest.mark.parametrize(
    "query,expected",
    [
        ("如何配置API接口", "PROCEDURAL"), ("怎么配置数据库", "PROCEDURAL"), ("什么是向量召回", "DEFINITIONAL"), ("API网关的定义", "DEFINITIONAL"), ("什么是如何配置", "DEFINITIONAL"),
        ("专升本和自考的区别", "COMPARISON"), ("MySQL对比PostgreSQL", "COMPARISON"), ("专升本需要多少词汇量", "FACTUAL"), ("是否支持中文分词", "FACTUAL"), ("API配置说明", "FACTUAL"),
        ("那个东西", "AMBIGUOUS"), ("", "AMBIGUOUS"), (None, "AMBIGUOUS"), ("我和你", "COMPARISON"), ("和平", "FACTUAL"),
    ],
)
def test_intents(spark, query, expected):
    from tessera.operators.rewrite import intent_of

    assert one(spark, intent.rules("q", F.lit(2))["intent"], q=query) == expected == intent_of(query or "", 2)[0]
    if query:
        assert one(spark, intent.rules("q", F.lit(0))["intent"], q=query) in (expected, "AMBIGUOUS")


def test_intent_chain_and_replies(spark):
    sure, unsure = intent.result("FACTUAL", 0.9), intent.result("COMPARISON", 0.4)
    assert one(spark, intent.chain(unsure, sure)["intent"], q="x") == "FACTUAL"
    assert one(spark, intent.chain(unsure, intent.result("DEFINITIONAL", 0.5))["intent"], q="x") == "COMPARISON"
    rows = spark.createDataFrame(samples.REPLIES, "id long, reply string").select("id", intent.parse_reply("reply").alias("r")).collect()
    got = {r.id: (r.r.intent, r.r.confidence, [tuple(a) for a in r.r.alternatives], r.r.hints) for r in rows}
    assert got[1] == ("FACTUAL", 1.0, [("COMPARISON", 0.2), ("AMBIGUOUS", 0.5)], ["a", "b"])
    assert got[2] == ("PROCEDURAL", 0.5, [], []) and got[3] == ("AMBIGUOUS", 0.0, [], [])
    assert got[4] == ("AMBIGUOUS", 0.0, [], []) and got[5] == ("AMBIGUOUS", 0.0, [], [])


def test_categories(spark):
    rows = spark.createDataFrame(samples.TEXTS, "id long, text string").select("id", classify.category("text").alias("c"), classify.category_scores("text").alias("s"), classify.is_legal("text").alias("l")).collect()
    got = {r.id: r for r in rows}
    assert {i: got[i].c for i in (-1, -2, -3, -4, -5, -6, -7)} == {-1: "TECHNICAL", -2: "LEGAL", -3: "TABLE_HEAVY", -4: "GENERAL", -5: "GENERAL", -6: "GENERAL", -7: "GENERAL"}
    assert got[-1].s.tech == 2.0 and got[-2].s.legal > 6 and got[-8].s.legal == 3.0
    assert got[-10].l and not got[-8].l


@pytest.mark.parametrize(
    "c,value,expected",
    [
        (lambda: T.latin_tokens("q"), "a, B--c  d!", ["a", "b", "c", "d"]), (lambda: T.latin_tokens("q"), "", []), (lambda: T.file_extension("q"), "a.TXT", "txt"), (lambda: T.file_extension("q"), ".bashrc", ""), (lambda: T.file_extension("q"), "x.", ""),
        (lambda: T.remove_extension("q"), "a.b.c", "a.b"), (lambda: T.remove_extension("q"), ".x", ".x"), (lambda: T.remove_extension("q"), "README", "README"), (lambda: T.sanitize_filename("q"), "../a\\b/c", "__a_b_c"), (lambda: T.sanitize_filename("q"), None, "unknown.txt"),
        (lambda: T.source_of_chunk("q"), "doc_1_2", "doc_1"), (lambda: T.source_of_chunk("q"), "_2", "_2"), (lambda: T.utf16_length("q"), "😀a", 3), (lambda: T.preview("q"), "x" * 21, "x" * 20 + "..."), (lambda: T.preview("q"), None, "空会话"),
        (lambda: T.clean_parsed("q"), " <b>x</b>【注】\t y\n\n\n\nz ", "x y\n\nz"), (lambda: T.clean_markdown("q"), samples.MARKDOWN[5][1], "# T\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n end"), (lambda: T.content_type("q"), "A.PDF", "application/pdf"),
        (lambda: T.disposition("q"), "a.docx", "attachment"), (lambda: T.json_sources("q"), "[1", []), (lambda: T.json_sources("q"), '["a"]', ["a"]), (lambda: T.with_context("q", F.lit("")), "t", "t"), (lambda: T.with_context("q", F.lit("A")), "t", "**上下文**: A\n\nt"),
        (lambda: T.likely_markdown("q"), "# heading\nx", True), (lambda: T.likely_markdown("q"), "plain text only", False), (lambda: T.cjk_tokens("q"), "如何配置API", ["API", "如何", "何配", "配置"]), (lambda: T.analyze("q"), "The Cat", ["the", "cat"]), (lambda: T.analyze("q"), "API网关", ["api", "网关"]),
        (lambda: T.content_query("q", F.lit("章程.pdf")), "打开 章程.pdf 里的 配置说明", "配置说明"), (lambda: T.simple_keywords("q"), "a，配置；the 数据库!", ["配置", "数据库"]), (lambda: T.fusion_key("q", F.lit(None)), "t", "t|unknown"),
    ],
)
def test_functions(spark, c, value, expected):
    assert one(spark, c(), q=value) == expected
