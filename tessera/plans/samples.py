"""Small inputs that the standard tables don't hold: Chinese queries, Markdown, statutes, replies of models."""

from __future__ import annotations

_FENCE = "```"
TEXTS = [
    (-1, f"intro\n{_FENCE}python\nprint(1)\n{_FENCE}\nend"),
    (-2, "第一条 本法适用于合同。\n第二条 甲方与乙方签订合同。"),
    (-3, "\n".join(["head"] + [f"| a{i} | b{i} |" for i in range(12)])),
    (-4, f"第一条 总则\n{_FENCE}\nx\n{_FENCE}"),
    (-5, "plain prose, nothing else"),
    (-6, "   \n "),
    (-7, None),
    (-8, "第一条 API API SDK HTTP JSON XML API 部署 请API网关 依据《劳动法》"),
    (-9, "use `a` and `b` and `c` and `d` and `e`"),
    (-10, "甲方 乙方 签订 违约 赔偿 保密 律师 诉讼"),
]
MARKDOWN = [
    (-101, "short prose without headings"),
    (-102, "preamble\n\n# One\ntext one\n\n## Two\ntext two"),
    (-103, "# Guide\n\n" + "\n\n".join(f"## Part {i}\n\n" + " ".join(f"word{i}_{j}" for j in range(300)) for i in range(3))),
    (-104, f"# Code\n\nbefore\n\n{_FENCE}python\n" + "\n".join(f"value_{i} = {i}" for i in range(400)) + f"\n{_FENCE}\n\nafter"),
    (-105, "# Long\n\n" + " ".join(f"Sentence number {i} is here." for i in range(300))),
    (-106, "# T\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![](images/x.png)\n第 3 页\n\n\n\nPage 4\n版权所有 某某 保留一切权利。 end"),
    (-107, "  \n "),
]
QUERIES = [
    (1, "如何配置API接口"), (2, "怎么配置数据库"), (3, "什么是向量召回"), (4, "API网关的定义"), (5, "什么是如何配置"), (6, "专升本和自考的区别"), (7, "MySQL对比PostgreSQL"),
    (8, "专升本需要多少词汇量"), (9, "是否支持中文分词"), (10, "API配置说明"), (11, "那个东西"), (12, ""), (13, None), (14, "我和你"), (15, "请帮我找讲稿"), (16, "API网关和API"),
    (17, "查询方法不包含删除"), (18, "查询方法除了新增"), (19, "推荐书籍不要小说"), (20, "搜索结果排除广告"), (21, "查询方法不包含删除、修改"), (22, "推荐不包含小说和诗歌"), (23, "查找不含糖的饮料"),
    (24, "不包含删、改"), (25, "不要Java和Python"), (26, "除了苹果、香蕉和橘子"), (27, "不要讨论和平条约"), (28, "打开 章程.pdf"), (29, "打开章程.pdf里的配置说明"), (30, "只看 产品手册"),
    (31, "查看 技术文档 文档"), (32, "章程 里的 配置"), (33, "公司年假制度里的规定"), (34, "中国中部的天气"), (35, "配质API"), (36, "参考薪资"), (37, "the setting of an API, please"),
]
EXTENSIONS = [".pdf", ".PNG", ".jpg", ".jpeg", ".gif", ".bmp", ".txt", ".md", ".docx", ""]
CONFIDENCES = [(1, 3, "FACTUAL", 1, 2, 2), (2, 2, "PROCEDURAL", 0, 1, 4), (3, 1, "AMBIGUOUS", 1, 0, 0), (4, 0, "FACTUAL", 0, 0, 0), (5, 5, "COMPARISON", 4, 7, 8), (6, 1, "FACTUAL", 0, 17, 40)]
REPLIES = [
    (1, '{"primaryIntent":"factual","confidence":1.7,"alternatives":[{"intent":"Comparison","probability":0.2},{"intent":"odd"}],"rewriteHints":["a","b"]}'),
    (2, f'{_FENCE}json\n{{"primaryIntent":"PROCEDURAL"}}\n{_FENCE}'),
    (3, "no json at all"), (4, '{"primaryIntent":"nonsense","confidence":-3}'), (5, None),
]
#: What rewriting makes of QUERIES with the shipped dictionaries: query, expansion, exclusion, confidence, level.
REWRITTEN = [
    (1, '如何配置 设置API 接口接口', '如何配置|设置API|接口接口|设置|参数|config|setting', '', 0.9, 'L1_RULE'),
    (2, '怎么配置 设置数据库 参数 config setting 步骤 方法 教程 流程', '怎么|配置|设置|数据|据库|参数|config|setting|步骤|方法|教程', '', 0.9, 'L2_NLP'),
    (3, '什么是向量召回 检索 搜索 recall retrieve 定义 概念 含义', '什么|么是|是向|向量|召回|检索|搜索|recall|retrieve|定义|概念', '', 0.9, 'L2_NLP'),
    (4, 'API 接口网关的定义', 'API|接口网关的定义', '', 0.9, 'L1_RULE'),
    (5, '什么是如何配置 设置 参数 config setting 定义 概念 含义', '什么|么是|是如|如何|配置|设置|参数|config|setting|定义|概念', '', 0.9, 'L2_NLP'),
    (6, '专升本 3500词和自考的区别', '专升本|3500词和自考的区别', '', 0.95, 'L1_RULE'),
    (7, 'MySQL对比PostgreSQL 区别 差异', 'PostgreSQL|MySQL|对比|区别', '', 0.8, 'L2_NLP'),
    (8, '专升本 3500词需要多少词汇 单词量', '专升本|3500词需要多少词汇|单词量|单词|词|vocabulary|word', '', 0.95, 'L1_RULE'),
    (9, '是否支持短文单词', '是否|否支|支持|短文|单词', '', 0.87, 'L2_NLP'),
    (10, 'API 接口配置 设置说明', 'API|接口配置|设置说明|设置|参数|config|setting', '', 0.9, 'L1_RULE'),
    (11, '那个东西', '那个|个东|东西', '', 0.5, 'L2_NLP'),
    (12, '', '', '', 0.0, 'NONE'),
    (13, '', '', '', 0.0, 'NONE'),
    (14, '我和你 区别 对比 差异', '我和|和你|区别|对比', '', 0.8, 'L2_NLP'),
    (15, '请帮我找讲义', '请帮我找讲义', '', 0.95, 'L1_RULE'),
    (16, 'API 接口网关和API', 'API|接口网关和API', '', 0.9, 'L1_RULE'),
    (17, '查询方法不包含删除 步骤 教程 流程', '查询|询方|方法|法不|不包|步骤|教程', '删除', 0.8, 'L2_NLP'),
    (18, '查询方法除了新增 步骤 教程 流程', '查询|询方|方法|法除|除了|步骤|教程', '新增', 0.8, 'L2_NLP'),
    (19, '推荐书籍不要小说', '推荐|荐书|书籍|籍不|不要', '小说', 0.8, 'L2_NLP'),
    (20, '搜索结果排除广告', '搜索|结果|果排|排除|除广', '广告', 0.83, 'L2_NLP'),
    (21, '查询方法不包含删除、修改 步骤 教程 流程', '查询|询方|方法|法不|不包|步骤|教程', '删除|修改', 0.8, 'L2_NLP'),
    (22, '推荐不包含小说和诗歌 区别 对比 差异', '推荐|荐不|不包|包含|含小|区别|对比', '小说|诗歌', 0.8, 'L2_NLP'),
    (23, '查找不含糖的饮料', '查找|找不|不含|含糖|糖的', '饮料', 0.8, 'L2_NLP'),
    (24, '不包含删、改', '不包|包含|含删', '', 0.8, 'L2_NLP'),
    (25, '不要Java和Python', 'Python|Java|不要', 'Java|Python', 0.8, 'L2_NLP'),
    (26, '除了苹果、香蕉和橘子 区别 对比 差异', '除了|了苹|苹果|香蕉|蕉和|区别|对比', '苹果|香蕉|橘子', 0.8, 'L2_NLP'),
    (27, '不要讨论和平条约 区别 对比 差异', '不要|要讨|讨论|论和|和平|区别|对比', '讨论|平条约', 0.8, 'L2_NLP'),
    (28, '打开 章程.pdf', 'pdf|打开|章程', '', 0.8, 'L2_NLP'),
    (29, '打文章程.pdf里的配置 设置说明 参数 config setting', 'pdf|文章|里的|配置|设置|参数|config|setting', '', 0.91, 'L2_NLP'),
    (30, '只看 产品手册', '只看|产品|品手|手册', '', 0.8, 'L2_NLP'),
    (31, '查看 技短文档 文章', '查看|短文|文章', '', 0.88, 'L2_NLP'),
    (32, '章程 里的 配置 设置 参数 config setting', '章程|里的|配置|设置|参数|config|setting', '', 0.94, 'L2_NLP'),
    (33, '公司年假制度里的规定', '公司|司年|年假|假制|制度', '', 0.8, 'L2_NLP'),
    (34, '中国中部的天气', '中国|国中|中部|部的|的天', '', 0.8, 'L2_NLP'),
    (35, '配质API 接口', '配质API|接口', '', 0.9, 'L1_RULE'),
    (36, '参数薪资 工资 薪酬 收入 salary', '参数|薪资|工资|薪酬|收入|salary', '', 0.97, 'L2_NLP'),
    (37, 'the setting of an API 接口, please', 'setting|API|接口|please', '', 0.9, 'L1_RULE'),
]
#: What parsing makes of REPLIES: intent, confidence, number of alternatives, hints.
PARSED = [(1, "FACTUAL", 1.0, 2, "a|b"), (2, "PROCEDURAL", 0.5, 0, ""), (3, "AMBIGUOUS", 0.0, 0, ""), (4, "AMBIGUOUS", 0.0, 0, ""), (5, "AMBIGUOUS", 0.0, 0, "")]
#: Documents for presets so small (4 to 10 tokens, a fifth of overlap; SHIFT: 1 to 9, none) that each rule of chunking can
#: be worked out by hand, and the chunks that follow: index, number, text, tokens, prefix.
TINY = [
    (1, "SMALL", "one two three"), (2, "SMALL", "# A\none two"), (3, "SMALL", "a b c d e f\n\ng h i j k l"), (4, "SMALL", "# T\n## a\nx y\n## b\nz w"),
    (5, "SMALL", f"{_FENCE}\na b c d e f g h i j k l\n{_FENCE}"), (6, "SMALL", "A b c. D e f. G h i. J k l."), (7, "SMALL", "# T\nintro words here now ok\n## a\n## a\ny"),
    (8, "SMALL", f"pre\n\n# A\n{_FENCE}\n# not\n{_FENCE}"), (9, "SMALL", "| a | b |\n|---|---|\n| 1 | 2 |"), (10, "SMALL", " \n"), (11, "SMALL", None),
    (12, "SMALL", "x y\n\na b c d e f g h\n\nk l m"), (13, "SHIFT", "Cats purr. Cats purr. Stocks fell. Stocks fell."), (14, "SMALL", "école où ça"),
]
TINY_CHUNKS = [
    (1, 0, 1, "one two three", 3, ""),
    (2, 0, 1, "**上下文**: A\n\n# A\none two", 4, "A"),
    (3, 0, 2, "a b c d e f", 6, ""), (3, 1, 2, "a b c d e f\ng h i j k l", 12, ""),
    (4, 0, 2, "**上下文**: T > a\n\n## a\nx y", 5, "T > a"), (4, 1, 2, "## a\nx y\n**上下文**: T > b\n\n## b\nz w", 19, "T > b"),
    (5, 0, 1, f"{_FENCE}\na b c d e f g h i j k l\n{_FENCE}\n", 18, ""),
    (6, 0, 2, "A b c.D e f.", 8, ""), (6, 1, 2, "A b c.D e f.\nG h i.J k l.", 16, ""),
    (7, 0, 2, "**上下文**: T\n\n# T\nintro words here now ok", 7, "T"), (7, 1, 2, "**上下文**: T > a\n\n## a\n\n**上下文**: T > a\n\n## a\ny", 25, "T > a"),
    (8, 0, 2, "pre", 1, ""), (8, 1, 2, f"**上下文**: A\n\n# A\n{_FENCE}\n# not\n{_FENCE}", 10, "A"),
    (9, 0, 1, "| a | b |\n|---|---|\n| 1 | 2 |\n", 19, ""),
    (12, 0, 2, "x y\n\na b c d e f g h", 10, ""), (12, 1, 2, "a b c d e f g h\nk l m", 11, ""),
    (13, 0, 2, "Cats purr.Cats purr.", 6, ""), (13, 1, 2, "Stocks fell.Stocks fell.", 6, ""),
    (14, 0, 1, "école où ça", 3, ""),
]
#: Replies of a parsing service and the texts in them; the vocabulary of the shipped dictionaries.
SERVICE_REPLIES = [(1, '{"content":"a"}'), (2, '{"data":{"content":"b"}}'), (3, '{"markdown":"c"}'), (4, '{"md_content":"d","x":1}'), (5, "no json"), (6, '{"markdown":"m","content":"first"}'), (7, None)]
SERVICE_TEXTS = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "no json"), (6, "first"), (7, None)]
WORDS = (
    "换工作|薪资|阅读|词汇|主旨|配置|切片|召回|职业转换|跳槽|转行|career switch|工资|薪酬|收入|salary|文章|短文|passage|reading|单词|词|vocabulary|word"
    "|大意|中心思想|main idea|gist|设置|参数|config|setting|分块|切分|chunk|split|检索|搜索|recall|retrieve|专升本|讲稿|API"
)
