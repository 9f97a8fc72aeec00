from tessera.operators import chunk as C
from tessera.plans import samples

TEXT = dict(samples.MARKDOWN)


def chunks(text, preset=C.PRESETS["GENERAL"], **options):
    return C.Chunker(preset, **options).chunks(text)


def test_small_documents():
    assert chunks("") == chunks("  \n") == chunks(None) == []
    assert [(c.text, c.prefix) for c in chunks("short prose")] == [("short prose", "")]
    (c,) = chunks(TEXT[-102])
    assert c.prefix == "" and c.text.startswith("preamble\n# One")


def test_siblings_over_the_bound_keep_their_paths():
    found = chunks(TEXT[-103])
    assert [c.prefix for c in found] == [f"Guide > Part {i}" for i in range(3)]
    assert all(c.text.find(f"**上下文**: {c.prefix}\n\n") >= 0 for c in found)
    small = chunks("# H1\n\n## a\n" + "x " * 60 + "\n\n## b\n" + "y " * 60, C.Preset(100, 80, 0))
    assert [c.prefix for c in small] == ["H1 > a", "H1 > b"]


def test_fences_and_tables_stay_whole():
    found = chunks(TEXT[-104])
    block = next(c for c in found if "value_399" in c.text)
    assert "value_0 = 0" in block.text and block.tokens > 512 and "# Code" in block.text
    parts = list(C.blocks("a\n\n| a | b |\n|---|---|\n| 1 | 2 |\nb\n\n\nc\n```x\n\ny\n```"))
    assert [d for _, d in parts] == [True, False, True, True, False] and parts[1][0].startswith("| a | b |")


def test_sentences_are_cut_at_the_bound():
    found = chunks(TEXT[-105], C.Preset(10, 120, 0), joiner=" ")
    assert len(found) > 5 and all(c.tokens <= 120 for c in found)
    said = " ".join(c.text.split("# Long\n", 1)[1] for c in found)
    assert all(f"Sentence number {i} is here." in said for i in range(300))


def test_a_shift_of_meaning_cuts():
    text = "# T\n\n" + "cats purr softly. " * 30 + "stocks fell sharply. " * 30
    found = chunks(text, C.Preset(10, 150, 0, 0.75), embed=C.hashed_embedder, joiner=" ")
    assert all(("cats" in c.text) != ("stocks" in c.text) for c in found)


def test_overlap_repeats_the_last_paragraph():
    text = "\n\n".join(f"p{i} " + "w " * 40 for i in range(6))
    found = chunks(text, C.Preset(10, 90, 0.1))
    assert len(found) > 2
    for before, c in zip(found, found[1:], strict=False):
        last = before.text.rstrip().split("\n\n")[-1].split()[0]
        assert c.text.startswith(last) or c.tokens >= 90


def test_headings_in_fences():
    text = "# A\n\n```\n# not\n```\n"
    assert [s.title for s in C.sections(text)] == ["# A"]
    assert [s.children[0].title for s in C.sections("# A\n```\n## in\n```", literal=True)] == ["## in"]


def test_tables_by_rows(spark):
    docs = spark.createDataFrame([(1, "CSV", "h1,h2\na,b\n\n c,d "), (2, "CSV", "only"), (3, "TXT", "plain"), (4, "EXCEL", None), (5, None, "x")], "doc_id long, format string, text string")
    got = {(r.doc_id, r.chunk_index): (r.text, r.prefix) for r in C.routed_chunks(docs).collect()}
    assert got == {(1, 0): ("h1,h2\na,b", "ExcelRow"), (1, 2): ("h1,h2\nc,d", "ExcelRow"), (2, 0): ("only", ""), (3, 0): ("plain", ""), (5, 0): ("x", "")}
