"""Column functions on fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import kinds, names, tables, text, thai, tokens
from foliant.operators import chunking


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


OPTIMIZED = [
    ("a    b\t\tc\n```\nx    =  1\n```\n", "a b c\n```\nx    =  1\n```\n"), ("Header\nHeader\nbody\nbody", "Header\nbody\n"), ("a\n\n\n\n\n\nb", "a\n\nb\n"), ("ok​﻿ay", "okay\n"),
    ("<style>p{}</style><script>x</script>Text { font: bold }Keep", "Text Keep\n"), ("intro\n```\na   b\n", "intro\n```\na   b\n"), ("| 0 | 0 |\n| 0 | 0 |\n", "| 0 | 0 |\n| 0 | 0 |\n"),
    ("", ""), ("x\r\ny\rz", "x\ny\nz\n"), ("A\n \nA\n\t\nA\nB", "A\n\nB\n"), ("~~~\na\na\n~~~\nb\nb", "~~~\na\na\n~~~\nb\n"), ("1. a\n   - b   c", "1. a\n   - b c\n"),
    ("| a | 61\n| a | 61", "| a | 61\n| a | 61\n"),
]


@pytest.mark.parametrize("given_text,wanted", OPTIMIZED)
def test_optimized(spark, given_text, wanted):
    assert one(spark, text.optimized, given_text) == wanted


@pytest.mark.parametrize("kept", ['{"a": 1, "b": 2}', "`{x}`", "{1, 2, 3}", "{name}", "{หมายเหตุ: สำคัญ}"])
def test_braces_stay(spark, kept):
    assert one(spark, text.optimized, kept) == kept + "\n"


@pytest.mark.parametrize("css", ["p { color: red; margin: 0 }", ".card{border:1px}", "body {\n font: x;\n}", "Text { font: bold }"])
def test_css_goes(spark, css):
    assert "{" not in one(spark, text.optimized, css)


def brute_blocks(t):
    """Blocks by a walk over lines."""
    import re

    out, kind, held, fence = [], None, [], None
    for line in t.split("\n"):
        mark = line.lstrip().startswith(("```", "~~~"))
        if fence is not None:
            fence.append(line)
            if mark:
                out.append(("code", "\n".join(fence)))
                fence = None
            continue
        if mark:
            if held:
                out.append((kind, "\n".join(held)))
            held, kind, fence = [], None, [line]
            continue
        own = "table" if re.match(r"\s*\|.*\|\s*\Z", line) else "prose"
        if own != kind and held:
            out.append((kind, "\n".join(held)))
            held = []
        kind = own
        held.append(line)
    if fence is not None:
        out.append(("code", "\n".join(fence)))
    if held:
        out.append((kind, "\n".join(held)))
    return out


def test_blocks_of_many(spark):
    import random

    rng = random.Random(4)
    pieces = ["```", "~~~ x", "| a | b |", "prose", "", "  ", "  ```py", "|x", "| y |"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.blocks(F.col("t")).alias("b")).collect()
    for r in rows:
        assert [tuple(b) for b in r.b] == brute_blocks(texts[r.i]), texts[r.i]


def test_review(spark):
    raw = "ok\nbad 58\n| a | b |61\nlost0"
    row = spark.createDataFrame([(raw,)], "t string").select(text.review_lines(F.col("t")).alias("lines"), text.without_review(F.col("t")).alias("clean"))
    got = row.select("lines", "clean", text.with_flags(F.col("clean"), F.col("lines")).alias("flagged")).first()
    assert [tuple(x) for x in got.lines] == [(1, 58, "bad"), (2, 61, "| a | b |"), (3, 0, "lost")]
    assert got.flagged == "ok\nbad ⚠58%\n| a | b ⚠61% |\nlost ⚠"
    assert spark.createDataFrame([("x  ", 58.5)], "t string, c double").select(text.with_review(F.col("t"), F.col("c")).alias("y")).first().y == "x58"


def test_code(spark):
    assert one(spark, lambda c: text.fenced(c, F.lit("py")), "a ```` b\n\n") == "`````py\na ```` b\n`````"
    assert one(spark, text.passed_through, "x") == "x\n" and one(spark, text.passed_through, "x\n") == "x\n"
    assert one(spark, lambda c: text.clamped_lines(c, 3), "abcdef\r\nxy") == "abc\nxy"


GRIDS = [
    ([["a|b", "c"], ["d", "e"]], "| a\\|b | c |\n| --- | --- |\n| d | e |"), ([["head", "x"], ["line one\nline two", "y"]], "| head | x |\n| --- | --- |\n| line one<br>line two | y |"),
    ([["a\\", "a\\|b"]], "| a\\\\ | a\\\\\\|b |\n| --- | --- |"), ([["x"], ["a", "b", "c"], ["d", "e"]], "| x |  |  |\n| --- | --- | --- |\n| a | b | c |\n| d | e |  |"), ([["", ""], [None, None]], ""), ([], ""), ([["a\x00b\x07c"]], "| abc |\n| --- |"),
]


@pytest.mark.parametrize("grid,wanted", GRIDS)
def test_tables(spark, grid, wanted):
    assert one(spark, tables.rendered, grid, "array<array<string>>") == wanted


def test_table_headers(spark):
    grid = [["", "b"], ["1", "2"]]
    assert one(spark, lambda c: tables.rendered(c, name_empty=True), grid, "array<array<string>>").startswith("| col1 | b |")
    assert one(spark, lambda c: tables.rendered(c, header=False), grid, "array<array<string>>").startswith("| col1 | col2 |\n| --- | --- |\n|  | b |")
    assert ":--- | ---: " in one(spark, lambda c: tables.rendered(c, alignments=["left", "right"]), grid, "array<array<string>>")
    assert one(spark, lambda c: tables.shown(c, "boolean"), True, "boolean") == "true"
    got = one(spark, tables.split_titles, [["Report", None, None], [None, None, None], ["a", "b", "c"], ["1", "2", "3"]], "array<array<string>>")
    assert got.titles == ["Report"] and got.rows == [["a", "b", "c"], ["1", "2", "3"]]
    assert one(spark, tables.without_blank_columns, [["a", None, " "], ["b"]], "array<array<string>>") == [["a"], ["b"]]


@pytest.mark.parametrize("value,width", [("กิ", 1), ("日本", 4), ("abc", 3), ("", 0)])
def test_display_width(spark, value, width):
    assert one(spark, tables.display_width, value) == width


@pytest.mark.parametrize("value,low,high", [("The quick brown fox jumps over the lazy dog. " * 20, 3.0, 5.5), ("สวัสดีครับ " * 20, 0.8, 1.5)])
def test_token_estimate(spark, value, low, high):
    n = one(spark, tokens.estimated, value)
    assert low <= len(value) / n <= high
    assert n == chunking.token_cost(value)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ0 \t\n|-#*>!~\x7fกั่é日", max_size=40))
def test_token_cost_by_character(t):
    weight = lambda c: 1069 if c in "ั่" else 877 if c == "ก" else 160 if c.isascii() and c.isalpha() else 715 if c == "0" else 644 if c in " \t" else 1604 if c == "\n" else 440 if c in "|-#*>" else 865 if c.isascii() else 1000
    assert chunking.token_cost(t) == -(-sum(map(weight, t)) // 1000)


@pytest.mark.parametrize("size,wanted", [(0, "0 B"), (512, "512 B"), (2048, "2.0 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB"), (-4, "0 B")])
def test_sizes(spark, size, wanted):
    assert one(spark, tokens.human_size, size, "long") == wanted


STEMS = [("a<b>:c", "a_b__c"), ("CON", "_CON"), ("con.txt", "_con.txt"), ("com1", "_com1"), ("x. .", "x"), (" ", "document"), ("ไทย 1", "ไทย 1"), ("y" * 200, "y" * 120), ("console", "console")]


@pytest.mark.parametrize("name,wanted", STEMS)
def test_safe_stem(spark, name, wanted):
    assert one(spark, names.safe_stem, name) == wanted


def test_unique_names(spark):
    rows = [(1, "a"), (2, "A"), (3, "a-1"), (4, "a"), (5, "b"), (6, "a-1"), (7, "a-1-1")]
    got = names.unique_names(spark.createDataFrame(rows, "n int, stem string"), "stem", "n").orderBy("n").collect()
    used, wanted = set(), []
    for _, stem in rows:  # one after another
        k, free = 0, stem
        while free.lower() in used:
            k += 1
            free = f"{stem}-{k}"
        used.add(free.lower())
        wanted.append(f"{free}.md")
    assert [r.file for r in got] == wanted


PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 8
KINDS = [
    ("doc.pdf", b"%PDF-1.7", "pdf", "application/pdf", "magic"), ("x.bin", PNG, "image", "image/png", "magic"), ("x", b"\xff\xd8\xff\xe0", "image", "image/jpeg", "magic"), ("x", b"GIF89a", "image", "image/gif", "magic"),
    ("x", b"BM12", "image", "image/bmp", "magic"), ("x", b"II*\0", "image", "image/tiff", "magic"), ("x", b"MM\0*", "image", "image/tiff", "magic"), ("x", b"RIFF0000WEBP", "image", "image/webp", "magic"),
    ("page.binx", b"<HTML><body>", "html", "text/html", "heuristic"), ("message.dat", b"From: a\nTo: b\nSubject: c\n\nhi", "eml", "message/rfc822", "heuristic"), ("data.jsonx", b'{"a": 1}', "json", "application/json", "heuristic"),
    ("data.jsonx", b'{"a": ', "unknown", "application/octet-stream", "fallback"), ("app.py", b"print(1)", "code", "text/x-code", "extension"), ("tool.run", b"#!/bin/sh\n", "code", "text/x-code", "heuristic"),
    ("blob.bin", bytes(range(256)) * 8, "unknown", "application/octet-stream", "fallback"), ("a.zip", b"PK\x03\x04zz", "unknown", "application/octet-stream", "fallback"), ("song.mp3", b"zz", "media", "audio/mpeg", "extension"),
    ("old.xls", bytes.fromhex("D0CF11E0A1B11AE1"), "xlsx", kinds.MIME["xlsx"], "magic-ole"), ("n.md", b"# x", "text", "text/plain", "extension"),
]


def test_kinds(spark):
    rows = spark.createDataFrame([(i, f"/in/{n}", bytearray(b)) for i, (n, b, *_) in enumerate(KINDS)], "i int, path string, content binary")
    for r in rows.select("i", kinds.detected(F.col("path"), F.col("content")).alias("d"), kinds.language(F.col("path")).alias("language")).collect():
        assert tuple(r.d) == KINDS[r.i][2:], KINDS[r.i]
        assert r.language == ("python" if KINDS[r.i][0] == "app.py" else "")


THAI = [("จํากัด", "จำกัด"), ("น้ํา", "น้ำ"), ("นํ้า", "น้ำ"), ("ซ้้า", "ซ้ำ"), ("กิิน", "กิน"), ("กํ", "กํ"), ("abc", "abc")]


@pytest.mark.parametrize("raw,wanted", THAI)
def test_thai(spark, raw, wanted):
    assert one(spark, thai.normalized, raw) == wanted


def test_corrupt(spark):
    hit = "กéข"
    cases = [(hit * 2, False), (hit * 3, True), (hit * 3 + "ก" * 1495, False), ("a\x01\x02\x03", True), ("Café", False), ("ก" * 50 + "ก!ข" * 6, True), ("ก!ข" * 5 + "ก" * 60, False)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", thai.is_corrupt(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: c for i, (_, c) in enumerate(cases)}
    assert one(spark, thai.is_valid_cluster, "ิ่") and not one(spark, thai.is_valid_cluster, "่้")


def test_dingbats(spark):
    cases = [("", "BCDJEE+Wingdings-Regular", "✓"), ("û", "Wingdings", "✗"), ("R", "Wingdings 2", "☑"), ("4", "ITCZapfDingbats", "✔"), ("ü", "Arial", "ü"), ("ab", "Wingdings", "ab"), ("✓", "Wingdings", "✓"), ("", "Webdings", "\U0001f6cf")]
    rows = spark.createDataFrame([(i, c, f) for i, (c, f, _) in enumerate(cases)], "i int, c string, f string").select("i", thai.dingbat(F.col("c"), F.col("f")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: s for i, (_, _, s) in enumerate(cases)}


SAMPLE = "# Title\n\nIntro text here.\n\n## One\n\n- a\n- b\n\nBody of one.\n\n## Two\n\nBody of two."


def test_chunks():
    assert chunking.chunked("", 10) == [] and chunking.chunked("  \n ", 10) == []
    with pytest.raises(ValueError):
        chunking.chunked("x", 0)
    whole = chunking.chunked(SAMPLE, 10_000, len)
    assert len(whole) == 1 and whole[0].startswith("# Title")
    assert len(chunking.chunked(SAMPLE, 40, len)) >= 2
    long = chunking.chunked(" ".join(f"Sentence number {i}." for i in range(30)), 60, len)
    assert len(long) > 1 and all(len(c) <= 80 for c in long)
    giant = chunking.chunked("word " * 200, 20, len)
    assert len(giant) > 3 and all(len(c) <= 40 for c in giant)
    assert all(c.count("```") % 2 == 0 for c in chunking.chunked("# H\n\n```py\nx = 1\ny = 2\n```\n\ntail words", 18, len))
    headed = chunking.chunked("# Head\n\n" + "Some words to fill. " * 20, 50, len)
    assert headed[0].startswith("# Head\n\nSome")
    big = "\n\n".join(f"# Part {i}\n\n" + "Just one more sentence here. " * 50 for i in range(4))
    parts = chunking.chunked(big, 300)
    assert len(parts) >= 2 and all(chunking.token_cost(c) <= 300 + 20 for c in parts)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n#`", max_size=120), st.integers(5, 40))
def test_chunks_keep_words(t, budget):
    squash = lambda s: "".join(s.split()).replace("`", "")
    assert squash("".join(chunking.chunked(t, budget, len))) == squash(t)


def test_chunk_columns(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "i int, markdown string")
    rows = chunking.with_chunks(docs, 12).orderBy("i", "chunk_no").collect()
    assert [r.chunk for r in rows] == chunking.chunked(SAMPLE, 12) and {r.i for r in rows} == {1}
    chunking.register(spark)
    docs.createOrReplaceTempView("docs_to_chunk")
    assert [r.chunk for r in spark.sql("SELECT i, c.* FROM docs_to_chunk, LATERAL chunks(markdown, 12) c WHERE i = 1 ORDER BY chunk_no").collect()] == chunking.chunked(SAMPLE, 12)
