"""Mark repair and OCR readings on small cases."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import readings, repair

CLEAN = "ที่นี่มีน้ำใสไหลเย็นเห็นตัวปลา แม่น้ำกว้างใหญ่ ปู่ย่าอยู่ที่นี่ น้องเดินเล่นที่บ้าน"


def test_learning(spark):
    swapped = CLEAN.replace("่", "é").replace("้", "ß")
    pages = spark.createDataFrame([("a", 0, swapped, CLEAN), ("b", 0, "Café in Škoda", "Café in Škoda"), ("c", 0, None, None)], "doc string, page int, layer string, other string")
    maps = {r.doc: r.mapping for r in repair.learned(pages).collect()}
    assert maps == {"a": {"é": "่", "ß": "้"}, "b": {}, "c": {}}
    rows = pages.join(repair.learned(pages), "doc")
    got = {r.doc: (r.repaired, r.unmapped) for r in repair.repaired(rows, "layer", "mapping").collect()}
    assert got["a"] == (CLEAN, 0) and got["b"] == ("Café in Škoda", 0) and got["c"] == ("", 0)


def test_repair_beside_thai_only():
    assert repair.repaired_text("กéข Café ē", {"é": "่"}) == ("ก่ข Café ē", 0)
    assert repair.repaired_text("กēข", {}) == ("กēข", 1) and repair.repaired_text("กēข", {}, drop=True) == ("กข", 1)
    assert repair.valid("ิ่") and not repair.valid("่้")


def test_sara(spark):
    word = lambda p, *cs: [("d", 0, p, i, t, float(i), float(i) + w, f) for i, (t, w, f) in enumerate(cs)]
    rows = word(0, ("จ", 1.0, "X,Bold"), (" ", 0.0, "X"), ("ำ", 1.0, "ABC+X")) + word(1, ("ข", 1.0, "X"), ("ำ", 1.0, "X")) + word(2, ("ท", 1.0, "Y"), ("ำ", 1.0, "Y")) + word(3, ("น", 1.0, "X"), (" ", 0.0, "X"), ("้", 0.0, "X"), ("ำ", 1.0, "X"), (" ", 1.0, "X"))
    chars = spark.createDataFrame(rows, "doc string, page int, line int, pos int, text string, x0 double, x1 double, font string")
    fonts = repair.sara_fonts(chars)
    assert [tuple(r) for r in fonts.collect()] == [("d", "x")]
    lines = repair.repaired_chars(chars, fonts).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("c")).collect()
    assert {r.line: "".join(c.text for c in r.c) for r in lines} == {0: "จำ", 1: "ขา", 2: "ทำ", 3: "น้ำ "}


NOISE = [("AY ¢ AY ๐ ๑", 60.0, False), ("a y an a ๑ a", 60.0, True), ("¢ ~ ๑ a", 60.0, True), ("- 2 -", 60.0, False), ("ก. a", 60.0, False), ("real words here", 60.0, False), ("¢ ~ ๑ a", 80.0, False), ("¢", 60.0, False), ("ที่ นี้ ดี", 60.0, False), ("of to ~", 60.0, False)]


@pytest.mark.parametrize("line,confidence,noise", NOISE[1:])
def test_noise(spark, line, confidence, noise):
    assert spark.createDataFrame([(line, confidence)], "l string, c double").select(readings.is_logo_noise(F.col("l"), F.col("c")).alias("n")).first().n == noise


def test_lines(spark):
    rows = spark.createDataFrame([(1, "a fine line of text", 90.0), (2, "an unsure line of text", 60.0), (3, "dropped for sure yes", 20.0), (4, "abc", 50.0), (5, "¢ ~ ๑ a |||||", 60.0)], "n int, line string, mean_conf double")
    assert {r.n: r.outcome for r in readings.judged_lines(rows).collect()} == {1: "kept", 2: "review", 3: "dropped", 4: "dropped", 5: "noise"}
    assert [r.line for r in readings.marked(rows).orderBy("n").collect()] == ["a fine line of text", "an unsure line of text\ue00060\ue001"]
    assert readings.pooled(rows, rows).groupBy("reading").count().count() == 2


def test_positions(spark):
    rows = spark.createDataFrame([(1, 0, "่", 10.0, 10, 8, 20, 12), (1, 1, "base", 90.0, 0, 12, 40, 30), (1, 2, "far", 90.0, 0, 80, 40, 99), (1, 3, "unsure", 20.0, 0, 9, 40, 20)], "page int, row_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in readings.marks_to_rows(rows, ["page"]).collect()] == [(1, 0, 1)]
    ink = spark.createDataFrame([(1, x, y) for x in range(4) for y in range(2)], "page int, gx long, gy long")
    words = spark.createDataFrame([(1, 0, 0, 33, 10, 90.0), (1, 48, 16, 8, 8, 10.0)], "page int, left int, top int, width int, height int, conf double")
    assert sorted((r.gx, r.gy) for r in readings.uncovered(ink, words, ["page"]).collect()) == [(0, 1), (1, 1), (2, 1), (3, 0), (3, 1)]
    boxes = spark.createDataFrame([(1, 1.6, -3.0, 20.0, 9.9), (2, 50.0, 0.0, 60.0, 5.0)], "n int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in readings.scaled_boxes(boxes, F.lit(2.0), F.lit(30), F.lit(15)).collect()] == [(1, 3, 0, 30, 15)]


def test_pages(spark):
    pages = spark.createDataFrame([("d", i, "" if i % 2 else "a page with enough text on it", 0.9, i == 4) for i in range(8)], "doc string, page int, text string, image_share double, corrupt boolean")
    got = {r.page: r.route for r in readings.pages_to_read(pages, most=3).collect()}
    assert got == {0: "text", 1: "read", 2: "text", 3: "read", 4: "read", 5: "read", 6: "text", 7: "skipped"}
    shown = readings.rendered_pages(pages.filter("page < 2").withColumn("ocr", F.col("page") == 1)).first().markdown
    assert shown == "## Page 1\n\na page with enough text on it\n\n## Page 2 (OCR)\n\n"


def test_merges(spark):
    cells = spark.createDataFrame([(1, r, c, f"{r}{c}" if (r, c) in ((1, 1), (1, 2), (3, 1)) else None) for r in (1, 2, 3) for c in (1, 2)], "sheet int, r int, c int, value string")
    merges = spark.createDataFrame([(1, 0, 1, 1, 2, 1), (1, 1, 1, 2, 3, 2)], "sheet int, n int, r1 int, c1 int, r2 int, c2 int")
    got = {(r.r, r.c): r.value for r in readings.filled_merges(cells, merges, ["sheet"]).collect()}
    assert got == {(1, 1): "11", (2, 1): "11", (3, 1): "31", (1, 2): "12", (2, 2): "12", (3, 2): "12"}
