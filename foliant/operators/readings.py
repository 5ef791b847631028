"""What OCR read: which lines are noise, which need a second look, and how pages are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

#: Least mean confidence of lines and of short ones, of lines not to be looked at again, of rows that are surely no logo.
LINE, SHORT_LINE, SHORT_LENGTH, REVIEW, LOGO = 40.0, 60.0, 3, 70.0, 75.0
#: List markers, plausible one-letter Thai words, two-letter Latin words.
MARKER = r"\A(?:\(?[A-Za-zก-ฮ][.)]|\([A-Za-zก-ฮ]\))\z"
THAI_WORD = r"\A(?:[ก-ฮ][ิ-ู][่-๋]?|[ก-ฮ]็|[ณๆฯ])\z"
LATIN_WORDS = "of to in is it at on or an as by be we he me my no so do if up us am go oh ok vs pm tv pc id ex ie eg re hr qa qc gm".split()


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{T.SPACE}]+", "")


def is_number(token: Column) -> Column:
    return token.rlike(r"[0-9]|[๐-๙]{2}")


def letters(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\p{L}]", "")


def is_word(token: Column) -> Column:
    """Three letters or more, all Thai or none."""
    own = letters(token)
    return (F.length(own) >= 3) & own.rlike(r"\A(?:[ก-๛]+|[^ก-๛]+)\z")


def is_stray(token: Column) -> Column:
    own = letters(token)
    pair = (F.length(own) == 2) & own.rlike(r"\A[a-zA-Z]+\z") & (token == F.lower(token)) & ~token.isin(LATIN_WORDS)
    return ~is_number(token) & F.when(F.length(own) <= 1, ~token.rlike(THAI_WORD)).otherwise(pair)


def is_logo_noise(line: Column, confidence: Column) -> Column:
    """A row of stray marks, read without much confidence: two tokens or more, no word, number or list marker, and three
    of five tokens stray."""
    tokens = F.filter(F.split(line, rf"[{T.SPACE}]+"), lambda x: x != "")
    useful = F.exists(tokens, lambda t: is_word(t) | is_number(t) | t.rlike(MARKER))
    stray = F.size(F.filter(tokens, is_stray))
    return F.coalesce((confidence < LOGO) & (F.size(tokens) >= 2) & ~useful & (stray >= 0.6 * F.size(tokens)), F.lit(False))


def is_doubtful(line: Column, confidence: Column) -> Column:
    """Below the floor for its length: such lines go."""
    return confidence < F.when(F.length(squashed(line)) <= SHORT_LENGTH, SHORT_LINE).otherwise(LINE)


def judged_lines(lines: DataFrame) -> DataFrame:
    """lines (line, mean_conf ...) with outcome: dropped, noise, review or kept."""
    outcome = F.when(is_doubtful(F.col("line"), F.col("mean_conf")), F.lit("dropped")).when(is_logo_noise(F.col("line"), F.col("mean_conf")), F.lit("noise")).when(F.col("mean_conf") < REVIEW, F.lit("review")).otherwise(F.lit("kept"))
    return lines.withColumn("outcome", outcome)


def marked(lines: DataFrame) -> DataFrame:
    """The lines that stay; those to be looked at again carry a mark."""
    stay = judged_lines(lines).filter(F.col("outcome").isin("kept", "review"))
    return stay.withColumn("line", F.when(F.col("outcome") == "review", T.with_review(F.col("line"), F.col("mean_conf"))).otherwise(F.col("line")))


def pooled(*readings: DataFrame) -> DataFrame:
    """Several readings of the same images under one another, numbered."""
    out = None
    for n, r in enumerate(readings):
        one = r.withColumn("reading", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def marks_to_rows(rows: DataFrame, keys: list[str], least_conf: float = 60.0, overlap: float = 0.3) -> DataFrame:
    """rows (keys, row_no, text, conf, x0, y0, x1, y1): each row of marks alone with the base row that it belongs to: one
    sure enough, that it overlaps sideways, with the nearest top."""
    alone = F.col("text").rlike(r"\A[ัิ-ฺ็-๎\s]+\z")
    marks = rows.filter(alone).select(*keys, F.col("row_no").alias("mark_no"), *(F.col(c).alias(f"m_{c}") for c in ("x0", "x1", "y0")))
    base = rows.filter(~alone & (F.col("conf") >= least_conf)).select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("row_no").alias("base_no"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0")))
    shared = F.least("m_x1", "b_x1") - F.greatest("m_x0", "b_x0")
    on = shared >= overlap * F.least(F.col("m_x1") - F.col("m_x0"), F.col("b_x1") - F.col("b_x0"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    near = F.min(F.struct(F.abs(F.col("m_y0") - F.col("b_y0")).alias("d"), "base_no")).alias("n")
    return marks.join(base, on).groupBy(*keys, "mark_no").agg(near).select(*keys, "mark_no", F.col("n.base_no").alias("base_no"))


def uncovered(ink: DataFrame, words: DataFrame, keys: list[str], least_conf: float = 60.0, cell: int = 16) -> DataFrame:
    """ink (keys, gx, gy): grid cells with ink that no word read surely enough covers. Word boxes become the cells that
    they touch, so the anti-join is by equal cells."""
    sure = words.filter(F.col("conf") >= least_conf)
    span = lambda a, n: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(n) - 1) / cell))
    cells = sure.select(*keys, F.explode(span("left", "width")).alias("gx"), "top", "height").select(*keys, "gx", F.explode(span("top", "height")).alias("gy")).distinct()
    return ink.join(cells, [*keys, "gx", "gy"], "left_anti")


def pages_to_read(pages: DataFrame, key: str = "doc", least_chars: int = 16, least_share: float = 0.25, most: int = 100) -> DataFrame:
    """pages (key, page, text, image_share, corrupt) with ``route``: text, read (an image page or a corrupt one, at most
    so many image pages of a document) or skipped."""
    from pyspark.sql import Window

    image = (F.length(squashed(F.coalesce("text", F.lit("")))) < least_chars) & (F.col("image_share") >= least_share)
    order = F.row_number().over(Window.partitionBy(key, "__image").orderBy("page"))
    routed = pages.withColumn("__image", image).withColumn("__n", order)
    route = F.when(F.col("corrupt"), F.lit("read")).when(F.col("__image"), F.when(F.col("__n") <= most, F.lit("read")).otherwise(F.lit("skipped"))).otherwise(F.lit("text"))
    return routed.withColumn("route", route).drop("__image", "__n")


def rendered_pages(pages: DataFrame, key: str = "doc") -> DataFrame:
    """pages (key, page from 0, text, ocr): one text per document, a heading for each page."""
    head = F.concat(F.lit("## Page "), (F.col("page") + 1).cast("string"), F.when(F.col("ocr"), F.lit(" (OCR)")).otherwise(F.lit("")), F.lit("\n\n"), T.strip(F.coalesce("text", F.lit(""))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page", head.alias("t")))), lambda x: x["t"])
    return pages.groupBy(key).agg(F.array_join(parts, "\n\n").alias("markdown"))


def scaled_boxes(boxes: DataFrame, scale: Column, width: Column, height: Column) -> DataFrame:
    """Boxes in points as whole pixels of an image, cut to it; empty ones go."""
    cut = lambda c, most: F.least(F.greatest((F.col(c) * scale).cast("int"), F.lit(0)), most).alias(c)
    others = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    return boxes.select(*others, cut("x0", width), cut("y0", height), cut("x1", width), cut("y1", height)).filter("x1 > x0 AND y1 > y0")


def filled_merges(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, r, c, value): those inside a merged range (merges: keys, n, r1, c1, r2, c2) with the value of its
    first cell; the last range that covers a cell wins."""
    own = merges.select(*(F.col(k).alias(f"m_{k}") for k in keys), "n", "r1", "c1", "r2", "c2")
    first = cells.select(*(F.col(k).alias(f"f_{k}") for k in keys), F.col("r").alias("f_r"), F.col("c").alias("f_c"), F.col("value").alias("f_value"))
    tops = F.lit(True)
    on = F.col("r").between(F.col("r1"), F.col("r2")) & F.col("c").between(F.col("c1"), F.col("c2"))
    for k in keys:
        tops, on = tops & (F.col(f"m_{k}") == F.col(f"f_{k}")), on & (F.col(k) == F.col(f"m_{k}"))
    valued = own.join(first, tops & (F.col("r1") == F.col("f_r")) & (F.col("c1") == F.col("f_c")), "left").select(*(f"m_{k}" for k in keys), "n", "r1", "c1", "r2", "c2", "f_value")
    best = F.max(F.when(F.col("n").isNotNull(), F.struct("n", "f_value"))).alias("__m")
    found = cells.join(valued, on, "left").groupBy(*keys, "r", "c").agg(F.first("value").alias("value"), best)
    return found.select(*keys, "r", "c", F.when(F.col("__m").isNotNull(), F.col("__m.f_value")).otherwise(F.col("value")).alias("value"))
