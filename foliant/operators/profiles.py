"""Ink along a page's columns and rows, cells of ink that hang together, and words beside each other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.readings import squashed

#: Fixed values, for pages: most ink (of 255) of a quiet column, least share of the width of a gutter (3 columns at least) and of a band.
QUIET, LEAST_GUTTER, LEAST_BAND = 3, 0.0035, 0.10
#: Fixed values, for bars of tables: gray below which a row is dark, rows that make a band.
DARK, DARK_ROWS = 170, 8
#: Fixed values, for Thai read beside Latin words: surer runs stay, longer ones too, and the gap in heights.
SURE, MOST_PIECES, REACH = 80.0, 4, 0.8
#: Fixed values, for cells that weren't read: their size, how far neighbours may lie apart across and down, cells of a run, its height, and its width in heights.
CELL, JOIN, LEAST_CELLS, HEIGHTS, ASPECT = 8, (3, 1), 12, (3, 14), 2.0


def runs(rows: DataFrame, keys: list[str], at: str, flag: Column) -> DataFrame:
    """Stretches of neighbouring places where flag holds: keys, start, stop (exclusive). A place is one row."""
    held = rows.filter(flag).select(*keys, F.col(at).cast("long").alias("__at"))
    island = held.withColumn("__island", F.col("__at") - F.row_number().over(Window.partitionBy(*keys).orderBy("__at")))
    return island.groupBy(*keys, "__island").agg(F.min("__at").alias("start"), (F.max("__at") + 1).alias("stop")).drop("__island")


def gutters(profile: DataFrame, keys: list[str], at: str, ink: str, least: Column, quiet: float = QUIET) -> DataFrame:
    """Quiet stretches of ``least`` columns or more between a page's first and last column with ink."""
    between = Window.partitionBy(*keys)
    loud = F.when(F.col(ink) > quiet, F.col(at))
    inner = profile.withColumns({"__first": F.min(loud).over(between), "__last": F.max(loud).over(between)}).filter(F.col(at).between(F.col("__first"), F.col("__last")))
    return runs(inner, keys, at, F.col(ink) <= quiet).filter(F.col("stop") - F.col("start") >= least)


def dark_bands(profile: DataFrame, keys: list[str], at: str, gray: str, dark: float = DARK, least: int = DARK_ROWS) -> DataFrame:
    """Stretches of dark rows that are tall enough to be a bar."""
    return runs(profile, keys, at, F.col(gray) < dark).filter(F.col("stop") - F.col("start") >= least)


def bands(pages: DataFrame, found: DataFrame, keys: list[str], share: float = LEAST_BAND) -> DataFrame:
    """Pages (keys, width) cut at their gutters (keys, start, stop): keys, band (from 0), left, right. A band of less than
    that share of the width joins the one on its left, and the first one takes in its neighbour; a page without gutters
    is one band."""
    cuts = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    cut = pages.join(cuts, keys, "left").withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<struct<start:bigint,stop:bigint>>")))
    whole = F.col("width").cast("long")
    lefts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cuts", lambda c: c["stop"]))
    rights = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(whole))
    spans = F.filter(F.arrays_zip(lefts.alias("left"), rights.alias("right")), lambda s: s["right"] > s["left"])
    narrow = lambda s: s["right"] - s["left"] < F.col("width") * share

    def joined(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["left"].alias("left"), span["right"].alias("right"))))
        return F.when(narrow(span) | narrow(last), wider).otherwise(F.concat(done, F.array(span)))

    start = F.slice(spans, 1, 1)
    merged = F.aggregate(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), start, joined)
    return cut.select(*keys, F.posexplode(merged).alias("band", "s")).select(*keys, "band", "s.left", "s.right")


def ink_shares(boxes: DataFrame, ink: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes (keys, box, x0, y0, x1, y1; upper bounds exclusive) with the share of their places that have ink (keys, x, y)
    and the mean place of that ink across, as a share of the width; null where there is none."""
    own = ink.select(*(F.col(k).alias(f"__{k}") for k in keys), "x", "y").distinct()
    on = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    counts = boxes.join(own, on, "left").groupBy(*keys, "box", "x0", "y0", "x1", "y1").agg(F.count("x").alias("__n"), F.avg(F.col("x") - F.col("x0")).alias("__mean"))
    width, area = F.col("x1") - F.col("x0"), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return counts.select(*keys, "box", F.when(area > 0, F.col("__n") / area).otherwise(0.0).alias("share"), F.when(width > 0, F.col("__mean") / width).alias("centre"))


def thai_beside_latin(words: DataFrame, keys: list[str], thai: Column, latin: Column) -> DataFrame:
    """words (keys, a line; left, top, width, height, conf, text): short, shaky runs of Thai pieces that touch a Latin
    word, which may be abbreviations read as Thai: keys, run_no, run, neighbour, follows (whether the word stands behind
    the run) and the run's box. The word behind a run counts before the one in front of it."""
    own = Window.partitionBy(*keys).orderBy("left", "text")
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    placed = words.filter(F.trim("text") != "").withColumns({"__thai": thai, "__latin": latin, "__right": right, "__bottom": bottom})
    before = lambda c: F.lag(c).over(own)
    goes_on = F.col("__thai") & before("__thai") & (F.col("left") - before("__right") <= F.col("height") * REACH)
    placed = placed.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run_no", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", F.trim("text").alias("t")))), lambda x: x["t"]), "")
    one = placed.groupBy(*keys, "run_no").agg(
        F.first("__thai").alias("__thai"), F.first("__latin").alias("__latin"), text.alias("run"), F.count("*").alias("__n"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("__conf"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max("__right").alias("x1"), F.max("__bottom").alias("y1"),
    )
    line = Window.partitionBy(*keys).orderBy("run_no")
    near = {f"__{side}_{c}": step(c).over(line) for side, step in (("after", F.lead), ("before", F.lag)) for c in ("run", "__latin", "x0", "x1")}
    reach = (F.col("y1") - F.col("y0")) * REACH
    follows = F.coalesce(F.col("__after___latin") & (F.col("__after_x0") - F.col("x1") <= reach), F.lit(False))
    leads = F.coalesce(F.col("__before___latin") & (F.col("x0") - F.col("__before_x1") <= reach), F.lit(False))
    shaky = F.col("__thai") & (F.col("__n") <= MOST_PIECES) & (F.col("__conf") < SURE)
    found = one.withColumns(near).withColumns({"follows": follows, "__leads": leads}).filter(shaky & (F.col("follows") | F.col("__leads")))
    return found.select(*keys, "run_no", "run", F.when(F.col("follows"), F.col("__after_run")).otherwise(F.col("__before_run")).alias("neighbour"), "follows", "x0", "y0", "x1", "y1")


def pieces(cells: pd.DataFrame, across: int, down: int) -> pd.Series:
    """The piece, by its first cell (by gy, gx), that each cell (gx, gy) belongs to: cells as near as across and down hang together."""
    at = {(x, y): i for i, (x, y) in enumerate(zip(cells["gx"], cells["gy"], strict=True))}
    near = [(dx, dy) for dy in range(-down, down + 1) for dx in range(-across, across + 1)]
    label: dict = {}
    for first in sorted(at, key=lambda c: c[::-1]):
        front = [] if first in label else [first]
        label.setdefault(first, first)
        while front:
            x, y = front.pop()
            fresh = [c for dx, dy in near if (c := (x + dx, y + dy)) in at and c not in label]
            label.update(dict.fromkeys(fresh, first))
            front += fresh
    number = {c: i for i, c in enumerate(sorted(set(label.values()), key=lambda c: c[::-1]))}
    return pd.Series([number[label[x, y]] for x, y in zip(cells["gx"], cells["gy"], strict=True)], index=cells.index, dtype="int64")


def connected(cells: DataFrame, keys: list[str], across: int = 1, down: int = 1) -> DataFrame:
    """cells (keys, gx, gy) with piece, from 0, page by page; a page's cells are few. One piece is a page whose cells all
    have piece 0."""
    each = cells.select(*keys, "gx", "gy").distinct()
    schema = ", ".join(f"{c} {t}" for c, t in each.dtypes) + ", piece long"
    return each.groupBy(*keys).applyInPandas(lambda frame: frame.assign(piece=pieces(frame, across, down)), schema)


def unread_runs(cells: DataFrame, keys: list[str], size: int = CELL) -> DataFrame:
    """Boxes of pieces of unread cells that are shaped like a line of text."""
    found = connected(cells, keys, *JOIN).groupBy(*keys, "piece").agg(F.count("*").alias("__n"), *(f(c).alias(f"__{n}{c}") for c in ("gx", "gy") for n, f in (("a", F.min), ("b", F.max))))
    high, wide = F.col("__bgy") - F.col("__agy") + 1, F.col("__bgx") - F.col("__agx") + 1
    line = found.filter((F.col("__n") >= LEAST_CELLS) & high.between(*HEIGHTS) & (wide >= high * ASPECT))
    return line.select(*keys, (F.col("__agx") * size).alias("x0"), (F.col("__agy") * size).alias("y0"), ((F.col("__bgx") + 1) * size).alias("x1"), ((F.col("__bgy") + 1) * size).alias("y1"))


def wordlike(text: Column) -> Column:
    """Share of letters, digits and marks among the characters that aren't white space; 0 without any."""
    bare = squashed(text)
    return F.when(bare == "", 0.0).otherwise(F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{M}]", "")) / F.length(bare))


def with_line(text: Column, key: Column, line: Column) -> Column:
    """text, its first line that is key without white space replaced by line; as it is where none is."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, squashed), squashed(key))
    changed = F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == at, line).otherwise(x)), "\n")
    return F.when((at > 0) & (squashed(key) != ""), changed).otherwise(text)


def with_run(line: Column, run: Column, neighbour: Column, latin: Column, follows: Column) -> Column:
    """line with latin for the first run beside its neighbour, white space in the run aside, set off by a space from what
    stands in front; null where the line doesn't have it there."""
    quoted = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}\p{M}\s])", r"\\$1")
    spaced = F.regexp_replace(F.regexp_replace(quoted(squashed(run)), r"(\\?.)", r"$1\\s*"), r"\\s\*\z", "")
    behind = F.concat(F.lit("(?s)\\A(.*?)"), spaced, F.lit("(?=\\s*"), quoted(neighbour), F.lit(").*\\z"))
    before = F.concat(F.lit("(?s)\\A(.*?"), quoted(neighbour), F.lit("\\s*)"), spaced, F.lit(".*\\z"))
    pattern = F.when(follows, behind).otherwise(before)
    front = F.regexp_replace(line, pattern, F.lit("$1"))
    rest = F.regexp_replace(F.substring(line, F.length(front) + 1, F.length(line)), F.concat(F.lit("\\A"), spaced), F.lit(""))
    gap = F.when((front == "") | front.rlike(r"\s\z"), F.lit("")).otherwise(F.lit(" "))
    return F.when(F.regexp_like(line, pattern), F.concat(front, gap, latin, rest))
