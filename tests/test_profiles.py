"""Profiles of pages, pieces of ink and edits of lines, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import profiles


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def stretches(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def test_gutters_and_bands(spark):
    rng = random.Random(3)
    pages = {p: [rng.choice((0, 0, 0, 9)) for _ in range(60)] for p in range(8)} | {8: [0] * 20, 9: [9] * 20}
    profile = spark.createDataFrame([(p, x, v) for p, c in pages.items() for x, v in enumerate(c)], "page int, x int, ink int")
    found = profiles.gutters(profile, ["page"], "x", "ink", F.lit(3))
    wanted, cut = [], []
    for p, c in pages.items():
        loud = [x for x, v in enumerate(c) if v > 3]
        gaps = [(a, b) for a, b in stretches([v <= 3 for v in c]) if loud and loud[0] < a and b <= loud[-1] and b - a >= 3]
        wanted += [(p, a, b) for a, b in gaps]
        merged = []
        for a, b in zip([0, *(g[1] for g in gaps)], [*(g[0] for g in gaps), len(c)], strict=True):
            if merged and min(b - a, merged[-1][1] - merged[-1][0]) < 0.1 * len(c):
                merged[-1][1] = b
            else:
                merged.append([a, b])
        cut += [(p, i, *m) for i, m in enumerate(merged)]
    assert rows(found, "page", "start", "stop") == sorted(wanted) and wanted
    sizes = spark.createDataFrame([(p, len(c)) for p, c in pages.items()], "page int, width int")
    assert rows(profiles.bands(sizes, found, ["page"]), "page", "band", "left", "right") == sorted(cut)
    dark = profile.withColumn("gray", F.col("ink") * 20)
    assert rows(profiles.dark_bands(dark, ["page"], "x", "gray", 100, 4), "page", "start", "stop") == sorted((p, a, b) for p, c in pages.items() for a, b in stretches([v < 5 for v in c]) if b - a >= 4)


def test_ink(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 4, 2), (1, 1, 10, 10, 12, 12), (1, 2, 5, 5, 5, 9)], "page int, box int, x0 int, y0 int, x1 int, y1 int")
    ink = spark.createDataFrame([(1, 0, 0), (1, 3, 1), (1, 3, 1), (1, 4, 1), (2, 10, 10)], "page int, x int, y int")
    assert rows(profiles.ink_shares(boxes, ink, ["page"]).fillna(-1.0), "box", "share", "centre") == [(0, 0.25, 0.375), (1, 0.0, -1.0), (2, 0.0, -1.0)]


def test_pieces(spark):
    rng = random.Random(5)
    cells = [(p, rng.randrange(14), rng.randrange(14)) for p in range(3) for _ in range(60)]
    got = {(r.page, r.gx, r.gy): r.piece for r in profiles.connected(spark.createDataFrame(cells, "page int, gx int, gy int"), ["page"]).collect()}
    assert set(got) == set(cells)
    near = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 1
    assert all(got[a] == got[b] for a in got for b in got if near(a, b))
    for p in range(3):  # pieces hang together: each but the least cell is reached from it
        for n in {v for k, v in got.items() if k[0] == p}:
            own = {k for k, v in got.items() if k[0] == p and v == n}
            seen = {min(own)}
            while fresh := {b for a in seen for b in own - seen if near(a, b)}:
                seen |= fresh
            assert seen == own
    line = [(1, x, y) for x in range(0, 24, 3) for y in range(3)]
    speck = [(1, 60, 60), (1, 61, 60)]
    runs = profiles.unread_runs(spark.createDataFrame(line + speck, "page int, gx int, gy int"), ["page"])
    assert rows(runs, "page", "x0", "y0", "x1", "y1") == [(1, 0, 0, 176, 24)]
    assert profiles.connected(spark.createDataFrame([], "page int, gx int, gy int"), ["page"]).count() == 0


def test_thai_beside_latin(spark):
    words = [
        (1, 0, 10, 10, 10, 50.0, "กข"), (1, 11, 10, 8, 10, 60.0, "ค"), (1, 20, 10, 30, 10, 95.0, "Form"),  # before a Latin word
        (2, 0, 10, 30, 10, 95.0, "Form"), (2, 33, 10, 10, 10, 40.0, "ก"), (2, 90, 10, 10, 10, 40.0, "ข"),  # behind one, and too far
        (3, 0, 10, 10, 10, 90.0, "กข"), (3, 12, 10, 30, 10, 95.0, "Form"),  # sure
        (4, 0, 10, 10, 10, -1.0, "กข"), (4, 12, 10, 30, 10, 95.0, "Form"),  # no confidence
        *((5, 11 * i, 10, 10, 10, 40.0, "ก") for i in range(5)), (5, 55, 10, 30, 10, 95.0, "Form"),  # too many
    ]
    frame = spark.createDataFrame(words, "line int, left int, top int, width int, height int, conf double, text string")
    found = profiles.thai_beside_latin(frame, ["line"], F.col("text").rlike("[ก-๛]"), F.col("text").rlike(r"\A[A-Za-z]{3,}\z"))
    assert rows(found, "line", "run", "neighbour", "follows", "x0", "x1") == [(1, "กขค", "Form", True, 0, 19), (2, "ก", "Form", False, 33, 43)]


@pytest.mark.parametrize("line, run, neighbour, latin, follows, wanted", [
    ("see ก ข Form 2", "กข", "Form", "QP", True, "see QP Form 2"), ("ab กข Form", "กข", "Form", "QP", True, "ab QP Form"), ("abกขForm", "กข", "Form", "QP", True, "ab QPForm"),
    ("Form กข end", "กข", "Form", "QP", False, "Form QP end"), ("Formกข", "กข", "Form", "QP", False, "Form QP"), ("กข end Form", "กข", "Form", "QP", True, None), ("a.b (ก) F.x", "(ก)", "F.x", "QP", True, "a.b QP F.x"),
    ("กข x กข Form", "กข", "Form", "QP", True, "กข x QP Form"),
])
def test_with_run(spark, line, run, neighbour, latin, follows, wanted):
    frame = spark.createDataFrame([(line, run, neighbour, latin, follows)], "line string, run string, neighbour string, latin string, follows boolean")
    assert frame.select(profiles.with_run(*(F.col(c) for c in frame.columns)).alias("x")).first().x == wanted


def test_lines(spark):
    frame = spark.createDataFrame([("a b\n ab\nc", "ab", "new"), ("x", "ab", "new"), ("\nx", "", "new"), (None, "ab", "new")], "text string, key string, line string")
    assert [r.x for r in frame.select(profiles.with_line(*(F.col(c) for c in frame.columns)).alias("x")).collect()] == ["new\n ab\nc", "x", "\nx", None]
    shares = spark.createDataFrame([("ab 1-",), ("ที่",), (" \n",), (None,)], "t string").select(profiles.wordlike(F.col("t")).alias("x"))
    assert [r.x for r in shares.collect()] == [0.75, 1.0, 0.0, None]
