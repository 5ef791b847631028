"""Grids (arrays of rows of cells) as pipe tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import let
from foliant.functions.text import INLINE, SPACE, strip

#: Characters of two columns' width, and those of none.
WIDE = r"\u1100-\u115f\u231a\u231b\u2329\u232a\u2e80-\u303e\u3041-\ua4cf\ua960-\ua97f\uac00-\ud7a3\uf900-\ufaff\ufe10-\ufe19\ufe30-\ufe6f\uff01-\uff60\uffe0-\uffe6\x{1f300}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f900}-\x{1f9ff}\x{20000}-\x{3fffd}"
NO_WIDTH = r"\p{Mn}\p{Me}\p{Cf}"


def escaped(cell: Column) -> Column:
    """A cell's text: no control characters, backslashes and pipes escaped, lines parted by <br>; null is empty."""
    text = F.regexp_replace(cell, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x: strip(F.regexp_replace(x, rf"[{INLINE}]+", " ")))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x != ""), "<br>"), F.lit(""))


def shown(value: Column, kind: str) -> Column:
    """A value as text before it is escaped; kind: the column's type."""
    return F.when(value, F.lit("true")).otherwise(F.lit("false")) if kind == "boolean" else value.cast("string")


def normalized(rows: Column, drop_empty: bool = True) -> Column:
    """Escaped rows of one width; rows without any text go."""
    cells = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, escaped))
    cells = F.filter(cells, lambda r: F.exists(r, lambda c: c != "")) if drop_empty else cells

    def padded(grid: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
        return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))

    return let(cells, padded)


def rendered(rows: Column, header: bool = True, alignments: list[str | None] | None = None, name_empty: bool = False) -> Column:
    """A GitHub table; without rows an empty text."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    marks = {"left": ":---", "right": "---:", "center": ":---:"}
    given = [marks.get(a or "", "---") for a in alignments or []]

    def whole(grid: Column) -> Column:
        width = F.size(grid[0])
        names = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("col"), i.cast("string")))
        if not header:
            head, body = names, grid
        else:
            head = F.zip_with(grid[0], names, lambda c, n: F.when(c == "", n).otherwise(c)) if name_empty else grid[0]
            body = F.slice(grid, 2, F.size(grid))
        bars = F.slice(F.concat(F.array(*map(F.lit, given)).cast("array<string>"), F.array_repeat(F.lit("---"), width)), 1, width)
        return F.when(F.size(grid) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(head), line(bars)), F.transform(body, line)), "\n"))

    return let(normalized(rows), whole)


def display_width(text: Column) -> Column:
    """Columns that a terminal needs."""
    return F.length(F.regexp_replace(text, f"[{NO_WIDTH}]", "")) + F.regexp_count(text, F.lit(f"[{WIDE}]"))


def without_blank_columns(rows: Column) -> Column:
    """Trailing columns that are blank in all rows go."""
    used = lambda r: F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(c.rlike(f"[^{SPACE}]"), i + 1).otherwise(0))), F.lit(0))
    return let(rows, lambda g: let(F.coalesce(F.array_max(F.transform(g, used)), F.lit(0)), lambda n: F.when(n == 0, F.filter(g, lambda _: F.lit(False))).otherwise(F.transform(g, lambda r: F.slice(r, 1, n)))))


def shown_time(value: Column) -> Column:
    """Midnight as a date, else date and time in seconds."""
    return F.when(F.date_format(value, "HH:mm:ss.SSSSSS") == "00:00:00.000000", F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))


def shown_percent(value: Column, decimals: int) -> Column:
    """A share as per cent, from its decimal text."""
    return F.concat(F.round(value.cast("decimal(30,12)") * 100, decimals).cast(f"decimal(30,{decimals})").cast("string"), F.lit("%"))


def shown_fixed(value: Column, decimals: int) -> Column:
    return F.round(value.cast("decimal(30,12)"), decimals).cast(f"decimal(30,{decimals})").cast("string")


def is_title_row(row: Column) -> Column:
    """At most one value."""
    return F.size(F.filter(row, lambda c: c.rlike(f"[^{SPACE}]"))) <= 1


def split_titles(rows: Column, most: int = 5, least: int = 3) -> Column:
    """(titles, rows): leading rows of at most one value are titles where a row of at least ``least`` values follows them
    within the first ``most`` + 1 rows, with none of two values between."""
    count = lambda r: F.size(F.filter(r, lambda c: c.rlike(f"[^{SPACE}]")))

    def cut(grid: Column) -> Column:
        counts = F.transform(F.slice(grid, 1, most + 1), count)
        # the first row with two values or more decides
        at = F.array_position(F.transform(counts, lambda n: n >= 2), True).cast("int")
        found = (at > 0) & (F.get(counts, at - 1) >= least)
        first = lambda r: F.array_join(F.filter(F.split(F.get(F.filter(r, lambda c: c.rlike(f"[^{SPACE}]")), F.lit(0)), rf"[{SPACE}]+"), lambda w: w != ""), " ")
        titles = F.transform(F.filter(F.slice(grid, 1, F.greatest(at - 1, F.lit(0))), lambda r: count(r) > 0), first)
        none = F.array().cast("array<string>")
        return F.struct(F.when(found, titles).otherwise(none).alias("titles"), F.when(found, F.slice(grid, F.greatest(at, F.lit(1)), F.size(grid))).otherwise(grid).alias("rows"))

    return let(rows, cut)
