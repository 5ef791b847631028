"""Text clean-up as column expressions: nothing here leaves the JVM or moves a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.arrays import let, pick

#: White space in the sense of Unicode string stripping, with and without the line feed.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Invisible characters that documents lose, and those that files lose when they are read.
INVISIBLE = "\ufeff\u200b\u200e\u200f"
INVISIBLE_IN_FILES = "\ufeff\u200b\u200e\u200f\u202a\u202b\u202c"
#: The marks around a review confidence.
REVIEW_OPEN, REVIEW_CLOSE = "\ue000", "\ue001"
#: Residue of HTML and CSS, in the order in which it goes.
RESIDUE = (
    r"(?is)<(style|script)\b[^>]*>.*?</\1\s*>",
    r"(?s)<!--.*?-->",
    r"""(?i)\s+(?:style|class|id)="[^"]*\"""",
    r"""\{\s*[a-zA-Z-][a-zA-Z0-9-]*\s*:[^{}"']*\}""",
    r"(?i)</?(?:span|div|font|o:p|w:[a-z]+)\b[^>]*>",
)
#: Two noncharacters tag a line's kind while blocks are cut.
_TABLE, _PROSE = "\ufdd0", "\ufdd1"


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def without_invisible(text: Column, which: str = INVISIBLE) -> Column:
    return F.translate(text, which, "")


def strip(text: Column) -> Column:
    """White space in the Unicode sense off both ends."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def without_residue(text: Column) -> Column:
    for pattern in RESIDUE:
        text = F.regexp_replace(text, pattern, "")
    return text


def single_spaces(line: Column) -> Column:
    """Runs of spaces and tabs after the indent as one space."""
    indent = F.regexp_extract(line, r"\A[ \t]*", 0)
    return F.concat(indent, F.regexp_replace(F.substr(line, F.length(indent) + 1), r"[ \t]{2,}", " "))


def without_trailing_spaces(line: Column) -> Column:
    return F.regexp_replace(line, r"[ \t]+\z", "")


def capped_blank_lines(text: Column, most: int = 1) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n" * (max(1, most) + 1))


def is_table_line(line: Column) -> Column:
    """Whether a line is a row of a pipe table, with or without a review mark behind it."""
    return line.rlike(rf"\A[{SPACE}]*\|.*\|[{SPACE}]*(?:{REVIEW_OPEN}\d{{1,3}}{REVIEW_CLOSE})?[{SPACE}]*\z")


def without_repeats(text: Column) -> Column:
    """Lines that aren't blank and equal the last line that wasn't blank go; blank lines between them stay.

    The text is cut before each line that isn't blank, so a piece is such a line and the blank ones behind it."""
    first = lambda x: F.substring_index(x, "\n", 1)
    rest = lambda x: F.when(F.instr(x, "\n") > 0, F.substr(x, F.instr(x, "\n") + 1))
    pieces = F.split(text, rf"\n(?=[^\n]*[^{SPACE}])")
    blank = lambda x: ~first(x).rlike(rf"[^{SPACE}]")
    kept = let(pieces, lambda p: F.transform(p, lambda x, i: F.when((i > 0) & ~blank(x) & (first(x) == first(F.get(p, i - 1))), rest(x)).otherwise(x)))
    return F.array_join(kept, "\n")


def _prose(text: Column, dedupe: bool, compress: bool, strip_styles: bool, blanks: int) -> Column:
    text = without_residue(text) if strip_styles else text
    clean = lambda x: without_trailing_spaces(single_spaces(x) if compress else x)
    text = F.array_join(F.transform(F.split(text, "\n"), clean), "\n")
    return capped_blank_lines(without_repeats(text) if dedupe else text, blanks)


def blocks(text: Column) -> Column:
    """(kind, text) of a document's blocks in order: code, table or prose.

    The text is cut before each line that opens or closes a fence. Any fence closes any other, so the second, fourth ...
    piece is code, and the line that ends it is the first of the piece after it."""
    pieces = F.split(F.concat(F.lit("\n"), text), rf"\n(?=[{INLINE}]*(?:```|~~~))")
    block = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    first = lambda x: F.substring_index(x, "\n", 1)
    after = lambda x: F.substr(x, F.instr(x, "\n") + 1)

    def cut(p: Column) -> Column:
        code = lambda x, i: block("code", F.concat(x, F.coalesce(F.concat(F.lit("\n"), first(F.get(p, i + 1))), F.lit(""))))
        return F.flatten(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.array(code(x, i))).otherwise(F.flatten(F.transform(pick(F.instr(x, "\n") > 0, after(x)), _runs)))))

    return let(pieces, cut)


def _runs(text: Column) -> Column:
    """Table and prose blocks of a stretch without fences."""
    tag = lambda x: F.when(is_table_line(x), F.concat(F.lit(_TABLE), x, F.lit(_TABLE))).otherwise(F.concat(F.lit(_PROSE), x, F.lit(_PROSE)))
    tagged = F.array_join(F.transform(F.split(text, "\n"), tag), "\n")
    pieces = F.split(tagged, f"(?<={_TABLE})\n(?={_PROSE})|(?<={_PROSE})\n(?={_TABLE})")
    kind = lambda x: F.when(F.startswith(x, F.lit(_TABLE)), F.lit("table")).otherwise(F.lit("prose"))
    return F.transform(pieces, lambda x: F.struct(kind(x).alias("kind"), F.translate(x, _TABLE + _PROSE, "").alias("text")))


def optimized(markdown: Column, dedupe: bool = True, compress_spaces: bool = True, strip_styles: bool = True, max_blank_lines: int = 1) -> Column:
    """Sanitized Markdown: code as it is, table rows trimmed, prose without residue, padding and repeated lines."""
    text = without_invisible(newlines(markdown))
    rows = lambda t: F.array_join(F.transform(F.split(t, "\n"), strip), "\n")
    clean = lambda b: (
        F.when(b["kind"] == "code", F.regexp_replace(b["text"], r"\n+\z", ""))
        .when(b["kind"] == "table", rows(b["text"]))
        .otherwise(_prose(b["text"], dedupe, compress_spaces, strip_styles, max_blank_lines))
    )
    whole = capped_blank_lines(F.array_join(F.transform(blocks(text), clean), "\n"), max_blank_lines)
    return F.when(markdown == "", F.lit("")).otherwise(F.concat(strip(whole), F.lit("\n")))


def clamped_lines(text: Column, most: int = 10_000) -> Column:
    """Every line cut at a length."""
    return F.array_join(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.substring(x, 1, most)), "\n")


def fenced(text: Column, language: Column) -> Column:
    """A code block whose fence is longer than any run of backticks in it."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))
    return F.concat(fence, language, F.lit("\n"), clamped_lines(F.regexp_replace(text, rf"[{SPACE}]+\z", "")), F.lit("\n"), fence)


def passed_through(text: Column) -> Column:
    """Markdown as it is, ending with a line feed."""
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def review_lines(markdown: Column) -> Column:
    """(line, confidence, text) of lines that carry a review mark; lines count from 0."""
    mark = rf"[ \t]*{REVIEW_OPEN}(\d{{1,3}}){REVIEW_CLOSE}"
    found = F.transform(F.split(markdown, "\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_extract(x, mark, 1).alias("confidence"), without_review(x).alias("text")))
    marked = F.filter(found, lambda x: x["confidence"] != "")
    return F.transform(marked, lambda x: F.struct(x["line"].alias("line"), x["confidence"].cast("int").alias("confidence"), strip(x["text"]).alias("text")))


def without_review(markdown: Column) -> Column:
    return F.translate(F.regexp_replace(markdown, rf"[ \t]*{REVIEW_OPEN}(\d{{1,3}}){REVIEW_CLOSE}", ""), REVIEW_OPEN + REVIEW_CLOSE, "")


def with_review(line: Column, confidence: Column) -> Column:
    """The line with its mark; confidences round half to even."""
    return F.concat(F.regexp_replace(line, rf"[{SPACE}]+\z", ""), F.lit(REVIEW_OPEN), F.bround(confidence, 0).cast("int").cast("string"), F.lit(REVIEW_CLOSE))


def with_flags(markdown: Column, lines: Column) -> Column:
    """Visible flags behind review lines, in a table's last cell where the line is a row; confidence 0 has no number."""
    lost = lambda x: F.regexp_replace(x, rf"[{SPACE}]+\z", "")

    def flagged(line: Column, confidence: Column) -> Column:
        flag = F.when(confidence == 0, F.lit("\u26a0")).otherwise(F.concat(F.lit("\u26a0"), confidence.cast("string"), F.lit("%")))
        bare = strip(line)
        row = (F.length(bare) >= 2) & F.startswith(bare, F.lit("|")) & F.endswith(bare, F.lit("|"))
        inside = lost(F.substr(lost(line), F.lit(1), F.length(lost(line)) - 1))
        return F.when(row, F.concat_ws(" ", inside, flag, F.lit("|"))).otherwise(F.concat_ws(" ", lost(line), flag))

    def one(line: Column, i: Column) -> Column:
        return F.aggregate(F.filter(lines, lambda r: r["line"] == i), line, lambda acc, r: flagged(acc, r["confidence"]))

    return F.array_join(F.transform(F.split(markdown, "\n"), one), "\n")
