"""Thai text: spelling of marks, and signs that a text layer is mis-encoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of characters.
TONES = r"\u0e48-\u0e4b"
MARKS = r"\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
LETTERS = r"\u0e01-\u0e3a\u0e40-\u0e4e"
EXTENDED = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SYMBOLS = r"""[!?"#$%&()*+<=>@\[\]^_`{|}~0-9]"""
SARA_AA, SARA_AM, NIKHAHIT = "\u0e32", "\u0e33", "\u0e4d"
#: Symbols that dingbat fonts draw, by family and byte.
DINGBATS = (
    ("wingdings", 0xFC, "\u2713"), ("wingdings", 0xFB, "\u2717"), ("wingdings", 0xFE, "\u2611"), ("wingdings", 0xFD, "\u2612"), ("wingdings", 0xA8, "\u2610"), ("wingdings", 0x6C, "\u25cf"),
    ("wingdings2", 0x52, "\u2611"), ("wingdings2", 0x54, "\u2612"), ("webdings", 0xE3, "\U0001f6cf"),
    ("zapfdingbats", 0x33, "\u2713"), ("zapfdingbats", 0x34, "\u2714"), ("zapfdingbats", 0x35, "\u2715"), ("zapfdingbats", 0x36, "\u2716"), ("zapfdingbats", 0x37, "\u2717"), ("zapfdingbats", 0x38, "\u2718"),
)


def normalized(text: Column) -> Column:
    """One spelling: a doubled tone before sara aa is a tone and sara am; no mark stands twice; nikhahit and sara aa
    are sara am, the tone before it."""
    text = F.regexp_replace(text, f"([{TONES}])\\1{SARA_AA}", f"$1{SARA_AM}")
    text = F.regexp_replace(text, f"([{MARKS}])\\1+", "$1")
    return F.regexp_replace(text, f"([{TONES}]?){NIKHAHIT}([{TONES}]?){SARA_AA}", f"$1$2{SARA_AM}")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def extended_hits(text: Column) -> Column:
    """Latin Extended letters directly between Thai characters."""
    return _count(text, f"[\\u0e01-\\u0e5b][{EXTENDED}]{{1,2}}(?=[\\u0e01-\\u0e5b])")


def letters(text: Column) -> Column:
    return _count(text, f"[{LETTERS}]")


def has_swapped_letters(text: Column, least: int = 3, most: int = 500) -> Column:
    hits = extended_hits(text)
    return (hits >= least) & (letters(text) <= hits * most)


def has_lost_marks(text: Column) -> Column:
    """Three control characters, or symbols between Thai letters too often for the amount of Thai."""
    thai = letters(text)
    between = _count(text, f"[\\u0e01-\\u0e4e]{SYMBOLS}[\\u0e01-\\u0e4e]")
    return (_count(text, CONTROLS) >= 3) | ((thai >= 50) & (between >= F.greatest(F.lit(6), F.floor(thai / 300))))


def is_corrupt(text: Column) -> Column:
    return has_swapped_letters(text) | has_lost_marks(text)


def is_valid_cluster(marks: Column) -> Column:
    """At most one mark of each class."""
    classes = (r"[\u0e31\u0e34-\u0e37\u0e47\u0e4d]", r"[\u0e38-\u0e3a]", f"[{TONES}\\u0e4c]")
    out = F.lit(True)
    for pattern in classes:
        out = out & (_count(marks, pattern) <= 1)
    return out


def font_family(font: Column) -> Column:
    style = r"(?i)[,\-\s]*(?:bold|italic|oblique|regular|black|light|medium|semibold)+"
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(font, r"([^+]*)\z", 1), style, "")))


def dingbat(char: Column, font: Column) -> Column:
    """The symbol that a dingbat font draws for a private-use character or a bare byte; any other character as it is."""
    family = F.regexp_replace(font_family(font), "[^a-z0-9]", "")
    family = F.when(F.endswith(family, F.lit("zapfdingbats")), F.lit("zapfdingbats")).otherwise(family)
    point = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("long")
    code = F.when(point.between(0xF020, 0xF0FF), point - 0xF000).when(point < 0x100, point)
    table = F.create_map(*(F.lit(x) for f, c, s in DINGBATS for x in (f"{f}:{c}", s)))
    return F.when(F.length(char) == 1, F.coalesce(table[F.concat_ws(":", family, code.cast("string"))], char)).otherwise(char)
