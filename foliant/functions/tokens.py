"""Token estimate and size figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thousandths of a token per character of a class, as regular expression classes; other characters count 1000.
MILLI = (
    (r"[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]", 1069),
    (r"[\u0e00-\u0e30\u0e32-\u0e33\u0e3b-\u0e46\u0e4f-\u0e7f]", 877),
    (r"[A-Za-z]", 160),
    (r"[0-9]", 715),
    (r"[ \t]", 644),
    (r"\n", 1604),
    (r"[|#*>-]", 440),
    (r"[\x00-\x08\x0b-\x1f!\x22$-)+,./:-=?@\[-`{}~\x7f]", 865),
)


def estimated(text: Column) -> Column:
    """Estimated tokens, in exact integers."""
    counted, total = F.lit(0).cast("long"), F.lit(0).cast("long")
    for pattern, weight in MILLI:
        n = F.regexp_count(text, F.lit(pattern)).cast("long")
        counted, total = counted + n, total + n * weight
    total = total + (F.length(text) - counted) * 1000
    return F.ceil(total / 1000).cast("long")


def estimated_sql(text: str) -> str:
    """The same in DuckDB."""
    count = lambda p: f"length(regexp_replace({text}, '[^{p}]', '', 'g'))"
    classes = (
        (r"\x{0e31}\x{0e34}-\x{0e3a}\x{0e47}-\x{0e4e}", 1069), (r"\x{0e00}-\x{0e30}\x{0e32}-\x{0e33}\x{0e3b}-\x{0e46}\x{0e4f}-\x{0e7f}", 877), ("A-Za-z", 160), ("0-9", 715), (r" \t", 644), (r"\n", 1604), (r"|#*>\-", 440),
        (r"\x00-\x08\x0b-\x1f!\x22$-)+,./:-=?@\[-`{}~\x7f", 865),
    )
    weighed = " + ".join(f"{w - 1000} * {count(p)}" for p, w in classes)
    return f"CAST((1000 * length({text}) + {weighed} + 999) // 1000 AS BIGINT)"


def saved_percent(original: Column, optimized: Column) -> Column:
    """Share of the size that is gone, 0 to 100; 0 where there was none."""
    return F.when(original <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - optimized / original) * 100)))


def fixed_percent(share: Column) -> Column:
    """A share from 0 to 100 with one decimal, as its exact binary value rounds; halves go to the even digit."""
    whole = F.floor(share).cast("long")
    # the fraction in 2^-59, of which ten times still fits; what is cut off lies far under half a digit
    tenfold = ((share - whole) * float(2**59)).cast("long") * 10
    digit, rest, half = F.shiftright(tenfold, 59), tenfold.bitwiseAND(F.lit(2**59 - 1)), F.lit(2**58)
    digits = whole * 10 + digit + F.when((rest > half) | ((rest == half) & (digit % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    return F.concat(F.floor(digits / 10).cast("string"), F.lit("."), (digits % 10).cast("string"), F.lit("%"))


def human_size(size: Column) -> Column:
    """With one decimal from kilobytes on; halves go to the even digit."""
    size = F.greatest(size, F.lit(0)).cast("double")
    shown = lambda unit, by: F.concat(F.format_string("%.1f", F.bround(size / by, 1)), F.lit(f" {unit}"))
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).when(size < 1024**2, shown("KB", 1024)).when(size < 1024**3, shown("MB", 1024**2)).otherwise(shown("GB", 1024**3))


def status(success: Column, warning: Column) -> Column:
    return F.when(~F.coalesce(success, F.lit(False)), F.lit("Error")).when(F.coalesce(warning, F.lit("")) != "", F.lit("Warning")).otherwise(F.lit("Success"))
