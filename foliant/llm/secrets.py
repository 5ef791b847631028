"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Candidates are runs of characters that keys are written with. Over a run, the counts of each class's characters are
kept for a window that moves by one; the entropy follows from the counts in constant time a step. A stretch of windows
over the class's limit is a span, unless an allow list suppresses it.

Defined results: a null or empty text has no spans; positions are code points of the whole text, ends exclusive;
a null id is carried; repeated rows are each scanned; an empty table gives no rows; other columns are kept by
``redacted`` and ignored by ``secret_spans``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import bounded_batches, plain_memory

#: The patterns of the base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: Least length of what counts: of assign the value, of the others the whole.
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Per class: its characters, the window, and the bits of entropy that a window needs. The short windows are as long as
#: the least candidate; small alphabets need fewer bits, base32 lies within the alphanumerics of one case.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 32, 3.0),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 24, 4.1),
    ("short hex", frozenset("0123456789abcdefABCDEF"), 20, 2.8),
    ("lower", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.4),
    ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.3),
    ("base62", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.7),
    ("short base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 20, 4.0),
)
#: What suppresses a candidate: placeholders, UUIDs, dates, file names and the like.
ALLOW = (
    r"(?i:example|sample|dummy|placeholder|changeme|xxxx)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_+=-]+$",
    r"^[A-Za-z]+([/_-][A-Za-z]+)*$",
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns; each kind's matches don't overlap, from the left."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    # a run shorter than the least length fails as a whole, so the length may stand in the pattern
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def window_entropies(run: str, size: int) -> list[float]:
    """Shannon entropy in bits of each window, from counts that change by one character in and one out."""
    table = [0.0] + [n * math.log2(n) for n in range(1, size + 2)]  # the new character counts before the old one goes
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += table[n + 1] - table[n]
        if i >= size:
            n = counts[d := run[i - size]]
            counts[d] = n - 1
            total += table[n - 1] - table[n]
        if i >= size - 1:
            out.append(math.log2(size) - total / size)
    return out


def entropy_spans(text: str, classes=CLASSES, allow: tuple[str, ...] = ALLOW) -> list[tuple[int, int]]:
    """Stretches of candidate runs in which a class's windows pass its limit; overlapping ones are one."""
    skip, found = [re.compile(x) for x in allow], []
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        if any(x.search(run) for x in skip):
            continue
        for _, letters, size, limit in classes:
            spans: list[list[int]] = []  # a later class may start in front of an earlier one's spans
            for part in re.finditer("[" + re.escape("".join(sorted(letters))) + f"]{{{size},}}", run):
                s = part[0]
                if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
                    continue
                for i, h in enumerate(window_entropies(s, size)):
                    if h >= limit:
                        a = m.start() + part.start() + i
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = a + size
                        else:
                            spans.append([a, a + size])
            found += spans
    merged: list[list[int]] = []
    for a, b in sorted(map(tuple, found)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def all_spans(text: str, classes=CLASSES, allow: tuple[str, ...] = ALLOW) -> list[tuple[int, int, int]]:
    """Base spans, and those entropy spans that no base span already holds."""
    base, more, at, reach = base_spans(text), [], 0, -1
    for a, b in entropy_spans(text, classes, allow):  # from the left, so one pass over the base spans is enough
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if reach < b:
            more.append((a, 3, b))
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, classes=CLASSES, allow: tuple[str, ...] = ALLOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its base and all spans as arrays of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]
        for batch in batches:
            found = [all_spans(t.as_py() or "", classes, allow) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([named([x for x in f if x[1] < 3]) for f in found], spans), pa.array(list(map(named, found)), spans)], names=["doc_id", "base", "spans"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    one = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, base {one}, spans {one}")


def redacted(docs: DataFrame, mark: str = "[SECRET]", classes=CLASSES, allow: tuple[str, ...] = ALLOW, text_column: str = "text") -> DataFrame:
    """docs, every column kept, with each stretch that spans cover replaced by a mark. A null text stays null."""

    bounded_batches(docs.sparkSession)

    def clean(text: str) -> str:
        out, at = [], 0
        for a, _, b in all_spans(text, classes, allow):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else clean(t) for x in texts], pa.string())

    return docs.withColumn(text_column, masked(F.col(text_column)))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per base kind, the base spans' digest, and all spans, as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


__all__ = ["all_spans", "base_spans", "digest_columns", "entropy_spans", "joined", "redacted", "secret_spans", "window_entropies"]
