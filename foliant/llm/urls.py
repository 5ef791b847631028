"""URL filters over a sorted digest array.

The list's keys (host suffix followed by path prefix) are stored as one file: 64-bit xxhash digests in ascending order,
and the keys themselves in the same order. Tasks map the file into memory, probe all candidate keys of a batch by one
vectorised binary search, and confirm each hit against the stored key, so a collision of digests changes nothing.

A list of any length takes the same way: a DataFrame of keys is sorted by digest as a job and streamed into the file, a
partition at a time; ``SparkContext.addFile`` sends it to the executors, whose disks must hold it (the list's bytes and
17 more a key). Of rules with one key the first holds; a key that stands twice in the block list counts once.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict; a null or empty key of the block list fits nothing; a null id is carried; repeated rows are each judged; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"FOLIDX02"
#: Spark's xxhash64 of a string, as an unsigned number, is xxhash of its UTF-8 bytes with this seed.
SEED = 42

#: The rules (host and path, verdict) that every judgement starts from.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: A small default block list; pass the list in use as ``blocked``.
BLOCKED = ("adult-x.example.net/", "adult-x.example.org/", "casino.example.net/", "casino.example.org/", "malware.example.net/", "malware.example.org/", "spam-farm.example.net/", "spam-farm.example.org/")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), SEED)


def path_length(key: bytes) -> int:
    """Bytes of a key's path; of a key without one, 0."""
    return len(key) - key.find(b"/") if b"/" in key else 0


class DigestArray:
    """Keys by digest, with a kind each."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            magic, n, size, m = struct.unpack("<8sQQQ", f.read(32))
            if magic != MAGIC:
                raise ValueError(f"{path} is no digest array")
            f.seek(32 + 17 * n + size)
            self.path_lengths = np.frombuffer(f.read(8 * m), "<u8").tolist()
        part = lambda kind, at, k: np.memmap(path, kind, "r", at, (k,)) if k else np.empty(0, kind)
        self.digests = part("<u8", 32, n)
        self.ends = part("<u8", 32 + 8 * n, n)
        self.kinds = part("u1", 32 + 16 * n, n)
        self.blob = part("u1", 32 + 17 * n, size)

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, int]], hashing=digest) -> None:
        """entries: (key, kind) in any order; of equal keys the first stays."""
        first: dict[str, int] = {}
        for key, kind in entries:
            first.setdefault(key, kind)
        DigestArray.write_sorted(path, sorted((hashing(k), k.encode("utf-8", "surrogatepass"), kind) for k, kind in first.items()))

    @staticmethod
    def write_sorted(path: str, rows: Iterable[tuple[int, bytes, int]]) -> None:
        """rows: (digest, key, kind) by ascending digest, each key once. Held are 17 bytes a key; the keys go to the file
        as they come, and to their place when their number is known."""
        digests, ends, kinds, lengths, size = array("Q"), array("Q"), bytearray(), set(), 0
        with tempfile.TemporaryFile() as keys, open(path, "wb") as f:
            for number, key, kind in rows:
                size += len(key)
                keys.write(key)
                digests.append(number)
                ends.append(size)
                kinds.append(kind)
                lengths.add(path_length(key))
            f.write(struct.pack("<8sQQQ", MAGIC, len(digests), size, len(lengths)))
            for part in (digests, ends):
                f.write(np.frombuffer(part, np.uint64).astype("<u8").tobytes())
            f.write(kinds)
            keys.seek(0)
            while some := keys.read(1 << 20):
                f.write(some)
            f.write(np.array(sorted(lengths), "<u8").tobytes())

    def key(self, i: int) -> str:
        return bytes(self.blob[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])]).decode("utf-8", "surrogatepass")

    def probe(self, keys: list[str], hashing=digest) -> np.ndarray:
        """The entry of each key, or -1."""
        wanted = np.fromiter(map(hashing, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        found = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == wanted[inside]].tolist():
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # all keys of this digest
                if self.key(j) == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def candidates(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Each host suffix with each path prefix that an entry could have; lengths are of UTF-8 bytes."""
    if not host:
        return []
    parts = host.split(".")
    if path.isascii():
        paths = [path[:n] for n in path_lengths if n <= len(path)]
    else:  # a prefix that ends inside a character is no entry's
        raw = path.encode("utf-8", "surrogatepass")
        paths = [raw[:n].decode("utf-8", "surrogatepass") for n in path_lengths if n <= len(raw) and (n == len(raw) or raw[n] & 0xC0 != 0x80)]
    return [".".join(parts[i:]) + p for i in range(len(parts)) for p in paths]


#: What an entry does: bits for a rule that allows, a rule that blocks, and the block list.
ALLOWS, BLOCKS, LISTED = 1, 2, 4


def _sorted_entries(rules: dict[str, str], blocked: DataFrame) -> Iterator[tuple[int, bytes, int]]:
    """All entries by ascending digest: the block list sorted as a job and streamed, the rules (few) merged into it."""
    kinds = {k: ALLOWS if v == "allow" else BLOCKS for k, v in rules.items()}
    key = F.col(blocked.columns[0]).cast("string")
    keys = blocked.select(key.alias("key")).filter("key <> ''").distinct().withColumn("digest", F.xxhash64("key"))
    # unsigned order: numbers from 0 up come before the negative ones
    keys = keys.orderBy(F.col("digest") < 0, "digest", "key")
    own = sorted((digest(k), k.encode("utf-8", "surrogatepass"), kind) for k, kind in kinds.items())
    at = 0
    for row in keys.toLocalIterator():
        raw = row["key"].encode("utf-8", "surrogatepass")
        number = row["digest"] % (1 << 64)
        while at < len(own) and own[at][:2] < (number, raw):
            yield own[at]
            at += 1
        both = at < len(own) and own[at][1] == raw
        yield number, raw, LISTED | (own[at][2] if both else 0)
        at += both
    yield from own[at:]


@lru_cache(maxsize=1)
def _folder() -> tempfile.TemporaryDirectory:
    """Where the driver keeps the files that it serves; removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="digests-")


def judged(pages: DataFrame, rules=RULES, blocked: Iterable[str] | DataFrame = BLOCKED, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed: the longest rule that fits decides, else the block list, else ``default``.
    blocked: keys, or a DataFrame whose first column has them."""
    first: dict[str, str] = {}
    for key, verdict in rules:
        first.setdefault(key, verdict)
    spark = pages.sparkSession
    name = f"{uuid.uuid4().hex}.idx"
    local = os.path.join(_folder().name, name)
    if isinstance(blocked, DataFrame):
        DigestArray.write_sorted(local, _sorted_entries(first, blocked))
    else:
        listed = {k for k in blocked if k}
        kinds = {k: ALLOWS if v == "allow" else BLOCKS for k, v in first.items()}
        DigestArray.write(local, [(k, kinds.get(k, 0) | (LISTED if k in listed else 0)) for k in listed | kinds.keys()])
    spark.sparkContext.addFile(local)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            split = [split_url(u.as_py()) for u in batch.column("url")]
            each = [candidates(h, p, index.path_lengths) for h, p in split]
            found = index.probe([k for keys in each for k in keys]).tolist()
            rows, at = [], 0
            for (host, path), keys in zip(split, each, strict=True):
                hits = [(k, int(index.kinds[j])) for k, j in zip(keys, found[at : at + len(keys)], strict=True) if j >= 0]
                at += len(keys)
                rule = max((x for x in hits if x[1] & (ALLOWS | BLOCKS)), key=lambda x: (len(x[0]), x[0].find("/")), default=None)
                on = max((x[0] for x in hits if x[1] & LISTED), key=len, default=None)
                verdict = ("allow" if rule[1] & ALLOWS else "block") if rule else "block" if on else default
                rows.append((host, path, rule and rule[0], verdict, on))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array([r[i] for r in rows], pa.string()) for i in range(5))], names=["page_id", "host", "path", "rule", "verdict", "listed"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, listed string")


def oracle_sql(rules=RULES, blocked: Iterable[str] = BLOCKED) -> str:
    """DuckDB SQL for the columns of judged() that its contract names."""
    values = ", ".join(f"('{k[: k.find('/')]}', '{k[k.find('/') :]}', '{k}', '{v}')" for k, v in rules)
    names = ", ".join(f"('{k[: k.find('/')]}', '{k[k.find('/') :]}')" for k in blocked)
    return f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
         r(h, p, rule, verdict) AS (VALUES {values}), b(h, p) AS (VALUES {names}),
         x AS (SELECT u.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS best,
                      EXISTS (SELECT 1 FROM b WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS listed FROM u)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM x"""


