"""Super-k-mers: consecutive windows of a document that share a minimiser, packed as one string for its bucket.

A window is a run of ``window`` units (words or bytes); its minimiser is the least hash among the grams in it. Windows
that are equal have equal minimisers and so meet in one bucket, whatever document they come from. Each task packs what
it has for a bucket into compressed Arrow blobs, so a shuffle moves few rows and little more text than it must.

Super-k-mers that a task has already sent are not sent again where the answer is known: their places alone travel, as
"settled". So a passage that a third of all documents share puts a few rows per task into its bucket, not one per
document. Which ones were sent is known by 128 bits (xxh3) of their bytes. What a task remembers is bounded by REMEMBERED;
forgetting costs bytes, never results.

A minimiser that very many different strings hold would make one huge bucket. A sample of the documents names such ones,
and everywhere their super-k-mers are cut where a second, longer minimiser changes, and dealt by both. Equal windows have
both in common, so the sample decides where strings meet, never what is found. Long texts are cut into pieces whose
windows follow on each other, and tasks grow in number with the text, so what a task holds doesn't grow with the input.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded_batches, mix, plain_memory, rolled, text_slices, window_min

SLICE_BYTES = 512 << 10
#: What a task packs before it hands on a blob for each bucket.
HELD_BYTES = 16 << 20
#: Bytes of text of which a bucket gets the super-k-mers; its task holds some three times as much, and their windows.
BUCKET_BYTES = 3 << 19
#: Buckets that a task gets.
TASK_BUCKETS = 12
REMEMBERED = 100_000
#: The sample that names hot minimisers: so many bytes, or this share of the text if that is more; a minimiser is hot where
#: its different strings would fill HOT_BUCKETS buckets, as far as HOT_FLOOR bytes of the sample can tell.
SAMPLE_BYTES, SAMPLE_SHARE, HOT_BUCKETS, HOT_FLOOR = 32 << 20, 0.001, 2, 64 << 10
#: A null id is taken for the largest.
NO_ID = np.iinfo(np.int64).max


class Units:
    """What a slice of texts is made of: bounds of each text's units, the units' hashes, and where in data they stand.
    Without ``starts`` each byte is a unit."""

    def __init__(self, bounds: np.ndarray, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.bounds, self.hashes, self.data, self.starts, self.ends = bounds, hashes, data, starts, ends

    def places(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (first, last + 1) if self.starts is None else (self.starts[first], self.ends[last])


def runs(units: Units, grams: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer: text's number, first window's unit, number of windows, minimiser. grams: by first unit."""
    n = int(units.bounds[-1])
    if n < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    least = window_min(grams, window - gram + 1)
    owner = np.repeat(np.arange(len(units.bounds) - 1), np.diff(units.bounds))
    valid = owner[: n - window + 1] == owner[window - 1 :]
    before = np.concatenate(([False], valid[:-1]))
    new = valid & (~before | np.concatenate(([True], least[1:] != least[:-1])))
    first = np.flatnonzero(new)
    if not len(first):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    # windows that are valid and not new go on with the run before them
    counts = np.add.reduceat(valid.astype(np.int64), first)
    return owner[first], first, counts, least[first]


def once(grams: np.ndarray, width: int, first: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each super-k-mer holds its minimiser once; only then its windows surely differ from each other."""
    if not len(first):
        return np.empty(0, bool)
    # a gram is some window's minimiser where the greatest minimiser of the windows around it isn't greater than it
    edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    around = ~window_min(np.concatenate((edge, ~window_min(grams, width), edge)), width)
    at = np.flatnonzero(around == grams)
    low, high = np.searchsorted(at, first), np.searchsorted(at, first + counts + width - 1)
    each = high - low
    total = np.cumsum(each)
    own = np.repeat(np.arange(len(first)), each)
    held = grams[at[np.arange(int(total[-1])) - np.repeat(total - each - low, each)]] == least[own]
    return np.bincount(own, held, len(first)) == 1


def to_blob(columns: np.ndarray, lengths: np.ndarray, data: bytes) -> bytes:
    """columns: doc, key, start, windows, mark of each super-k-mer; lengths of their texts, which data holds."""
    raw = b"".join((struct.pack("<q", len(lengths)), columns.astype("<i8").tobytes(), lengths.astype("<i4").tobytes(), data))
    return zstandard.ZstdCompressor(level=6).compress(raw)


def from_blobs(blobs: list[bytes]) -> pa.RecordBatch:
    columns, lengths, texts = [np.empty((5, 0), np.int64)], [np.empty(0, np.int64)], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", raw)[0]
        columns.append(np.frombuffer(raw, "<i8", 5 * n, 8).reshape(5, n))
        lengths.append(np.frombuffer(raw, "<i4", n, 8 + 40 * n).astype(np.int64))
        texts.append(memoryview(raw)[8 + 44 * n :])
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int64)
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))])
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in np.concatenate(columns, axis=1)), text], names=["doc", "key", "start", "windows", "mark", "text"])


def split_hot(units: Units, gram: int, window: int, hot: np.ndarray, owner: np.ndarray, first: np.ndarray, counts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """runs() with those of hot minimisers cut where the least of longer grams changes; both make their minimiser."""
    at = np.minimum(np.searchsorted(hot, least), max(len(hot) - 1, 0))
    which = np.flatnonzero(hot[at] == least) if len(hot) else np.empty(0, np.int64)
    if not len(which):
        return owner, first, counts, least
    # the units of hot strings one after another; windows that lie across two of them are left out by ``own``
    wide, spans = min(2 * gram, window), counts[which] + window - 1
    ends, total = np.cumsum(spans), np.cumsum(counts[which])
    held = units.hashes[np.arange(int(ends[-1])) - np.repeat(ends - spans - first[which], spans)]
    own = np.repeat(np.arange(len(which)), counts[which])
    nth = np.arange(int(total[-1])) - np.repeat(total - counts[which], counts[which])
    second = window_min(mix(rolled(held, wide)), window - wide + 1)[nth + (ends - spans)[own]]
    place = nth + first[which][own]
    begin = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1]))))
    run = which[own[begin]]
    rest = np.ones(len(first), bool)
    rest[which] = False
    made = (owner[run], place[begin], np.diff(np.append(begin, len(place))), mix(least[run] ^ second[begin]))
    return tuple(np.concatenate((x[rest], y)) for x, y in zip((owner, first, counts, least), made, strict=True))


class Packer:
    """Packs slices; ``settled`` says which super-k-mers need not travel again."""

    def __init__(self, window: int, gram: int, buckets: int, settle: Callable, hot: np.ndarray):
        self.window, self.gram, self.buckets, self.settle, self.hot = window, gram, buckets, settle, hot
        self.known: dict = {}
        self.held: dict[int, list] = {}
        self.size = 0

    def pack(self, units: Units, docs: np.ndarray, keys: np.ndarray, base: int = 0) -> None:
        """base: the unit of its text that a slice of a single text begins with."""
        grams = rolled(units.hashes, self.gram)
        owner, first, counts, least = runs(units, grams, self.window, self.gram)
        if not len(first):
            return
        lone = once(grams, self.window - self.gram + 1, first, counts, least)
        if len(self.hot):
            cut = split_hot(units, self.gram, self.window, self.hot, owner, first, counts, least)
            if len(cut[1]) != len(first) or not np.array_equal(cut[3], least):  # a part of a string that holds its minimiser once does, too
                order = np.argsort(first)
                inside = order[np.searchsorted(first[order], cut[1], side="right") - 1]
                owner, first, counts, least = cut
                lone = lone[inside]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        a, z = units.places(first, first + counts + self.window - 2)
        view, digest = memoryview(np.ascontiguousarray(units.data)), xxhash.xxh3_128_intdigest
        names = [digest(view[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
        doc, key, start = docs[owner], keys[owner], first - units.bounds[owner] + base
        send, more = self.settle(self.known, names, doc, key, start, counts)
        z = np.where(send, z, a)
        # the last bit says that a string holds its minimiser once; minimisers that differ in it alone count as one
        bucket, mark = (mix(least) % np.uint64(self.buckets)).astype(np.int64), np.where(send, (least.view(np.int64) & ~1) | lone, 0)
        if more:  # places settled just now whose text went before
            extra = np.array(more, np.int64)
            bucket = np.concatenate((bucket, extra[:, 2] % self.buckets))
            doc, key, start, counts = (np.concatenate((x, extra[:, i])) for i, x in enumerate((doc, key, start, counts)))
            a, z, mark = (np.concatenate((x, np.zeros(len(extra), np.int64))) for x in (a, z, mark))
        order = np.argsort(bucket, kind="stable")
        bucket, doc, key, start, counts, a, z, mark = (x[order] for x in (bucket, doc, key, start, counts, a, z, mark))
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            data = b"".join([view[x:y] for x, y in zip(a[i:j].tolist(), z[i:j].tolist(), strict=True)])
            self.held.setdefault(int(bucket[i]), []).append((np.stack([x[i:j] for x in (doc, key, start, counts, mark)]), z[i:j] - a[i:j], data))
            self.size += len(data) + 48 * (j - i)

    def blobs(self) -> pa.RecordBatch:
        """What was packed so far, a blob for each bucket."""
        names, rows = sorted(self.held), []
        for b in names:
            held = self.held.pop(b)
            rows.append(to_blob(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]), b"".join(h[2] for h in held)))
        self.size = 0
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "blob"])


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, make_units: Callable, pieces: Callable, window: int) -> Iterator[tuple[Units, np.ndarray, np.ndarray, int]]:
    """Units, ids, keys and first unit of parts of a batch that hold some SLICE_BYTES each, whatever a text's length."""
    for part in text_slices(batch, "text", SLICE_BYTES):
        docs, keys, text = ids_of(part.column("doc")), ids_of(part.column("key")), part.column("text")
        if part.num_rows > 1 or not text[0].is_valid or text[0].as_buffer().size <= 2 * SLICE_BYTES:
            yield make_units(text), docs, keys, 0
        else:
            for units, base in pieces(memoryview(text[0].as_buffer()), window, SLICE_BYTES):
                yield units, docs, keys, base


def hot_minimisers(read: DataFrame, size: int, make_units: Callable, pieces: Callable, window: int, gram: int) -> np.ndarray:
    """Minimisers that very many different strings hold, ascending; no more than the sample has room for."""
    share = min(1.0, max(SAMPLE_BYTES / max(size, 1), SAMPLE_SHARE))
    least = max(HOT_FLOOR, HOT_BUCKETS * BUCKET_BYTES * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        for batch in batches:
            for units, _, _, _ in slices(batch, make_units, pieces, window):
                _, first, counts, minimiser = runs(units, rolled(units.hashes, gram), window, gram)
                if len(first):
                    a, z = units.places(first, first + counts + window - 2)
                    view = memoryview(np.ascontiguousarray(units.data))
                    names = np.fromiter((xxhash.xxh64_intdigest(view[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)), np.uint64, len(a))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (minimiser.view(np.int64), names.view(np.int64), z - a)], names=["least", "name", "bytes"])

    found = read.sample(share, seed=7).mapInArrow(run, "least long, name long, bytes long")
    found = found.groupBy("least", "name").agg(F.max("bytes").alias("bytes")).groupBy("least").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > least)
    return np.sort(np.array([r[0] for r in found.select("least").collect()], np.int64).view(np.uint64))


def bucketed(docs: DataFrame, make_units: Callable, pieces: Callable, settle: Callable, window: int, gram: int, id_column: str, text_column: str) -> DataFrame:
    """(bucket, blob) of all documents, dealt by bucket."""
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))
    size = read.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    hot = hot_minimisers(read, size, make_units, pieces, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        packer = Packer(window, gram, buckets, settle, hot)
        for batch in batches:
            for units, ids, keys, base in slices(batch, make_units, pieces, window):
                packer.pack(units, ids, keys, base)
                if packer.size > HELD_BYTES:
                    yield packer.blobs()
        if packer.size:
            yield packer.blobs()

    return read.mapInArrow(run, "bucket long, blob binary").repartition(max(8, math.ceil(buckets / TASK_BUCKETS)), "bucket")


def covered(blobs: DataFrame, judge: Callable[[pa.Table], tuple[np.ndarray, ...]]) -> DataFrame:
    """(doc, key, start, stop) of windows that ``judge`` finds, bucket by bucket."""

    def run(table: pa.Table) -> pa.Table:
        plain_memory()
        found = judge(from_blobs(table.column("blob").to_pylist()))
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["doc", "key", "start", "stop"])

    return blobs.groupBy("bucket").applyInArrow(run, "doc long, key long, start long, stop long")


def window_runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags that don't cross bounds: owner, first and end relative to the owner's bound."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    edge = np.zeros(len(flags) + 1, bool)
    edge[bounds] = True
    padded = np.concatenate(([False], flags, [False]))
    first = np.flatnonzero(flags & (~padded[:-2] | edge[:-1]))
    last = np.flatnonzero(flags & (~padded[2:] | edge[1:]))
    return owner[first], first - bounds[owner[first]], last + 1 - bounds[owner[first]]


def with_covered(docs: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, the text (compressed: it travels) and the sorted covered stretches of each document, as one array. A
    document's stretches are no more than its own windows; the join is by id and text, so rows of one id with other
    texts keep apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(t.as_buffer()) if t.is_valid else None for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d_key"), packed], names=["doc_id", "d_key", "packed"])

    lists = found.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("stretches"))
    lists = lists.select(F.col("doc").alias("c_doc"), F.col("key").alias("c_key"), "stretches")
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("d_key"), F.col(text_column).alias("text"))
    read = read.mapInArrow(run, "doc_id long, d_key long, packed binary")
    return read.join(lists, (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("c_doc")) & (F.col("d_key") == F.col("c_key")), "left").select("doc_id", "packed", "stretches")


def unpacked(column: pa.Array) -> pa.Array:
    """The texts again; null is empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x.as_buffer()) if x.is_valid else b"" for x in column], pa.large_binary()).cast(pa.large_string())


def merged(stretches: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted stretches, those that meet as one."""
    out: list[tuple[int, int]] = []
    for s in stretches or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out
