"""Best-fit packing by sums of squares.

Documents become token ids and are packed into sequences of a fixed capacity. A piece goes where the sum, over all
gaps, of the squared number of open sequences with that gap becomes smallest (a new sequence is one of the choices).
Pieces are dealt into shards of a bounded number of rows, each shard packs its own from the longest to the shortest,
and what shards leave underfull is packed once more, a whole sequence then being one item.

Defined results: a null or empty text is one piece that holds only the end id; a null id is carried as it is; repeated
rows are packed each; texts of any length are cut only where they pass the capacity; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.bpe import cut, merges_of
from foliant.llm.common import bounded_batches, plain_memory, staged, text_slices, word_table

CAPACITY = 4096
END_ID = 1
SHARD_ROWS = 50_000
SLICE_BYTES = 8 << 20
#: Words of one generation that a task remembers.
REMEMBERED = 500_000
WORDS_AT_ONCE = 2000
#: Words whose ids are copied to their places at once.
WORDS_PLACED = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space in the tokenizer's own sense; splitting there never changes ids.
CUTS = (0x20, 0x09, 0x0A, 0x0D)


class WordTokenizer:
    """Ids of whole texts, each distinct word of a slice being looked up or encoded once.

    Where the tokenizer is of the kind that ``bpe`` knows, plain strings are merged there by array operations. Other words
    go to the tokenizer and are remembered in two generations: where the newer one is full it becomes the older, whose words
    are forgotten unless they were met again. Ids are kept as bytes, which is compact."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.merges = merges_of(spec)
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> None:
        """Remembers the words' ids. The tokenizer's bulky results live for some words at a time."""
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) * 4
            data = np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1]) // 4).tobytes()
            self.newer.update(zip(some, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def distinct_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        if len(self.newer) > REMEMBERED:
            self.older, self.newer = self.newer, {}
        newer, older = self.newer, self.older
        missing = []
        for w in words:
            if w not in newer:
                if (ids := older.get(w)) is None:
                    missing.append(w)
                else:
                    newer[w] = ids
        self.encode(missing)
        found = [newer[w] for w in words]
        return np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), np.uint32)

    def coded(self, texts: pa.Array, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each text's words, each word's number, the number of ids by word, and all words' ids."""
        if special or self.merges is None:
            bounds, words, distinct = word_table(texts, CUTS)
            return bounds, words, *self.distinct_ids(distinct.to_pylist())
        bounds, words, distinct, apart = cut(texts)
        plain, ids = self.merges.ids(distinct.filter(pa.array(~apart)))
        hard, more = self.distinct_ids(distinct.filter(pa.array(apart)).cast(pa.large_string()).to_pylist())
        # plain words come first
        number = np.empty(len(apart), np.int32)
        number[~apart], number[apart] = np.arange(len(plain)), np.arange(len(plain), len(apart))
        return bounds, number[words], np.concatenate((plain, hard)), np.concatenate((ids, more))

    def ids(self, texts: pa.Array, end_id: int, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and the ids of all texts, ``end_id`` behind each. special: texts may hold <|, with
        which the names of added tokens start."""
        bounds, words, sizes, flat = self.coded(texts, special)
        words = np.insert(words, bounds[1:], len(sizes))
        sizes, flat = np.append(sizes, 1), np.append(flat, np.uint32(end_id))
        starts, each = np.cumsum(sizes) - sizes, sizes[words]
        ends = np.concatenate(([0], np.cumsum(each)))
        out = np.empty(ends[-1], "<u4")
        for i in range(0, len(words), WORDS_PLACED):
            j = min(i + WORDS_PLACED, len(words))
            at = np.repeat(starts[words[i:j]] - ends[i:j], each[i:j]) + np.arange(ends[i], ends[j])
            out[ends[i] : ends[j]] = flat[at]
        return ends[bounds + np.arange(len(bounds))], out


@lru_cache(maxsize=1)
def _encoder(spec: str) -> WordTokenizer:
    """One for all tasks that a Python worker runs."""
    return WordTokenizer(spec)


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids, one row each; only longer documents are cut. tokenizer: a file's path."""
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        encoder = _encoder(spec.value)
        for whole in batches:
            special = pc.fill_null(pc.match_substring(whole.column("text"), "<|"), False)
            slices = chain.from_iterable(zip(text_slices(whole.filter(m), "text", SLICE_BYTES), repeat(k)) for k, m in ((False, pc.invert(special)), (True, special)))
            for part, named in slices:
                starts, out = encoder.ids(part.column("text"), end_id, named)
                data, rows = memoryview(out).cast("B"), []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    for k, s in enumerate(range(a, b, capacity)):
                        e = min(b, s + capacity)
                        rows.append((doc, k, s - a, e - s, zlib.crc32(data[4 * s : 4 * e])) + ((out[s:e].tolist(),) if keep_ids else ()))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES + (", ids array<long>" if keep_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and offset in it, and each bin's gap; items are placed from the longest to the shortest."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones don't count
    standing: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        open_gaps = s + np.flatnonzero(count[s:])
        # what the sum gains when gap g turns to g - s; the last choice is a new bin
        gains = 2 * (count[open_gaps - s] - count[open_gaps]) + 2
        if len(open_gaps) and open_gaps[0] == s:
            gains[0] = 1 - 2 * count[s]
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(np.argmin(gains)) if len(gains) else -1
        if best >= 0 and gains[best] <= new:
            g = int(open_gaps[best])
            b = standing[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - g
        gaps[b] = g - s
        if g > s:
            count[g - s] += 1
            standing[g - s].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def _packed(capacity: int, level: int, schema: list[str]):
    """A mapInPandas function: each partition packs its own units (whole sequences of the level before, or pieces)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if not own:
            return
        rows = pd.concat(own, ignore_index=True)
        bins, offsets, gaps = sum_of_squares(rows["filled"].to_numpy(), capacity)
        rows["offset"] = offsets
        rows["old_id"] = rows["sequence_id"]
        rows["sequence_id"] = (level << 60) | (TaskContext.get().partitionId() << 32) | bins
        rows["gap"] = gaps[bins]
        yield rows[schema]

    return run


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. A shard holds about ``shard_rows`` rows, so a task's memory is bounded; the
    sequences with a gap of over 1/64 of the capacity are then units of a second round in ever fewer shards."""
    pieces = staged(pieces, "pieces")
    columns = pieces.columns
    n = pieces.count()
    unit = pieces.select(*columns, F.col("length").alias("filled"), F.lit(0).cast("long").alias("sequence_id"))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long, gap long"
    first = unit.repartition(max(1, -(-n // shard_rows))).mapInPandas(_packed(capacity, 0, [*columns, "sequence_id", "offset", "gap"]), schema)
    first = staged(first, "packed")
    final = first.filter(F.col("gap") <= capacity // 64)
    rest = first.filter(F.col("gap") > capacity // 64)
    units = rest.groupBy("sequence_id").agg((F.lit(capacity) - F.first("gap")).alias("filled"))
    shards = max(1, -(-units.count() // shard_rows))
    moved = units.repartition(shards).mapInPandas(_packed(capacity, 1, ["old_id", "sequence_id", "offset"]), "old_id long, sequence_id long, offset long")
    moved = staged(moved, "moved").select("old_id", F.col("sequence_id").alias("new_id"), F.col("offset").alias("shift"))
    again = rest.join(moved, F.col("sequence_id") == F.col("old_id")).select(*columns, F.col("new_id").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return final.select(*columns, "sequence_id", "offset").unionByName(again)


def assembled(packed: DataFrame) -> DataFrame:
    """The sequences themselves: one row each with its ids, from pieces made with keep_ids=True."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the share of their room that tokens fill."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens")).withColumn("filled", F.col("tokens") / (F.col("sequences") * capacity))


__all__ = ["assembled", "fill_report", "pack_sequences", "sum_of_squares", "tokenised_pieces"]
