"""Helpers shared by the corpus operators: shared storage, bounded Arrow slices, word tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that a Python step works on at once.
SLICE_BYTES = 8 << 20

#: Fixed value: the bytes that separate words (space, \t \n \v \f \r).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none and runs on one machine (tests), a temporary one is set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foliant-shared-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of bounded size between Spark and Python, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most))


def plain_memory() -> None:
    """Memory that goes back to the system: Arrow's from malloc, and, where this is glibc, blocks of half a megabyte from
    the system itself (else the limit rises with use and freed blocks stay), and what is free at the heap's end returned."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 512 << 10)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 512 << 10)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes, as measured, that a join sends to every executor.
BROADCAST_BYTES = 16 << 20


def sent_if_small(df: DataFrame, row_bytes: Column | int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, best a written table, to be broadcast where its rows measure at most ``most`` bytes; else joined by shuffle."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).cast("long")).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes in a column, or one row."""
    at, n = 0, batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def plain_strings(column: pa.Array) -> pa.Array:
    """A string array without nulls and without an offset into its buffers."""
    return pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])


def spaced(column: pa.Array, separators: tuple[int, ...] = SEPARATORS, lower: bool = False) -> pa.Array:
    """plain_strings() in which each separator byte is a space, and A-Z in lower case if asked for."""
    column = plain_strings(column)
    _, offsets, data = column.buffers()
    if data is None or not data.size:
        return column
    table = np.arange(256, dtype=np.uint8)
    table[list(separators)] = 0x20
    if lower:
        table[0x41:0x5B] += 0x20
    return pa.LargeStringArray.from_buffers(len(column), offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)]))


def word_table(column: pa.Array, separators: tuple[int, ...] = SEPARATORS, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: bounds of each text's words, each word's id, the distinct words by id."""
    lists = pc.split_pattern(spaced(column, separators, lower), " ")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0
    kept = np.concatenate(([0], np.cumsum(full)))
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return kept[bounds - bounds[0]], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hashed(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """A polynomial 64-bit hash of every run of k values."""
    if len(values) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(values) - k + 1, np.uint64)
    at, width, power = 0, 1, values.astype(np.uint64)
    left = k
    while left:  # by doubling: hashes of 1, 2, 4 ... values, put together as k's bits say
        if left & 1:
            out = out * np.uint64(pow(BASE, width, 1 << 64)) + power[at : at + len(out)]
            at += width
        left >>= 1
        if left:
            power = power[: len(power) - width] * np.uint64(pow(BASE, width, 1 << 64)) + power[width:]
            width *= 2
    return mix(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every run of w values."""
    width = 1
    while 2 * width <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = w - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def words_column(text: Column, separators: str = r"[\x20\x09-\x0D]+") -> Column:
    """Words of a text as an array, by built-in functions; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _ladder(df: DataFrame, values: str, out: str, width: int, join: Callable[[Column, Column], Column], overlap: bool) -> DataFrame:
    """df with what join makes of every ``width`` neighbours in an array column, from results for 1, 2, 4 ... neighbours.

    Each level is one pass and a column of its own: get() and zip_with() step over arrays in constant time, while
    slice() copies its whole array and so stands outside of lambdas."""

    def beside(a: str, b: str, by: int) -> Column:
        return F.zip_with(F.col(a), F.slice(b, by + 1, F.size(b)), join)

    powers = [values]
    while 2 << (len(powers) - 1) <= width:
        powers.append(f"__{out}{len(powers)}")
        df = df.withColumn(powers[-1], beside(powers[-2], powers[-2], 1 << (len(powers) - 2)))
    top, last, extra = 1 << (len(powers) - 1), powers[-1], powers[1:]
    if overlap and top < width:
        df, last = df.withColumn(f"__{out}", beside(last, last, width - top)), f"__{out}"
    elif top < width:
        at = top
        for i in range(len(powers) - 2, -1, -1):
            if (width - top) >> i & 1:
                df, last, at = df.withColumn(f"__{out}_{i}", beside(last, powers[i], at)), f"__{out}_{i}", at + (1 << i)
                extra.append(last)
    trimmed = F.slice(last, 1, F.greatest(F.size(values) - width + 1, F.lit(0)))
    return df.withColumn(out, trimmed).drop(*extra, f"__{out}")


def with_run_hashes(df: DataFrame, hashes: str, out: str, width: int) -> DataFrame:
    """df with a 64-bit hash of every ``width`` neighbours of an array of hashes, by built-in functions."""
    return _ladder(df, hashes, out, width, lambda a, b: F.xxhash64(a, b), False)


def with_run_minima(df: DataFrame, values: str, out: str, width: int) -> DataFrame:
    """df with the least of every ``width`` neighbours of an array, by built-in functions."""
    return _ladder(df, values, out, width, lambda a, b: F.least(a, b), True)


def with_fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once. A filter on a plain column is pushed below what computes it, whose
    expression then stands in the filter too; here a generator of one row lies between, which filters don't pass."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))
