"""Suffix-array dedup: bytes covered by a 200-byte string that also starts anywhere else.

Strings meet in buckets as super-k-mers. A bucket keeps those that may share a window (another string has the same
minimiser), parses them prefix-free (a phrase runs from one trigger, an 8-byte gram whose hash is 0 modulo STEP, through
the next one), and sorts the suffixes of the parse by linear grouping:

* Phase 1 processes groups of suffixes with one Lyndon prefix in descending order. Each member's pointer goes to the
  nearest suffix before it of a smaller group; pointed-to suffixes move to groups of their own right above their rest,
  those that more members point to above those that fewer do.
* Phase 2 goes through the order as it emerges and puts the suffix before each one, and those along its pointers, at
  the front of what is left of their groups. Nothing is renamed or sorted again.

Phrases are prefix-free, so the parse's order is the byte order of suffixes that start at triggers, and those that share
any number of bytes stand together. A window of 200 bytes starts x bytes before its first trigger; it occurs again where
two suffixes share 200 - x bytes to the right and x bytes to the left. Windows without a trigger are sorted by a hash,
neighbours being compared byte by byte. A bucket's strings are judged some JUDGED_BYTES at a time, those of one
minimiser together.

Defined results: a null or empty text has no bytes; matches never cross documents; a null id is carried, rows that repeat
(id and text) are each a document and so repeat each other; texts of any length are judged whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from foliant.llm import superkmers
from foliant.llm.common import plain_memory, plain_strings, rolled, text_slices
from foliant.llm.substrings import exact_classes, spread

WINDOW = 200
JUDGED_BYTES = 2 << 20
GRAM = 24
TRIGGER = 8
STEP = 48


def sorted_suffixes(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of a string over integers, in ascending order; the end counts as the smallest symbol."""
    n = len(symbols) + 1
    values = np.empty(n, np.int64)
    values[:-1], values[-1] = symbols, np.iinfo(np.int64).min
    first = np.argsort(values, kind="stable")
    ranked = values[first]
    begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(begins, n))
    group = np.empty(n, np.int64)
    group[first] = np.repeat(begins, sizes)
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    order, group, place = first.tolist(), group.tolist(), place.tolist()
    size = [0] * n
    for b, k in zip(begins.tolist(), sizes.tolist(), strict=True):
        size[b] = k
    pointer = [-1] * n

    end = n
    while end > 0:
        begin = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[begin:end]):
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[k]:
                g = group[p]
                m = moved.get(g, 0)
                at, last = place[p], g + size[g] - 1 - m
                other = order[last]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
                moved[g] = m + 1
            for g, m in moved.items():
                if m < size[g]:
                    size[g] -= m
                    above = g + size[g]
                    size[above] = m
                    for j in range(above, above + m):
                        group[order[j]] = above
        end = begin

    out, front, put = [-1] * n, list(range(n)), bytearray(n)
    out[0], put[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            put[j] = 1
            j = pointer[j]
    return out[1:]


def dense(keys: np.ndarray) -> np.ndarray:
    """Each key's rank among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1]


def phrase_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of byte strings in byte order."""
    raw = data.tobytes()
    column = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.large_binary())
    coded = pc.dictionary_encode(column)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks[coded.indices.to_numpy()]


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, part: int = 4096) -> np.ndarray:
    """Bytes that data[a:] and data[b:] share, at most ``most``; data ends with as many bytes to spare."""
    out = np.empty(len(a), np.int64)
    width = int(most.max()) if len(most) else 0
    steps = np.arange(width)
    for i in range(0, len(a), part):
        j = slice(i, i + part)
        differ = data[a[j, None] + steps] != data[b[j, None] + steps]
        out[j] = np.where(differ.any(1), differ.argmax(1), width)
    return np.minimum(out, most)


def repeated_windows(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray, window: int, step: int = STEP) -> np.ndarray:
    """For strings in data (string k is data[bounds[k]:bounds[k+1]]): whether the window that starts at each byte also
    starts elsewhere. A string's weight is the number of times that it occurs."""
    n = int(bounds[-1])
    repeated = np.zeros(n, bool)
    spare = np.concatenate((data, np.zeros(window, np.uint8)))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stop = bounds[owner + 1]
    room = np.arange(n) + window <= stop  # a window fits
    grams = rolled(data.astype(np.uint64), TRIGGER)
    trigger = np.zeros(n, bool)
    trigger[: len(grams)] = grams % np.uint64(step) == 0
    trigger &= np.arange(n) + TRIGGER <= stop
    at = np.flatnonzero(trigger)
    # the first trigger at or after each byte, in its own string
    after = np.searchsorted(at, np.arange(n))
    first = np.append(at, n)[after]
    left = first - np.arange(n)
    anchored = room & (first < stop) & (left + TRIGGER <= window)

    bare = np.flatnonzero(room & ~anchored)
    if len(bare):
        view = memoryview(spare)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + window]) for i in bare.tolist()), np.uint64, len(bare))
        eights = np.ndarray((len(spare) - 7,), "<u8", spare, strides=(1,)) if window >= 8 else None
        order, begins = exact_classes(hashes, spare, bare, window, eights)
        total = np.add.reduceat(weights[owner[bare[order]]], begins)
        repeated[bare[order]] = np.repeat(total, np.diff(np.append(begins, len(order)))) > 1
    if not len(at):
        return repeated

    own = owner[at]
    last = np.append(own[1:] != own[:-1], True)
    cut = np.where(last, bounds[own + 1], np.append(at[1:], 0) + TRIGGER)
    ranks = phrase_ranks(data, at, cut)
    strings = len(bounds) - 1
    symbols = np.insert(ranks + strings, np.flatnonzero(last) + 1, own[last])  # each string ends with a symbol of its own
    back = np.insert(np.arange(len(at)), np.flatnonzero(last) + 1, -1)
    order = back[np.array(sorted_suffixes(symbols.tolist()))]
    order = order[order >= 0]
    at, own = at[order], own[order]
    most = np.minimum(bounds[own + 1] - at, window)
    shared = np.zeros(len(at), np.int64)
    shared[1:] = common_prefixes(spare, at[:-1], at[1:], np.minimum(most[:-1], most[1:]))

    # x bytes before the trigger, no other trigger between: x runs while such windows are left
    gap = np.minimum(at - bounds[own], window - TRIGGER)
    mine = np.sort(at)
    before = np.searchsorted(mine, at) - 1
    near = np.where(before >= 0, at - mine[np.maximum(before, 0)] - 1, gap)
    gap = np.minimum(gap, np.where((before >= 0) & (owner[mine[np.maximum(before, 0)]] == own), near, gap))
    alive, lefts = np.arange(len(at)), np.zeros(len(at), np.int64)
    weight = weights[own]
    for x in range(window - TRIGGER + 1):
        if x:
            go = gap[alive] >= x
            alive = alive[go]
            lefts = dense(lefts[go] * 256 + data[at[alive] - x])
        if not len(alive):
            break
        depth = window - x
        fits = np.flatnonzero(most[alive] >= depth)
        if not len(fits):
            continue
        rows = alive[fits]
        together = np.cumsum(shared < depth)[rows]
        names = dense(together * (int(lefts.max()) + 1) + lefts[fits])
        repeated[at[rows] - x] = np.bincount(names, weight[rows])[names] > 1
    return repeated


def byte_units(texts: pa.Array) -> superkmers.Units:
    column = plain_strings(texts)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8, int(bounds[-1])) if data is not None and data.size else np.empty(0, np.uint8)
    return superkmers.Units(bounds, flat.astype(np.uint64), flat)


def byte_pieces(data: memoryview, window: int, most: int) -> Iterator[tuple[superkmers.Units, int]]:
    """A long text's bytes, ``most`` windows at a time, and which byte a piece begins with."""
    for at in range(0, max(1, len(data) - window + 1), most):
        flat = np.frombuffer(data[at : at + most + window - 1], np.uint8)
        yield superkmers.Units(np.array([0, len(flat)]), flat.astype(np.uint64), flat), at


def settle(known: dict, names: list[int], doc: np.ndarray, key: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
    """What equals a super-k-mer sent before is covered, and so is that one."""
    send, more = np.ones(len(names), bool), []
    for i, name in enumerate(names):
        before = known.get(name)
        if before is None:
            known[name] = (int(doc[i]), int(key[i]), int(start[i]), int(counts[i]))
        else:
            send[i] = False
            if before is not True:
                more.append(before)
                known[name] = True
    return send, more


def batches_of(names: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strings, sorted by name, that hold some JUDGED_BYTES; those of one name are in one range."""
    begins = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
    at = 0
    for b in [*begins[1:].tolist(), len(names)]:
        if b > at and (b == len(names) or bounds[b] - bounds[at] >= JUDGED_BYTES):
            yield at, b
            at = b


def judge(window: int):
    def judged(table: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        doc, key, start, count, mark = (table.column(c).to_numpy() for c in ("doc", "key", "start", "windows", "mark"))
        text = table.column("text")
        sent = pc.binary_length(text).to_numpy() > 0
        rows = np.flatnonzero(sent)
        coded = pc.dictionary_encode(text.filter(pa.array(sent)))
        code = np.full(len(doc), -1, np.int64)
        code[rows] = coded.indices.to_numpy()
        n = len(coded.dictionary)
        weights = np.bincount(code[rows], minlength=n)
        marks = np.zeros(n, np.int64)
        marks[code[rows]] = mark[rows]
        whole = ~sent  # settled: equal to a string that was sent
        # strings that occur again, share a minimiser with another one, or hold theirs twice, may hold a window twice
        names = dense(marks >> 1)
        tied = (np.bincount(names)[names] > 1) | (marks & 1 == 0) | (weights > 1) if n else np.empty(0, bool)
        some = np.flatnonzero(tied)
        some = some[np.argsort(names[some], kind="stable")]
        strings = pa.concat_arrays([coded.dictionary.take(pa.array(some))])
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(strings).to_numpy()))).astype(np.int64)
        data = np.frombuffer(strings.buffers()[2], np.uint8, int(bounds[-1])) if bounds[-1] else np.empty(0, np.uint8)
        flags = np.zeros(len(data), bool)
        for i, j in batches_of(names[some], bounds):
            flags[bounds[i] : bounds[j]] = repeated_windows(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], weights[some[i:j]], window)
        number = np.full(n, -1, np.int64)
        number[some] = np.arange(len(some))
        here = rows[number[code[rows]] >= 0]
        codes = np.full(len(doc), -1, np.int64)
        codes[here] = number[code[here]]
        row, a, b = spread(superkmers.window_runs(flags, bounds), codes, here, len(some))
        every = np.flatnonzero(whole)
        take = np.concatenate((every, row))
        a = np.concatenate((start[every], start[row] + a))
        b = np.concatenate((start[every] + count[every], start[row] + b))
        return doc[take], key[take], a, b + window - 1

    return judged


def repeated_stretches(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, key, start, stop): stretches of bytes to remove, stop exclusive."""
    blobs = superkmers.bucketed(docs, byte_units, byte_pieces, settle, window, min(GRAM, window), id_column, text_column)
    return superkmers.covered(blobs, judge(window))


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_bytes: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    joined = superkmers.with_covered(docs, repeated_stretches(docs, window, id_column, text_column), id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        for whole in batches:
            for part in text_slices(whole, "packed", 1 << 20):
                made = []
                for text, own in zip(superkmers.unpacked(part.column("packed")), part.column("stretches").to_pylist(), strict=True):
                    view = memoryview(text.as_buffer())
                    spans, parts, at = superkmers.merged(own), [], 0
                    for s, e in spans:
                        parts.append(view[at:s])
                        at = e
                    left = b"".join([*parts, view[at:]])
                    made.append((len(view), len(view) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string()) + (pa.binary(),) * keep_bytes
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds))], names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


