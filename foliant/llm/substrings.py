"""Substring dedup: windows of words that also start in a document with a smaller id, by super-k-mer partitioning.

Each bucket sorts its windows and takes the least id among equal ones. Windows are sorted by a hash of word numbers,
which are exact within the bucket, and neighbours of equal hash are compared word by word, so what a bucket finds is exact;
that a super-k-mer was sent before is told by 128 bits of its bytes.

Defined results: a null or empty text has no words and keeps none; a null id counts as 2**63 - 1; rows of
equal id never remove words of each other, and repeated rows get equal results; texts are judged whole whatever their
length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliant.llm import superkmers
from foliant.llm.common import hashed, mix, plain_memory, rolled, spaced, text_slices, word_table

WINDOW = 50
GRAM = 8
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_units(texts: pa.Array) -> superkmers.Units:
    """The words of a slice, in bytes that hold them joined by one space."""
    lists = pc.split_pattern(spaced(texts), " ")
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0
    kept = np.concatenate(([0], np.cumsum(full)))
    words = pa.concat_arrays([flat.filter(pa.array(full))])
    coded = pc.dictionary_encode(words)
    hashes = hashed(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
    starts = offsets[:-1] + np.arange(len(words))
    ends = offsets[1:] + np.arange(len(words))
    data = np.full(int(ends[-1]) if len(words) else 0, 0x20, np.uint8)
    inside = np.ones(len(data), bool)
    inside[ends[:-1]] = False
    data[inside] = np.frombuffer(words.buffers()[2], np.uint8, int(offsets[-1])) if len(words) else 0
    return superkmers.Units(kept[bounds - bounds[0]], hashes, data, starts, ends)


def word_pieces(data: memoryview, window: int, most: int) -> Iterator[tuple[superkmers.Units, int]]:
    """A long text's words, some ``most`` bytes at a time, each piece led by the last words of the one before so that
    every window stands in one piece; and which word of the text a piece begins with."""
    at, words, lead = 0, 0, b""
    while at < len(data):
        end = _SPACE.search(data, min(at + most, len(data)))
        to = end.end() if end else len(data)
        units = word_units(pa.array([lead + b" " + bytes(data[at:to])], pa.large_binary()).cast(pa.large_string()))
        n = int(units.bounds[-1])
        kept = min(window - 1, n)
        carried = lead.count(b" ") + 1 if lead else 0
        yield units, words - carried
        words += n - carried
        lead = units.data[units.starts[n - kept] :].tobytes() if kept else b""
        at = to


def settle(known: dict, names: list[int], doc: np.ndarray, key: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
    """What equals a super-k-mer sent before by a smaller id is covered, and its text needn't travel."""
    send = np.ones(len(names), bool)
    for i, (name, d) in enumerate(zip(names, doc.tolist(), strict=True)):
        least = known.get(name)
        if least is None or d < least:
            known[name] = d
        elif d > least:
            send[i] = False
    return send, []


def exact_classes(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, width: int, eights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by which equal windows are neighbours, and where each class of them begins in it. eights: the eight ids from
    each place on as one number, where ids are bytes and windows have eight at least."""
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(order) else np.empty(0, bool)
    a, b = at[order[:-1]], at[order[1:]]
    again = np.flatnonzero(~new[1:])
    equal = np.ones(len(again), bool)
    left, right, read = a[again], b[again], ids if eights is None else eights
    for k in range(width) if eights is None else (*range(0, width - 8, 8), width - 8):
        equal &= read[left + k] == read[right + k]
    if not equal.all():  # hashes collide: sort those windows by their words
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        for g in np.unique(group[again[~equal] + 1]).tolist():
            lo, hi = begins[g], begins[g + 1] if g + 1 < len(begins) else len(order)
            own = sorted(order[lo:hi].tolist(), key=lambda w: tuple(ids[at[w] : at[w] + width].tolist()))
            order[lo:hi] = own
            rows = [tuple(ids[at[w] : at[w] + width].tolist()) for w in own]
            new[lo + 1 : hi] = [x != y for x, y in zip(rows[:-1], rows[1:], strict=True)]
    return order, np.flatnonzero(new)


def spread(runs: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each string's runs, for each of the rows that hold the string: row, first, end."""
    string, first, end = runs
    order = rows[np.argsort(code[rows], kind="stable")]
    lows = np.searchsorted(code[order], np.arange(n + 1))
    each = lows[string + 1] - lows[string]
    total = np.cumsum(each)
    within = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - each, each)
    return order[np.repeat(lows[string], each) + within], np.repeat(first, each), np.repeat(end, each)


def judge(window: int):
    def judged(table: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        doc, key, start, count = (table.column(c).to_numpy() for c in ("doc", "key", "start", "windows"))
        text = table.column("text")
        sent = pc.binary_length(text).to_numpy() > 0
        rows = np.flatnonzero(sent)
        coded = pc.dictionary_encode(text.filter(pa.array(sent)))
        code = np.full(len(doc), -1, np.int64)
        code[rows] = coded.indices.to_numpy()
        n = len(coded.dictionary)
        least = np.full(n, superkmers.NO_ID)
        np.minimum.at(least, code[rows], doc[rows])
        whole = ~sent
        whole[rows] = doc[rows] > least[code[rows]]
        bounds, ids, _ = word_table(coded.dictionary.cast(pa.large_string()), (0x20,))
        sizes = np.diff(bounds) - window + 1
        limits = np.concatenate(([0], np.cumsum(sizes)))
        owner = np.repeat(np.arange(n), sizes)
        at = np.arange(limits[-1]) - limits[owner] + bounds[owner]
        hashes = rolled(mix(ids.astype(np.uint64) + np.uint64(1)), window)[at] if len(at) else np.empty(0, np.uint64)
        order, begins = exact_classes(hashes, ids, at, window)
        flags = np.zeros(len(at), bool)
        if len(at):
            own = least[owner]
            first = np.minimum.reduceat(own[order], begins)
            flags[order] = own[order] > np.repeat(first, np.diff(np.append(begins, len(order))))
        row, a, b = spread(superkmers.window_runs(flags, limits), code, rows[~whole[rows]], n)
        every = np.flatnonzero(whole)
        take = np.concatenate((every, row))
        a = np.concatenate((start[every], start[row] + a))
        b = np.concatenate((start[every] + count[every], start[row] + b))
        return doc[take], key[take], a, b + window - 1

    return judged


def repeated_stretches(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, key, start, stop): stretches of words to remove; start and stop count words, stop is exclusive."""
    blobs = superkmers.bucketed(docs, word_units, word_pieces, settle, window, min(GRAM, window), id_column, text_column)
    return superkmers.covered(blobs, judge(window))


def cut(texts: pa.Array, stretches: list, most: int = superkmers.SLICE_BYTES) -> Iterator[tuple[int, int, bytes]]:
    """Words, words removed, and the kept words joined by one space. A long text is gone through in pieces."""
    if len(texts) == 1 and texts[0].as_buffer().size > 2 * most:
        yield cut_text(word_pieces(memoryview(texts[0].as_buffer()), 1, most), superkmers.merged(stretches[0]))
        return
    units = word_units(texts)
    for a, z, own in zip(units.bounds[:-1].tolist(), units.bounds[1:].tolist(), stretches, strict=True):
        yield cut_text([(superkmers.Units(np.array([0, z - a]), units.hashes, units.data, units.starts[a:z], units.ends[a:z]), 0)], superkmers.merged(own))


def cut_text(pieces, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """cut() of one text: pieces are units and the word that each begins with, spans are sorted and apart."""
    words, gone, parts, next_span = 0, 0, [], 0
    for units, base in pieces:
        n, at, view = int(units.bounds[-1]), 0, memoryview(units.data)
        while next_span < len(spans) and spans[next_span][0] < base + n:
            a, z = max(spans[next_span][0] - base, 0), min(spans[next_span][1] - base, n)
            if a > at:
                parts.append(bytes(view[units.starts[at] : units.ends[a - 1]]))
            at, gone = z, gone + z - a
            if spans[next_span][1] > base + n:
                break
            next_span += 1
        if n > at:
            parts.append(bytes(view[units.starts[at] : units.ends[n - 1]]))
        words += n
    return words, gone, b" ".join(parts)


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    joined = superkmers.with_covered(docs, repeated_stretches(docs, window, id_column, text_column), id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        for whole in batches:
            for part in text_slices(whole, "packed", 1 << 20):
                made = list(cut(superkmers.unpacked(part.column("packed")), part.column("stretches").to_pylist()))
                columns = [part.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns, names = [*columns, pa.array([m[2].decode() for m in made], pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
