"""Byte-pair merges of many short strings at once, by array operations, and the cutting of texts into such strings.

This stands in for the tokenizer where its own definition fixes the ids of a string by itself: runs of plain letters (a-z,
and the lower-case letters of U+00E0 to U+00FF), single digits and runs of ASCII punctuation. All else, and every tokenizer
of another kind, goes to the tokenizer.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from foliant.llm.common import plain_strings

#: The normalizer and pre-tokenizer that the cutting is made for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
END = "</w>"
#: No pair of this rank exists.
NONE = np.iinfo(np.int32).max
#: Longer strings go to the tokenizer, so a block has few rounds.
LONGEST = 64
#: Strings merged at once; what a round works on stays in the processor's cache.
BLOCK = 16_384

#: Classes of bytes.
SPACE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0x27] = APOSTROPHE
#: Second bytes, after 0xC3, of the lower-case letters of U+00E0 to U+00FF; U+00F7 is a sign.
LATIN = np.zeros(256, bool)
LATIN[0xA0:0xC0] = True
LATIN[0xB7] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _starts() -> np.ndarray:
    """By 8 * class of a byte + class of the next: whether a string starts at the next one.

    Between plain characters the tokenizer's pattern always ends a match after a letter before a non-letter, on both
    sides of a digit, and between punctuation and a letter but for an apostrophe, which may start a contraction. No ASCII
    character and none of the letters above composes with one before it, so NFC doesn't reach over these borders."""
    out = np.zeros((8, 8), bool)
    out[SPACE, LETTER:] = True
    out[LETTER, [DIGIT, MARK, APOSTROPHE]] = True
    out[DIGIT, LETTER:OTHER] = True
    out[[MARK, APOSTROPHE], DIGIT] = True
    out[MARK, LETTER] = True
    return out.ravel()


STARTS = _starts()
#: Likewise, whether the string that holds the next byte goes to the tokenizer.
HARD = np.zeros((8, 8), np.uint8)
HARD[:, OTHER] = HARD[APOSTROPHE, LETTER] = 1
HARD = HARD.ravel()


def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Strings of each text: bounds of each text's strings, each string's id, the distinct strings (bytes) by id, and
    which of these go to the tokenizer. A-Z is in lower case in the others."""
    column = plain_strings(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(column) + 1]
    if not at[-1]:
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.int32), pa.array([], pa.large_binary()), np.empty(0, bool)
    data = np.frombuffer(data, np.uint8)[: at[-1]]
    kinds = CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[LATIN[data[lead + 1]]]
    kinds[lead] = kinds[lead + 1] = LETTER
    pairs = np.empty(len(data), np.uint8)
    pairs[0] = kinds[0]
    pairs[1:] = (kinds[:-1] << 3) + kinds[1:]
    firsts = at[:-1][at[:-1] < len(data)]
    pairs[firsts] = kinds[firsts]  # a text starts as after a space
    starts = STARTS[pairs]
    bounds = np.searchsorted(np.flatnonzero(starts), at)
    full = kinds != SPACE
    begins = np.flatnonzero(starts[full])
    ends = np.append(begins, np.count_nonzero(full))
    if not len(begins):
        return bounds, np.empty(0, np.int32), pa.array([], pa.large_binary()), np.empty(0, bool)
    sizes = np.diff(ends)
    hard = np.maximum.reduceat(HARD[pairs][full], begins).astype(bool) | (sizes > LONGEST)
    packed = data[full]
    lowered = LOWER[packed]
    if hard.any():  # in lower case, a letter may compose with a mark that its capital doesn't compose with
        own = np.repeat(hard, sizes)
        lowered[own] = packed[own]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(lowered)]).dictionary_encode()
    ids = coded.indices.to_numpy()
    apart = np.zeros(len(coded.dictionary), bool)
    apart[ids[hard]] = True
    return bounds, ids, coded.dictionary, apart


class Merges:
    """The merges of a tokenizer's file, by rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        codes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        names = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in codes)}
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + END] for b in range(256)], np.int32)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # a table with open places, looked up from a key's own place on
        self.bits = int(4 * len(keys)).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, places = np.arange(len(keys)), self._places(keys)
        while len(left):
            free = left[self.keys[places[left]] < 0]
            self.keys[places[free]], self.ranks[places[free]] = keys[free], free  # of equal places the last one stands in both
            left = left[self.keys[places[left]] != keys[left]]
            places[left] = (places[left] + 1) & ((1 << self.bits) - 1)
        few = np.concatenate((self.inner, self.last))
        self.code = np.zeros(self.width, np.int32)
        self.code[few] = np.arange(512)
        self.first = self.rank(np.repeat(self.inner, 512), np.tile(few, 256))

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.width + b
        places = self._places(keys)
        found = self.keys[places]
        out = self.ranks[places]
        out[found != keys] = NONE
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            places[left] = (places[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[places[left]]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[places[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each string (bytes, none empty), and all ids."""
        if not len(strings):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        _, offsets, data = strings.buffers()
        ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(data, np.uint8)
        parts = [self._block(data[ends[i] : ends[min(i + BLOCK, len(strings))]], ends[i : i + BLOCK + 1] - ends[i]) for i in range(0, len(strings), BLOCK)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges, in each string that has a pair left, the first pair of the least rank."""
        whole = self.inner[data]
        whole[ends[1:] - 1] = self.last[data[ends[1:] - 1]]
        kept = np.ones(len(data), bool)
        begins, sizes = ends[:-1], np.diff(ends)
        place, ids = np.arange(len(data)), np.append(whole, 0)
        ranks = np.full(len(data), NONE, np.int32)
        inside = np.ones(len(data), bool)
        inside[ends[1:] - 1] = False  # no pair starts with a string's last id
        at = np.flatnonzero(inside)
        ranks[at] = self.first[data[at].astype(np.int64) * 512 + self.code[whole[at + 1]]]
        ids = ids[:-1]
        while True:
            least = np.minimum.reduceat(ranks, begins)
            live = least != NONE
            if not live.all():
                if not live.any():
                    break
                stays = np.repeat(live, sizes)
                place, ids, ranks = place[stays], ids[stays], ranks[stays]
                sizes, least = sizes[live], least[live]
                begins = np.cumsum(sizes) - sizes
            equal = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = equal[np.searchsorted(equal, begins)]
            ids[at] = whole[place[at]] = self.made[least]
            kept[place[at + 1]] = False
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            place, ids, ranks = place[stays], ids[stays], ranks[stays]
            at = at - np.arange(len(at))
            sizes = sizes - 1
            begins = np.cumsum(sizes) - sizes
            inner = at != begins + sizes - 1
            ranks[at] = NONE
            ranks[at[inner]] = self.rank(ids[at[inner]], ids[at[inner] + 1])
            before = at[at != begins]
            ranks[before - 1] = self.rank(ids[before - 1], ids[before])
        return np.add.reduceat(kept, ends[:-1], dtype=np.int64), whole[kept].astype(np.uint32)


def merges_of(spec: str) -> Merges | None:
    """The merges of a tokenizer's JSON, or none where it is of another kind than this module is made for."""
    given = json.loads(spec)
    model = given["model"]
    if given["normalizer"] != NORMALIZER or given["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} or given.get("truncation"):
        return None
    if any(not t["content"].startswith("<|") or t["normalized"] for t in given["added_tokens"]):
        return None  # texts with <| go to the tokenizer
    plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}
    if any((model.get(k) or None) != (v or None) for k, v in plain.items()):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made: dict[str, int] = {}
    for i, (a, b) in enumerate(pairs):  # a pair's parts are made before it, by one merge each
        if a.endswith(END) or a + b in made or any(len(x.removesuffix(END)) > 1 and x not in made for x in (a, b)):
            return None
        made[a + b] = i
    return Merges(model["vocab"], pairs)


__all__ = ["Merges", "cut", "merges_of"]
