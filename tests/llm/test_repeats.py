"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from foliant.llm import substrings, suffixes, superkmers

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(docs, window):
    """docs: (id, text); windows seen with their least id, null being the largest."""
    least = {}
    number = lambda d: float("inf") if d is None else d
    words = [WS.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(number(d), least.get(k, float("inf")))
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < number(d):
                gone |= set(range(i, i + window))
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def brute_bytes(docs, window):
    count, texts = Counter(), [(d, (t or "").encode()) for d, t in docs]
    for _, b in texts:
        count.update(b[i : i + window] for i in range(len(b) - window + 1))
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        yield d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if not gone[i])).hexdigest()


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def check(got, wanted):
    got, wanted = sorted(map(tuple, got), key=key), sorted(wanted, key=key)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert a == b


def awkward():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, longer = say(70), say(300)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 4000), (5, "a " * 4000), (6, "ab" * 3000), (7, "ab" * 3000 + "c")]
    out += [(10 + i, say(rng.randint(0, 60)) + " " + passage.replace(" ", rng.choice([" ", "\n", "  "])) + " " + say(rng.randint(0, 60))) for i in range(30)]
    out += [(60 + i, longer) for i in range(12)] + [(60, longer), (None, longer), (None, "x " + longer)]
    out += [(100 + i, " ".join(w if rng.random() > 0.02 else "edit" for w in longer.split(" "))) for i in range(40)]
    out += [(200, say(30) + " " + passage + " " + say(5) + " " + passage), (201, passage + passage), (202, say(49)), (203, say(50))]
    return out


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, start string").repartition(parts)


def test_words(spark):
    docs = awkward()
    check(substrings.deduplicated(frame(spark, docs), keep_text=False).collect(), list(brute_words(docs, 50)))


def test_bytes(spark):
    docs = awkward()
    check(suffixes.deduplicated(frame(spark, docs), keep_bytes=False).collect(), list(brute_bytes(docs, 200)))


def test_small_windows(spark):
    docs = awkward()
    check(substrings.deduplicated(frame(spark, docs, 2), window=5, keep_text=False).collect(), list(brute_words(docs, 5)))
    check(suffixes.deduplicated(frame(spark, docs, 2), window=40, keep_bytes=False).collect(), list(brute_bytes(docs, 40)))


def test_kept_texts(spark):
    docs = frame(spark, [(1, "a b  c"), (2, None)])
    assert {r.doc_id: r.kept for r in substrings.deduplicated(docs).collect()} == {1: "a b c", 2: ""}
    assert {r.doc_id: bytes(r.kept) for r in suffixes.deduplicated(docs).collect()} == {1: b"a b  c", 2: b""}


def test_driver_table(spark):
    from foliant.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.op4_substring_dedup(spark, SF).collect(), list(brute_words(docs, 50)))
    check(queries.op9_suffix_dedup(spark, SF).collect(), list(brute_bytes(docs, 200)))


def found_locally(docs, module, make_units, pieces, window, gram, hot=(), at_once=7):
    """What three buckets find in documents that one task packs: covered units by document."""
    import pyarrow as pa

    packed = superkmers.Packer(window, gram, 3, module.settle, np.array(sorted(hot), np.uint64))
    held = defaultdict(list)

    def hand_on():
        blobs = packed.blobs()
        for b, blob in zip(blobs.column("bucket").to_pylist(), blobs.column("blob").to_pylist(), strict=True):
            held[b].append(blob)

    for i in range(0, len(docs), at_once):
        part = docs[i : i + at_once]
        ids = pa.array([d for d, _ in part], pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([t for _, t in part], pa.string())], names=["doc", "key", "text"])
        for given in superkmers.slices(batch, make_units, pieces, window):
            packed.pack(*given)
        hand_on()
    found = defaultdict(set)
    for blobs in held.values():
        doc, _, start, stop = module.judge(window)(superkmers.from_blobs(blobs))
        for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
            found[d] |= set(range(s, e))
    return found


def every_minimiser(docs, make_units, window, gram):
    import pyarrow as pa

    units = make_units(pa.array([t for _, t in docs], pa.string()))
    return set(superkmers.runs(units, superkmers.rolled(units.hashes, gram), window, gram)[3].tolist())


def test_tiny_memory(monkeypatch):
    """What a task remembers, how long its slices are, and which minimisers are hot, changes bytes moved, not results."""
    docs = [(i, t) for i, (_, t) in enumerate(awkward())]
    words = {d: n for d, _, n, _ in brute_words(docs, 50)}
    data = {d: n for d, _, n, _, _ in brute_bytes(docs, 200)}
    hot_words, hot_bytes = every_minimiser(docs, substrings.word_units, 50, 8), every_minimiser(docs, suffixes.byte_units, 200, 24)
    for remembered, size in ((100_000, 512 << 10), (1, 2000), (100_000, 150)):
        monkeypatch.setattr(superkmers, "REMEMBERED", remembered)
        monkeypatch.setattr(superkmers, "SLICE_BYTES", size)
        monkeypatch.setattr(suffixes, "JUDGED_BYTES", 3000 if size == 2000 else 2 << 20)
        for hot in ((), hot_words, list(hot_words)[::2]):
            found = found_locally(docs, substrings, substrings.word_units, substrings.word_pieces, 50, 8, hot)
            assert {d: len(found.get(d, ())) for d in words} == words
        for hot in ((), hot_bytes, list(hot_bytes)[::2]):
            found = found_locally(docs, suffixes, suffixes.byte_units, suffixes.byte_pieces, 200, 24, hot)
            assert {d: len(found.get(d, ())) for d in data} == data


def test_hot_minimisers_by_sample(spark, monkeypatch):
    """With every minimiser hot, the queries' results stay."""
    monkeypatch.setattr(superkmers, "HOT_FLOOR", 0)
    monkeypatch.setattr(superkmers, "HOT_BUCKETS", 0)
    docs = awkward()
    read = frame(spark, docs).selectExpr("doc_id AS doc", "xxhash64(text) AS key", "text")
    assert len(superkmers.hot_minimisers(read, 10**6, substrings.word_units, substrings.word_pieces, 50, 8)) > 50
    check(substrings.deduplicated(frame(spark, docs), keep_text=False).collect(), list(brute_words(docs, 50)))
    check(suffixes.deduplicated(frame(spark, docs), keep_bytes=False).collect(), list(brute_bytes(docs, 200)))


def test_long_texts(spark):
    """Texts of over a megabyte are gone through in pieces: one byte, a short period, and random words with repeats."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**7)}é" for _ in range(n))
    a, b, c = say(60_000), say(30_000), say(60_000)
    docs = [(1, "x" * 1_500_000), (2, f"{a} {b} {c}"), (3, f"{b}\n{b} end"), (4, "ab " * 500_000), (5, c[: len(c) // 2] + " other " + "x" * 300)]
    got = {r.doc_id: r for r in substrings.deduplicated(frame(spark, docs)).collect()}
    half = len(docs[4][1].split(" other ")[0].split(" "))
    assert [got[d].n_removed for d in (1, 2)] == [0, 0] and got[3].n_removed == 60_000 and got[4].n_removed == 0
    assert got[5].n_removed in (half, half - 1) and got[3].kept == "end" and got[2].kept == docs[1][1]
    got = {r.doc_id: r for r in suffixes.deduplicated(frame(spark, docs)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1_500_000, 1) and (got[4].n_removed, got[4].n_spans) == (1_500_000, 1)
    assert got[3].n_removed == 2 * len(b.encode()) or 0 < 2 * len(b.encode()) + 5 - got[3].n_removed < 10
    twice = len(b.encode()) + len(c[: len(c) // 2].encode())
    assert abs(got[2].n_removed - twice) < 8 and got[2].n_spans in (1, 2)


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(symbols):
    assert suffixes.sorted_suffixes(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_colliding_hashes():
    """Windows of equal hash are told apart by their words."""
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 3])
    at = np.array([0, 3, 6, 9])
    order, begins = substrings.exact_classes(np.zeros(4, np.uint64), ids, at, 3)
    groups = {frozenset(g.tolist()) for g in np.split(order, begins[1:])}
    assert groups == {frozenset({0, 1, 3}), frozenset({2})}
