"""Near-duplicate classes against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliant.llm import graphs, neardup, queries

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")


def weights(text):
    w = WS.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def probability_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in keys) for d in a.keys() & b.keys())


def brute(docs, threshold=0.8):
    """Least id of each document's class; ids are unique and not null."""
    sets, holders = {d: weights(t) for d, t in docs}, defaultdict(list)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for k in s:
            holders[k].append(d)
    tried = set()
    for members in holders.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                if (a, b) not in tried and find(a) != find(b):
                    tried.add((a, b))
                    if probability_jaccard(sets[a], sets[b]) >= threshold - 1e-12:
                        x, y = find(a), find(b)
                        up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    out, at = [], 0
    for size in (1, 1, 2, 3, 30, 120):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(size):
            out.append((at, " ".join(w if rng.random() > 0.015 else rng.choice(words) for w in base)))
            at += 1
    out += [(at + i, t) for i, t in enumerate(["", None, " \n", "one two", "one two", "one two three", "a b c d e", "a b c d e", "x " * 400, "x " * 500, "x " * 90])]
    return out


def test_similarity_and_registers():
    rng = random.Random(1)
    for _ in range(20):
        a = {k: rng.randint(1, 4) for k in rng.sample(range(80), 40)}
        b = {**{k: v for k, v in a.items() if rng.random() > 0.2}, **{k: 2 for k in range(100, 100 + rng.randint(0, 9))}}
        pair = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float)) for d in (a, b)]
        exact = probability_jaccard(Counter(a), Counter(b))
        assert neardup.similarity(*pair) == pytest.approx(exact)
        seeds = [neardup.mix(p[0]) for p in pair]
        rows = neardup.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate(seeds), np.concatenate([p[1] for p in pair]), 4096)
        assert abs((rows[0] == rows[1]).mean() - exact) < 0.05


@pytest.mark.parametrize("rows", [1000, 7])
def test_classes(spark, rows):
    docs = corpus()
    wanted = brute(docs)
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, label string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame, chunk_rows=rows).collect()}
    assert got == wanted
    assert len(set(wanted.values())) < len(wanted) - 100


def test_driver_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in queries.op8_near_duplicates(spark, SF).collect()} == brute(docs)


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (7, long), (7, long), (9, long + " more"), (None, "only null " + long[::-1]), (None, None), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(frame).collect()), key=str)
    alone = [c for d, c in got if d is None and c is not None and c != 7]
    assert len(alone) == 1 and alone[0] >= neardup.UNKNOWN
    assert Counter(got) == Counter([(None, 7), (7, 7), (7, 7), (9, 7), (None, alone[0]), (None, None), (3, 3), (4, 4)])
    kept = Counter((r.doc_id, r.text) for r in neardup.representatives(frame).collect())
    assert kept == Counter([(7, long), (None, "only null " + long[::-1]), (None, None), (3, None), (4, "")])


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(50)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(500, 501 + i) for i in range(40)] + [(900, 900)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if x != 900}


def test_rows_of_comparisons():
    """All members at once give what pairs give."""
    rng = random.Random(5)
    sets = []
    for k in range(60):
        base = rng.sample(range(40), 25)
        sets.append({**{b: 1 if k % 3 else rng.randint(1, 3) for b in base if rng.random() > 0.1}, 1000 + k: 1})
    weighted = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float)) for d in sets]
    linker = neardup.Linker(0.5, weighted, list(range(60)))
    for y in range(60):
        row = linker.row(y)
        for x in range(60):
            near = neardup.similarity(weighted[x], weighted[y]) >= 0.5 - 1e-12
            assert row[x] == 2 or bool(row[x]) == near
            assert near <= bool(row[x])
