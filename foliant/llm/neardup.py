"""Near-duplicates by ProbMinHash.

A document's shingles (five words; of a shorter text, all its words) are weighted by how often they occur. Each shingle
is a Poisson process of its weight's rate: arrivals go to random registers, and a register keeps its earliest arrival's
shingle. Shingles whose next arrival comes after a document's latest register are done (early termination). Registers of
two documents agree with the probability Jaccard similarity of their weights, which for sets is Jaccard similarity.

Registers are banded; documents that share a band are candidates. Candidates' components are verified exactly, group by
group: two documents are linked where their probability Jaccard reaches the threshold, and a class is a component of
links. Pairs already in one class aren't compared, so no link that could join two classes is lost and a group of N copies
costs about N comparisons. Equal texts are collapsed before. Components too large for one task are split into chunks, in
each of which their most central documents stand too. What is left are bands whose members are in several classes: band by
band, and in blocks of a bounded size, those outside the band's largest class meet all its members. So a component that
grows with the corpus costs what its bands cost, not its square.

Defined results: a null text or one without words is a class of its own, whose id is its document's; a class's id is its
least document id; a null id counts as larger than any, and a class of null ids alone has a number from 2**62 on; rows
of one id are one document; ties don't occur among classes; an empty table gives no rows; other columns are ignored by
``classes`` and kept by ``representatives``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded_batches, hashed, mix, plain_memory, rolled, same, sent_if_small, staged, text_slices, word_table
from foliant.llm.graphs import components

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS, BANDS = 128, 32
SLICE_BYTES = 2 << 20
#: What one task verifies at most.
CHUNK_ROWS, CHUNK_BYTES = 1000, 8 << 20
#: Members by which a class meets the others of its component first.
LEADERS = 8
UNKNOWN = 1 << 62
#: Misses of one document after which it is compared with all members at once.
TRIES = 4


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each text's distinct shingles, their hashes (ascending by text) and weights."""
    bounds, ids, words = word_table(texts)
    values = hashed(words)[ids] if len(ids) else np.empty(0, np.uint64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    grams = rolled(values, width)
    inside = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :]) if len(grams) else np.empty(0, np.int64)
    docs, found = [owner[inside]], [grams[inside]]
    for n in range(1, width):  # texts of fewer words than a shingle
        few = np.flatnonzero(sizes == n)
        if len(few):
            docs.append(few)
            found.append(mix(rolled(values, n)[bounds[few]] + np.uint64(n)))
    doc, gram = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))) if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(doc)))
    return np.searchsorted(doc[first], np.arange(len(sizes) + 1)), gram[first], weights


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that a seed and a step decide."""
    return ((mix(seeds + np.uint64((2 * step + 1) * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bounds: np.ndarray, grams: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each text; of one without shingles, zeros."""
    n = len(bounds) - 1
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    seed, rate = grams, weights.astype(np.float64)
    arrival = np.zeros(len(doc))
    latest = np.full(n, np.inf)
    step = 0
    while len(doc):
        arrival = arrival - np.log(uniform(seed, 2 * step)) / rate
        go = arrival < latest[doc]
        doc, seed, rate, arrival = doc[go], seed[go], rate[go], arrival[go]
        if not len(doc):
            break
        at = doc * registers + (uniform(seed, 2 * step + 1) * registers).astype(np.int64)
        np.minimum.at(first, at, arrival)
        won = first[at] == arrival
        kept[at[won]] = seed[won]
        live = np.unique(doc)
        latest[live] = first.reshape(n, registers)[live].max(1)
        step += 1
    return kept.reshape(n, registers)


def banded(rows: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each signature."""
    n, registers = rows.shape
    out = np.zeros((n, bands), np.uint64) + mix(np.arange(1, bands + 1).astype(np.uint64))
    parts = rows.reshape(n, bands, registers // bands)
    for k in range(registers // bands):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets, each hashes in ascending order and weights."""
    every = np.union1d(a[0], b[0])
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a[0])] = a[1]
    v[np.searchsorted(every, b[0])] = b[1]
    both = (u > 0) & (v > 0)
    if not both.any():
        return 0.0
    ratio = np.where(v > 0, u / np.where(v > 0, v, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, u, v, both = ratio[order], u[order], v[order], both[order]
    below = np.searchsorted(ratio, ratio, side="left")  # those of a smaller ratio count by v, the others by u
    sum_u, sum_v = np.concatenate(([0], np.cumsum(u))), np.concatenate(([0], np.cumsum(v)))
    whole = (sum_u[-1] - sum_u[below][both]) / u[both] + sum_v[below][both] / v[both]
    return float((1 / whole).sum())


class Linker:
    """Classes among documents that meet in a task."""

    def __init__(self, threshold: float, weighted: list[tuple[np.ndarray, np.ndarray]], start: list[int]):
        self.threshold, self.weighted, self.tried = threshold, weighted, set()
        self.total = [float(w.sum()) for _, w in weighted]
        self.plain = [t == len(w) for t, (_, w) in zip(self.total, weighted, strict=True)]
        self.rows: dict[int, np.ndarray] = {}
        self.postings = None
        self.label = np.arange(len(weighted))  # the first member of each one's class
        first: dict[int, int] = {}
        for i, label in enumerate(start):
            self.join(first.setdefault(label, i), i)

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)

    def similar(self, i: int, j: int) -> bool:
        pair = (i, j) if i < j else (j, i)
        if pair in self.tried:
            return False
        a, b = self.weighted[i], self.weighted[j]
        least = self.threshold - 1e-12
        if self.plain[i] and self.plain[j]:  # sets: Jaccard similarity
            if len(a[0]) > len(b[0]):
                a, b = b, a
            near = len(a[0]) >= least * len(b[0])
            if near:
                at = np.searchsorted(b[0], a[0])
                common = int((b[0][np.minimum(at, len(b[0]) - 1)] == a[0]).sum())
                near = common >= least * (len(a[0]) + len(b[0]) - common)
        else:
            near = similarity(a, b) >= least
        if not near:
            self.tried.add(pair)
        return near

    def row(self, y: int) -> np.ndarray:
        """Of each member 1 if similar to y, 0 if not, 2 where only similarity() tells: common shingles with all members
        come from one pass over the postings of y's shingles."""
        if self.postings is None:
            sizes = np.array([len(w[0]) for w in self.weighted])
            grams, ids = np.unique(np.concatenate([w[0] for w in self.weighted]), return_inverse=True)
            order = np.argsort(ids, kind="stable")
            owner = np.repeat(np.arange(len(sizes)), sizes)[order]
            self.postings = ids, np.cumsum(sizes) - sizes, np.searchsorted(ids[order], np.arange(len(grams) + 1)), owner, sizes
        ids, starts, bounds, owner, sizes = self.postings
        own = ids[starts[y] : starts[y] + sizes[y]]
        counts = bounds[own + 1] - bounds[own]
        ends = np.cumsum(counts)
        members = owner[np.repeat(bounds[own] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        n = len(sizes)
        common = np.bincount(members, minlength=n)
        plain = np.array(self.plain)
        out = (common >= (self.threshold - 1e-12) * (sizes + sizes[y] - common)).astype(np.int8)
        # weights: what both hold is, in either, at least the threshold's share
        share = np.bincount(members, np.repeat(self.weighted[y][1], counts), n) / max(self.total[y], 1e-300)
        mixed = ~plain | (not self.plain[y])
        out[mixed] = np.where(share[mixed] >= self.threshold - 1e-9, 2, 0)
        return out

    def link(self, members: list[int], probes: np.ndarray) -> None:
        """Members that share a band: each is compared with those before it that aren't in its class, as long as one of
        the two is a probe; a hit ends the comparison with a class. As members come by descending centrality, what lies
        around one document is found at once; who misses TRIES times is compared with all members together."""
        every = np.array(members)
        for k in range(1, len(every)):
            y = int(every[k])
            others = every[:k] if probes[y] else every[:k][probes[every[:k]]]
            others = others[self.label[others] != self.label[y]]
            for _ in range(TRIES if y not in self.rows else 0):
                if not len(others):
                    break
                x = int(others[0])
                if self.similar(x, y):
                    self.join(x, y)
                others = others[1:]
                others = others[self.label[others] != self.label[y]]
            if not len(others):
                continue
            if y not in self.rows:
                self.rows[y] = self.row(y)
            row = self.rows[y]
            for label in np.unique(self.label[others[row[others] == 1]]).tolist():
                self.join(label, y)
            for x in others[row[others] == 2].tolist():
                if self.label[x] != self.label[y]:
                    row[x] = similarity(self.weighted[x], self.weighted[y]) >= self.threshold - 1e-12
                    if row[x]:
                        self.join(x, y)


def verified(threshold: float, width: int):
    """An applyInArrow function: links among the rows of a group as (a, b) pairs with the least node of each class."""

    def run(table: pa.Table) -> pa.Table:
        plain_memory()
        seen: set[int] = set()
        table = table.sort_by([("probe", "descending")])  # who stands twice stands as a probe
        pick = [i for i, n in enumerate(table.column("node").to_pylist()) if not (n in seen or seen.add(n))]
        table = table.take(pa.array(pick, pa.int64())).sort_by([("central", "descending"), ("node", "ascending")]).combine_chunks()
        nodes = table.column("node").to_pylist()
        bounds, grams, weights = shingles(pa.concat_arrays(table.column("text").chunks), width)
        linker = Linker(threshold, [(grams[a:b], weights[a:b].astype(np.float64)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], table.column("label").to_pylist())
        probes = np.array(table.column("probe").to_pylist(), bool)
        bands: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(table.column("bands").to_pylist()):
            for h in own:
                bands[h].append(i)
        for members in sorted((m for m in bands.values() if len(m) > 1), key=len, reverse=True):
            linker.link(members, probes)
        least: dict[int, int] = {}
        for i, n in enumerate(nodes):
            root = int(linker.label[i])
            least[root] = min(n, least.get(root, n))
        return pa.table([table.column("part"), pa.array(nodes, pa.int64()), pa.array([least[int(linker.label[i])] for i in range(len(nodes))], pa.int64())], names=["part", "a", "b"])

    return run


def signed(docs: DataFrame, width: int = SHINGLE, registers: int = REGISTERS, bands: int = BANDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, 128 bits of the text, its bytes, and its bands (none for a text without words), as a written table."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_memory()
        for whole in batches:
            for part in text_slices(whole, "text", SLICE_BYTES):
                bounds, grams, weights = shingles(part.column("text"), width)
                made = banded(signatures(bounds, grams, weights, registers), bands)
                has = np.diff(bounds) > 0
                offsets = np.concatenate(([0], np.cumsum(np.where(has, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "k1", "k2", "size")] + [lists], names=["doc_id", "k1", "k2", "size", "bands"])

    return staged(read.mapInArrow(run, "doc_id long, k1 long, k2 long, size long, bands array<long>"), "signatures")


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, hub, n): each node's bands that others share, the least node of the band, and how many share it. Linear in
    a band's members."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    hubs = rows.groupBy(F.col("band").alias("of")).agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return staged(rows.join(hubs, F.col("band") == F.col("of")).select("node", "hub", "n"), "shared-bands")


def _link(rows: DataFrame, threshold: float, width: int, name: str) -> DataFrame:
    """rows: part, grp, node, label, probe, central, bands, text. Links (part, a, b), as a written table."""
    rows = rows.select("part", "grp", "node", "label", "probe", "central", "bands", "text")
    return staged(rows.groupBy("part", "grp").applyInArrow(verified(threshold, width), "part long, a long, b long"), name)


def labels(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(node, label) of nodes (node, bands, size) in classes of two or more; texts: (node, text), maybe repeated."""
    shared = candidates(nodes)
    part = components(shared.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnsRenamed({"label": "part"})
    central = shared.groupBy(F.col("node").alias("m")).agg(F.sum("n").alias("central"))
    sized = part.join(central, F.col("node") == F.col("m")).join(nodes.select(F.col("node").alias("n"), "size", "bands"), F.col("node") == F.col("n")).drop("m", "n")
    sized = staged(sized, "candidates")
    parts = sized.groupBy(F.col("part").alias("p")).agg(F.greatest(F.ceil(F.count("*") / chunk_rows), F.ceil(F.sum("size") / chunk_bytes)).cast("long").alias("chunks"))
    parts = staged(parts, "parts")
    sized = sized.join(parts, F.col("part") == F.col("p")).drop("p")
    rows = staged(sized.join(texts.select(F.col("node").alias("n"), "text"), F.col("node") == F.col("n")).drop("n"), "candidate-texts")
    everyone = rows.withColumns({"grp": F.pmod(F.xxhash64("node"), F.col("chunks")), "label": F.col("node"), "probe": F.lit(True)})
    if parts.filter("chunks > 1").isEmpty():
        return _link(everyone, threshold, width, "links").select(F.col("a").alias("node"), F.col("b").alias("label"))

    # of a component in several chunks, the documents that share bands with most others stand in every chunk
    large = rows.filter("chunks > 1")
    lead = large.groupBy("part", F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.lit(LEADERS))).agg(F.max(F.struct("central", "node")).alias("lead")).select(F.col("lead.node").alias("lead"))
    lead = staged(lead, "leaders")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    leaders = large.join(lead, F.col("node") == F.col("lead"), "left_semi").withColumns({"grp": every, "label": F.col("node"), "probe": F.lit(True)})
    links = _link(everyone.unionByName(leaders), threshold, width, "links")

    def labelled(found: DataFrame, again: DataFrame) -> DataFrame:
        """found (node, label) after labels were linked, again: (node, label) of labels in larger components."""
        again = again.select(F.col("node").alias("o"), F.col("label").alias("into"))
        return found.join(again, F.col("label") == F.col("o"), "left").withColumn("label", F.coalesce("into", "label")).drop("o", "into")

    across = links.join(lead, F.col("a") == F.col("lead"), "left_semi").filter("a <> b").select("a", "b")
    found = labelled(links.select("part", F.col("a").alias("node"), F.col("b").alias("label")), components(across))
    found = staged(found.groupBy("part", "node").agg(F.min("label").alias("label")), "classed")
    # bands of several classes: who is outside a band's largest class meets all its members, in cells of chunks and blocks
    own = found.select(F.col("node").alias("o"), "label")
    held = large.select("node", "size", F.explode(F.array_distinct("bands")).alias("band")).join(own, F.col("node") == F.col("o")).select("band", "node", "size", "label")
    held = staged(held, "banded")
    named = [F.sum(F.shiftright(F.xxhash64(F.lit(k), F.col("node")), 24)).alias(f"s{k}") for k in (1, 2, 3)]  # 40 bits each: sums don't overflow
    by_label = held.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *named)
    tops = by_label.groupBy(F.col("band").alias("of")).agg(F.max(F.struct("n", "label", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels"), *(F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2, 3))).filter("labels > 1")
    tops = tops.dropDuplicates(["n", "s1", "s2", "s3"])  # near copies share many bands: of those with the same members one is enough
    cells = lambda n, size: F.greatest(F.ceil(n / chunk_rows), F.ceil(size / chunk_bytes), F.lit(1)).cast("long")
    tops = tops.select("of", F.col("top.label").alias("top"), cells(F.col("n"), F.col("bytes")).alias("chunks"), cells(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("blocks"))
    tops = staged(tops, "mixed-bands")
    if tops.isEmpty():
        return found.select("node", "label")
    mixed = staged(held.join(sent_if_small(tops, 48), F.col("band") == F.col("of")).select("band", "node", "label", "top", "chunks", "blocks"), "mixed")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block, chunk = F.pmod(F.xxhash64(F.lit(2), F.col("node")), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("chunks"))
    outside = mixed.filter("label <> top").withColumns({"block": block, "probe": F.lit(True), "chunk": each("chunks")})
    others = mixed.withColumns({"chunk": chunk, "probe": F.lit(False), "block": each("blocks")})
    dealt = outside.unionByName(others).select(F.col("band").alias("part"), (F.col("chunk") * F.lit(1 << 31) + F.col("block")).alias("grp"), F.col("node").alias("m"), "label", "probe", F.array("band").alias("bands"))
    dealt = dealt.join(large.select("node", "central", "text"), F.col("m") == F.col("node"))
    links = _link(dealt, threshold, width, "band-links")
    joined = links.join(own, F.col("a") == F.col("o")).select(F.col("label").alias("la"), "b").join(own, F.col("b") == F.col("o"))
    joined = staged(joined.select(F.col("la").alias("a"), F.col("label").alias("b")).filter("a <> b").distinct(), "linked-labels")
    if joined.isEmpty():
        return found.select("node", "label")
    return labelled(found.select("node", "label"), components(joined))


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text", chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, k1, k2, node (the least id of documents with this text) and class_id, for each row of docs."""
    signs = signed(docs, width, id_column=id_column, text_column=text_column)
    own = F.coalesce("least", F.lit(UNKNOWN) + F.shiftrightunsigned("k1", 2))
    texted = signs.filter(F.size("bands") > 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    nodes = staged(texted.withColumn("node", own), "nodes")
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    names = nodes.select("k1", "k2", "least", "node")
    # one row a text goes on, and only those that are candidates survive the join by node
    texts = read.join(names, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & same(F.col("id"), F.col("least"))).select("node", "text")
    found = labels(nodes, texts, threshold, width, chunk_rows, chunk_bytes).select(F.col("node").alias("of"), "label")
    judged = names.join(found, F.col("node") == F.col("of"), "left").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "node", F.coalesce("label", "node").alias("label"))
    judged = staged(judged, "judged")  # a table, so AQE may split a group of copies in the join below
    out = signs.select("doc_id", "k1", "k2").join(judged, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
    return out.select("doc_id", "k1", "k2", "node", F.coalesce("label", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, every column kept: of each class the document with the least id, once; documents without words stay."""
    names = docs.columns
    judged = staged(classes(docs, threshold, width, id_column, text_column), "classes")  # a table, so AQE may split a group of copies before
    stay = judged.filter("node IS NULL OR node = class_id").select(F.col("doc_id").alias("__i"), F.col("k1").alias("__a"), F.col("k2").alias("__b"), F.col("node").alias("__node")).distinct()
    stay = stay.filter(F.col("__node").isNull() | same(F.col("__i"), F.col("__node")) | (F.col("__node") >= UNKNOWN))
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.struct(*names).alias("__row"), F.col(id_column).cast("long").alias("__id"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(7), text).alias("__t2"))
    kept = read.join(stay, same(F.col("__id"), F.col("__i")) & (F.col("__t1") == F.col("__a")) & (F.col("__t2") == F.col("__b")))
    once = kept.filter("__node IS NOT NULL").dropDuplicates(["__id", "__t1", "__t2"]).unionByName(kept.filter("__node IS NULL"))
    return once.select(*(F.col("__row").getField(c).alias(c) for c in names))
