"""Benchmark decontamination by winnowing. Built-in functions only.

A window is 13 consecutive words of an item, or all words of a shorter one. The fingerprint of a window is the least
hash among its k-grams, so windows that are equal have equal fingerprints, and a shared span of a window's length always
shares one. Distinct fingerprints of documents and items are joined; documents with a common one are extended: each of
their windows is compared with the items' windows, as 128 bits of hashes beside the fingerprint.

Documents with equal texts are compared once. Fingerprints and windows of the benchmark are rows of a fixed size, broadcast
where they measure little, else joined by shuffle; AQE may split a hot one, as results are partial sets by text. Windows
that the same items hold share a set's number (128 bits of the items' hashes, and their count), so a list of items stands
only in the result: hits bring numbers, and each text looks a number's items up once.

Defined results: a null text has no words and no hits; an item without words has no window; null and repeated ids of
documents give a row each; equal items each count; a null item id isn't listed, though its words are hit; an empty
documents table gives no rows, an empty benchmark no hits; other columns are ignored, or kept by ``without_hits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, same, sent_if_small, staged, with_run_hashes, with_run_minima, words_column

WINDOW = 13
#: Fixed value: what separates words after A-Z are in lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Columns that make up a set's number.
SET = ["__s0", "__s1", "__s2"]


def scheme(length: int) -> tuple[int, int]:
    """k and the number of k-grams in a window of so many words; k + w - 1 is the window's length."""
    w = max(1, length // 2)
    return length - w + 1, w


def words(text: Column) -> Column:
    return words_column(ascii_lower(text), SEPARATOR)


def with_hashes(df: DataFrame, text: Column) -> DataFrame:
    df = df.withColumn("__words", words(text))
    return df.withColumns({"__n": F.size("__words").cast("long"), "__a": F.transform("__words", lambda x: F.xxhash64(x))})


def with_fingerprints(df: DataFrame, length: int) -> DataFrame:
    """df with the fingerprint of each window of so many words."""
    k, w = scheme(length)
    return with_run_minima(with_run_hashes(df, "__a", "__grams", k), "__grams", "__marks", w).drop("__grams")


def windows(df: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row per window: the kept columns, its place, length, fingerprint and 128 bits."""
    df = with_fingerprints(df.withColumn("__b", F.transform("__words", lambda x: F.xxhash64(F.lit(7), x))), length)
    df = with_run_hashes(with_run_hashes(df, "__a", "__wa", length), "__b", "__wb", length)
    df = df.select(*keep, F.posexplode(F.arrays_zip("__marks", "__wa", "__wb")).alias("__p", "__x"))
    return df.select(*keep, "__p", F.lit(length).alias("__l"), *(F.col(f"__x.{c}").alias(c) for c in ("__marks", "__wa", "__wb")))


def text_keys(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(7), text)}


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, list[int]]:
    """Distinct windows with the number of the set of items that hold them, and the items of each number, as written
    tables; the lengths that occur."""
    items = with_hashes(benchmark.select(F.col(id_column).cast("string").alias("__item"), F.col(text_column).alias("__text")), F.col("__text"))
    items = items.filter("__n > 0").withColumn("__len", F.least(F.col("__n"), F.lit(window)))
    lengths = sorted(r[0] for r in items.select("__len").distinct().collect())  # at most ``window`` numbers
    every = [windows(items.filter(F.col("__len") == n), int(n), "__item") for n in lengths]
    if not every:
        every = [windows(items, window, "__item")]
    whole = every[0]
    for more in every[1:]:
        whole = whole.unionByName(more)
    keys = ["__l", "__marks", "__wa", "__wb"]
    held = staged(whole.select("__item", *keys).distinct(), "item-windows")
    number = [F.count(F.lit(1)).alias("__s0"), *(F.bit_xor(F.xxhash64(F.lit(seed), F.col("__item"))).alias(f"__s{seed}") for seed in (1, 2))]
    known = staged(held.groupBy(*keys).agg(*number), "windows")
    left, right = held.filter("__item IS NOT NULL").alias("h"), known.alias("k")
    sets = left.join(right, [F.col(f"h.{c}") == F.col(f"k.{c}") for c in keys]).select("__item", *SET).distinct()
    return known, staged(sets, "item-sets"), [int(n) for n in lengths]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """By text (its 128 bits): runs of hit words (start, end), words hit, and items with occurring windows."""
    known, sets, lengths = item_windows(benchmark, window)
    marks = staged(known.select(F.col("__l").alias("__ml"), F.col("__marks").alias("__mm")).distinct(), "item-marks")
    sent = sent_if_small(marks, 12)
    read = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")).withColumns(text_keys(F.col("__text")))
    hashed = with_hashes(read, F.col("__text")).drop("__text")

    def both(make) -> DataFrame | None:
        out = None
        for n in lengths:
            out = make(n) if out is None else out.unionByName(make(n))
        return out if out is not None else make(window)

    def marked(n: int) -> DataFrame:
        own = with_fingerprints(hashed, n).select("__id", "__t1", "__t2", F.explode(F.array_distinct("__marks")).alias("__m"))
        return own.join(sent.filter(F.col("__ml") == n), F.col("__m") == F.col("__mm"), "left_semi").select("__id", "__t1", "__t2")

    near = both(marked).groupBy("__t1", "__t2").agg(F.min("__id").alias("__first"))
    near = near.select(F.col("__t1").alias("__n1"), F.col("__t2").alias("__n2"), "__first")
    chosen = read.join(near, (F.col("__t1") == F.col("__n1")) & (F.col("__t2") == F.col("__n2")) & same(F.col("__id"), F.col("__first")), "left_semi")
    chosen = staged(chosen.select("__t1", "__t2", "__text"), "near-benchmark")
    table = sent_if_small(known.withColumnsRenamed({"__l": "__kl", "__marks": "__km", "__wa": "__ka", "__wb": "__kb"}), 52)

    def extended(n: int) -> DataFrame:
        own = windows(with_hashes(chosen, F.col("__text")).drop("__text"), n, "__t1", "__t2")
        on = (F.col("__marks") == F.col("__km")) & (F.col("__wa") == F.col("__ka")) & (F.col("__wb") == F.col("__kb")) & (F.col("__kl") == n)
        return own.join(table, on).select("__t1", "__t2", "__p", "__l", *SET)

    found = staged(both(extended), "found")
    text = ["__t1", "__t2"]
    # windows in order of their starts: one begins a run where it starts behind the end of all before it
    before = Window.partitionBy(*text).orderBy("__p", "__l").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(*text).orderBy("__p", "__l").rowsBetween(Window.unboundedPreceding, 0)
    runs = found.withColumn("__reach", F.max(F.col("__p") + F.col("__l")).over(before))
    runs = runs.withColumn("__run", F.count_if(F.coalesce(F.col("__reach") < F.col("__p"), F.lit(True))).over(up_to))
    runs = runs.groupBy(*text, "__run").agg(F.min("__p").alias("start"), F.max(F.col("__p") + F.col("__l")).alias("end"))
    runs = runs.groupBy(*text).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"))
    sets = sets.withColumnsRenamed({c: f"{c}s" for c in SET})
    items = found.select(*text, *SET).distinct().join(sent_if_small(sets, 24 + F.octet_length("__item")), [F.col(c) == F.col(f"{c}s") for c in SET])
    items = items.groupBy(F.col("__t1").alias("__i1"), F.col("__t2").alias("__i2")).agg(F.sort_array(F.collect_set("__item")).alias("items"))
    out = runs.join(items, (F.col("__t1") == F.col("__i1")) & (F.col("__t2") == F.col("__i2")), "left")
    out = out.select(F.col("__t1").alias("__h1"), F.col("__t2").alias("__h2"), "runs", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    # a table, so the join with documents has plain exchanges on both sides and AQE may split a group of copies
    return staged(out, "hits")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated, runs of hit words."""
    found = hits(docs, benchmark, window, id_column, text_column)
    base = docs.select(F.col(id_column).alias("doc_id"), F.size(words(F.col(text_column))).cast("long").alias("n_words"), *(c.alias(k) for k, c in text_keys(F.col(text_column)).items()))
    return _marked(base, found).select("doc_id", "n_words", "n_hit", "items", "contaminated", "runs")


def _marked(base: DataFrame, found: DataFrame) -> DataFrame:
    out = base.join(found, (F.col("__t1") == F.col("__h1")) & (F.col("__t2") == F.col("__h2")), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")), "runs": F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, all columns kept: contaminated ones go; from others the hit words go, with what separates them from the
    word before. A null text stays."""
    names = docs.columns
    found = hits(docs, benchmark, window, id_column, text_column)
    base = docs.select(F.struct(*names).alias("__row"), F.col(text_column).alias("__text"), *(c.alias(k) for k, c in text_keys(F.col(text_column)).items()))
    base = base.withColumn("n_words", F.size(words(F.col("__text"))))
    out = _marked(base, found).filter(~F.col("contaminated"))
    pieces = F.regexp_extract_all("__text", F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    tail = F.regexp_extract("__text", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    left = F.filter(pieces, lambda x, i: ~F.exists("runs", lambda r: (r["start"] <= i) & (i < r["end"])))
    text = F.when(F.col("n_hit") == 0, F.col("__text")).otherwise(F.concat(F.array_join(left, ""), tail))
    return out.select(*(text.alias(c) if c == text_column else F.col("__row").getField(c).alias(c) for c in names))


def digest_columns(judgement: DataFrame) -> DataFrame:
    listed = F.filter("items", lambda x: x.isNotNull())
    return judgement.select("doc_id", "n_words", "n_hit", F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), "contaminated")
