"""Quality rules: per-document counts, and lines that too many documents of a host share. Built-in functions only.

Lines are normalised (lower case, digits as 0, white space as one space) and hashed to 128 bits. Per host the distinct
documents that hold a line are counted, documents with equal text counting once. A line is boilerplate where it stands
in at least ``min_docs`` of the host's documents and in over ``share`` of them. A document is depleted, and rejected,
where boilerplate lines hold over ``depleted`` of its words.

Hot lines and groups of copies: occurrences of a line are partial sums before they travel; lines that occur often enough
are then counted by (host, line, text), which spreads any one line over all tasks. Nothing is keyed by document id, so
ids may be null or repeat. What is broadcast is measured; beyond the limit the same joins run by shuffle.

Defined results: a null text has no words and fails; rows with a null host are one host; a document without lines isn't
depleted; an empty table gives no rows; other columns are kept by ``judged`` and never clash with the counts, which
``judged`` returns in place of columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import let, same, sent_if_small, staged, with_fixed, with_run_hashes, word_hashes, words_column

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
MIN_DOCS = 10
SHARE = 0.2
DEPLETED = 0.5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows found twice or more in the array. Where no two hashes of windows are equal there are none;
    else the windows themselves are sorted with their places, and neighbours that are equal give the places."""
    places = F.sequence(F.lit(1), F.size(words) - window + 1)
    tagged = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *(F.get(words, i + (k - 1)) for k in range(window))).alias("w"), i.alias("i"))))
    found = let(let(tagged, _repeats), lambda starts: covered(starts, window))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)


def _repeats(tagged: Column) -> Column:
    near = lambda x, j: F.coalesce(F.get(tagged, j)["w"] == x["w"], F.lit(False))
    return F.sort_array(F.transform(F.filter(tagged, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"]))


def covered(starts: Column, window: int) -> Column:
    """Words that windows cover together; starts: a sorted array, bound by let()."""
    steps = F.transform(starts, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def normalised(text: Column) -> Column:
    """Lines keep their places; each still has to be trimmed. A space alone stays as it is, which saves a match."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with COUNTS."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    arrays = docs.drop(*COUNTS).withColumns({"__words": words_column(F.col(text_column)), "__lines": lines})
    arrays = with_run_hashes(arrays.withColumn("__hashes", word_hashes(F.col("__words"))), "__hashes", "__windows", WINDOW)
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", "")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeated_words(F.col("__words"), F.col("__windows")),
    }
    return with_fixed(arrays, {k: c.cast("long") for k, c in counts.items()}).drop("__words", "__lines", "__hashes", "__windows")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def text_key(text: Column) -> dict[str, Column]:
    """128 bits for a text."""
    text = F.coalesce(text, F.lit(""))
    return {"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(7), text)}


def line_hashes(line: Column) -> dict[str, Column]:
    """128 bits for a normalised line."""
    return {"__h1": F.xxhash64(line), "__h2": F.xxhash64(F.lit(7), line)}


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """Of each text that holds boilerplate lines: host, key, words in such lines, hashes of the lines.

    Lines are made once, as a table of hashes. A line that occurs fewer than ``min_docs`` times can't stand in so many
    texts, so occurrences are counted first, by 64 bits alone, and only what is left is counted by text."""
    read = docs.select(F.col(host_column).alias("__host"), F.coalesce(F.col(text_column), F.lit("")).alias("__text")).withColumns(text_key(F.col("__text")))
    lines = read.select("__host", "__t1", "__t2", F.posexplode(F.split(normalised(F.col("__text")), "\n")).alias("__p", "__line"))
    lines = lines.withColumn("__line", F.trim("__line")).filter("__line <> ''")
    words = F.length("__line") - F.length(F.replace(F.col("__line"), F.lit(" "), F.lit(""))) + 1
    lines = staged(lines.withColumns(line_hashes(F.col("__line"))).select("__host", "__t1", "__t2", "__p", "__h1", "__h2", words.cast("long").alias("__w")), "lines")
    name = F.xxhash64("__host", "__h1", "__h2")
    often = staged(lines.groupBy(name.alias("__name")).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_docs).select("__name"), "frequent-lines")
    some = lines.join(sent_if_small(often, 16), name == F.col("__name"), "left_semi")
    # copies of a text bring the same places, so the set of places is the text's own
    by_text = some.groupBy("__host", "__h1", "__h2", "__t1", "__t2").agg((F.max("__w") * F.size(F.collect_set("__p"))).alias("__w"))
    by_text = staged(by_text, "frequent-by-text")
    common = by_text.groupBy("__host", "__h1", "__h2").agg(F.count("*").alias("__docs")).filter(F.col("__docs") >= min_docs)
    sizes = read.groupBy("__host", "__t1", "__t2").agg(F.lit(1).alias("__one")).groupBy(F.col("__host").alias("__of")).agg(F.count("*").alias("__all"))
    common = common.join(sizes, same(F.col("__host"), F.col("__of"))).filter(F.col("__docs") > share * F.col("__all"))
    common = staged(common.select(F.col("__of").alias("__c0"), F.col("__h1").alias("__c1"), F.col("__h2").alias("__c2")), "common-lines")
    common = sent_if_small(common, F.coalesce(F.octet_length("__c0"), F.lit(0)) + 40)
    hit = by_text.join(common, same(F.col("__host"), F.col("__c0")) & (F.col("__h1") == F.col("__c1")) & (F.col("__h2") == F.col("__c2")))
    found = hit.groupBy("__host", "__t1", "__t2").agg(F.sum("__w").alias("__lost"), F.collect_set(F.struct("__h1", "__h2")).alias("__gone"))
    # a table, so the join with documents has plain exchanges on both sides and AQE may split a group of copies
    return staged(found.select(F.col("__host").alias("__b0"), F.col("__t1").alias("__b1"), F.col("__t2").alias("__b2"), "__lost", "__gone"), "boilerplate")


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED, keep_text: bool = True, host_column: str = "source", text_column: str = "text") -> DataFrame:
    """docs with COUNTS, base_failed, n_lost (words in boilerplate lines), gone (those lines' hashes) and kept."""
    base = with_counts(docs.drop("base_failed", "n_lost", "gone", "kept").withColumns(text_key(F.col(text_column))), text_column)
    base = base if keep_text else base.drop(text_column)
    found = sent_if_small(boilerplate(docs, min_docs, share, host_column, text_column), 100 + 24 * F.size("__gone") + F.coalesce(F.octet_length("__b0"), F.lit(0)))
    joined = base.join(found, same(F.col(host_column), F.col("__b0")) & (F.col("__t1") == F.col("__b1")) & (F.col("__t2") == F.col("__b2")), "left")
    lost = F.coalesce("__lost", F.lit(0).cast("long"))
    joined = joined.withColumns({"base_failed": base_failed(), "n_lost": lost, "gone": F.coalesce("__gone", F.array().cast("array<struct<__h1:long,__h2:long>>"))})
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost") <= depleted * F.col("n_words"))).drop("__t1", "__t2", "__b0", "__b1", "__b2", "__lost", "__gone")


def without_lines(text: Column, gone: Column) -> Column:
    """The text less its lines with those hashes."""
    rest = F.filter(F.arrays_zip(F.split(text, "\n").alias("raw"), F.split(normalised(text), "\n").alias("norm")), lambda x: ~F.array_contains(gone, F.struct(*(c.alias(k) for k, c in line_hashes(F.trim(x["norm"])).items()))))
    return F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.transform(rest, lambda x: x["raw"]), "\n"))
