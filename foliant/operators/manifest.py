"""Results, reports, bundles and regression checks as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import names, tokens

SCHEMA_VERSION = "1.1"


def report(results: DataFrame) -> DataFrame:
    """A flat row per result (source, output, kind, engine, success, error, warning, duration_s, markdown)."""
    return results.select(
        "source", "output", "kind", "engine", tokens.status(F.col("success"), F.col("warning")).alias("status"), "error", "warning", F.round(F.coalesce("duration_s", F.lit(0.0)), 4).alias("duration_s"),
        F.when(F.col("success"), tokens.estimated(F.col("markdown"))).alias("token_estimate"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: counts by status, and tokens."""
    state = tokens.status(F.col("success"), F.col("warning"))
    return results.agg(
        F.count_if(F.col("success")).alias("converted"), F.count_if(state == "Warning").alias("warned"), F.count_if(state == "Error").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), tokens.estimated(F.col("markdown")))), F.lit(0)).alias("tokens"),
    )


def savings(results: DataFrame) -> DataFrame:
    """name, sizes, tokens and share saved of the results that succeeded; a source without a size counts as 0."""
    size = F.octet_length("markdown").cast("long")
    original = F.coalesce("original_size", F.lit(0).cast("long"))
    return results.filter("success").select(
        names.file_name(F.col("source")).alias("name"), original.alias("original_size"), size.alias("markdown_size"), tokens.estimated(F.col("markdown")).alias("tokens"),
        tokens.saved_percent(original, size).alias("saved_ratio"),
    )


def savings_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """savings() in columns of fixed width, and the columns to keep."""
    left = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))
    right = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, " "))
    return rows.select(*keep, "name", F.concat(
        left(F.col("name"), 28), right(tokens.human_size(F.col("original_size")), 12), right(tokens.human_size(F.col("markdown_size")), 12),
        right(F.concat(F.lit("~"), F.format_number("tokens", 0)), 10), right(tokens.fixed_percent(F.col("saved_ratio")), 8),
    ).alias("line"))


def deliverable(results: DataFrame, include_warnings: bool = False) -> DataFrame:
    """Results that a bundle takes: succeeded, with text, and without a warning unless asked for."""
    kept = results.filter(F.col("success") & F.col("markdown").rlike(r"\S"))
    return kept if include_warnings else kept.filter(F.coalesce("warning", F.lit("")) == "")


def documents(results: DataFrame, order: str) -> DataFrame:
    """A bundle's documents: name, file, source, engine, kind, sha256, chars, tokens, duration_s, warning."""
    named = names.unique_names(results.withColumn("name", names.stem_of(F.col("source"))).withColumn("__stem", names.safe_stem(F.col("name"))), "__stem", order)
    return named.select(
        order, "name", "file", "source", "engine", "kind", F.sha2("markdown", 256).alias("sha256"), F.length("markdown").alias("chars"), tokens.estimated(F.col("markdown")).alias("tokens"),
        F.round("duration_s", 4).alias("duration_s"), F.when(F.coalesce("warning", F.lit("")) != "", F.col("warning")).alias("warning"),
    )


def manifest_head(docs: DataFrame, producer: str, version: str, target: str, created_at: Column | None = None) -> DataFrame:
    """One row: the manifest's own fields."""
    created = created_at if created_at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    head = {"schema": F.lit(SCHEMA_VERSION), "producer": F.lit(producer), "producer_version": F.lit(version), "target": F.lit(target), "created_at": created}
    return docs.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens")).select(*(c.alias(k) for k, c in head.items()), "document_count", "total_tokens")


def manifest_lines(docs: DataFrame, order: str, *head) -> Iterator[str]:
    """The manifest's JSON, piece by piece: documents come in order, a partition of them at a time. Fields that are null
    are left out."""
    first = json.dumps(manifest_head(docs, *head).first().asDict(), indent=2, ensure_ascii=False)
    yield first.removesuffix("\n}") + ',\n  "documents" : ['
    rows = docs.select(order, F.to_json(F.struct(*(c for c in docs.columns if c != order))).alias("__json")).orderBy(order).select("__json")
    mark = "\n    "
    for row in rows.toLocalIterator():
        yield mark + row[0]
        mark = ",\n    "
    yield "\n  ]\n}\n"


def regression(golden: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """golden and current (key, markdown, status): outcome and what changed. A key on one side is new or missing."""
    rank = lambda c: F.when(c == "Success", 0).when(c == "Warning", 1).otherwise(2)
    a = golden.select(key, F.col("markdown").alias("old"), F.col("status").alias("old_status"))
    b = current.select(key, F.col("markdown").alias("new"), F.col("status").alias("new_status"))
    both = a.join(b, key, "full_outer")
    outcome = (
        F.when(F.col("new_status").isNull(), F.lit("missing")).when(F.col("new_status") == "Error", F.lit("error")).when(F.col("old_status").isNull(), F.lit("new"))
        .when(rank(F.col("new_status")) > rank(F.col("old_status")), F.lit("worse")).when(F.col("old") == F.col("new"), F.lit("same")).otherwise(F.lit("changed"))
    )
    return both.select(key, "old_status", "new_status", outcome.alias("outcome"))


def similarity(old: Column, new: Column) -> Column:
    """How much of two texts is in common, line by line in order: twice the matched lines by all lines; 1 for equal texts,
    null where one is null."""

    def ratio(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        return 1.0 if a == b else SequenceMatcher(None, a.splitlines(), b.splitlines(), autojunk=False).ratio()

    return F.arrow_udf(lambda a, b: pa.array([ratio(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64()), "double")(old, new)


def missing_phrases(docs: DataFrame, phrases: DataFrame, key: str = "path") -> DataFrame:
    """(key, phrase) of phrases that a document should hold and, white space aside, doesn't."""
    squashed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    joined = phrases.select(key, "phrase").join(docs.select(key, squashed(F.col("markdown")).alias("__text")), key, "left")
    return joined.filter(~F.contains(F.coalesce("__text", F.lit("")), squashed(F.col("phrase")))).select(key, "phrase")
