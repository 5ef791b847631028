"""File names, kinds and manifests' figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that file names lose, names that devices own, the longest stem.
RESERVED = r'[<>:"/\\|?*\x00-\x1f]'
DEVICES = r"(?i)\A(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|\z)"
LONGEST = 120


def safe_stem(name: Column) -> Column:
    """A name that any file system takes."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, RESERVED, "_")), r"[. ]+\z", "")
    return F.when(clean == "", F.lit("document")).otherwise(F.substring(F.when(clean.rlike(DEVICES), F.concat(F.lit("_"), clean)).otherwise(clean), 1, LONGEST))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)\z", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def stem_of(path: Column) -> Column:
    name = file_name(path)
    return F.when(suffix_of(path) != "", F.regexp_replace(name, r"\.[^.]+\z", "")).otherwise(name)


def unique_names(docs: DataFrame, stem: str, order: str, out: str = "file", suffix: str = ".md") -> DataFrame:
    """docs with a file name each, no two alike whatever their case: the first of a stem keeps it, the others get -1,
    -2 ... in order, skipping names that an earlier document has.

    A stem's family is the stem without such endings: only there generated and natural names can meet. Where a family has
    one stem, or no stem twice, a row's place among its equals is its number, by one window. What is left, families with
    several stems and equal ones, is gone through in order, a family at a time."""
    low = F.lower(F.col(stem))
    family = F.regexp_replace(low, r"(?:-\d+)+\z", "")
    rows = docs.withColumns({"__low": low, "__family": family})
    sizes = rows.groupBy("__family", "__low").agg(F.count("*").alias("n")).groupBy(F.col("__family").alias("__of"))
    mixed = sizes.agg(F.count("*").alias("stems"), F.max("n").alias("most")).filter("stems > 1 AND most > 1").select("__of")
    inside = F.col("__family").eqNullSafe(F.col("__of"))
    place = F.row_number().over(Window.partitionBy("__low").orderBy(order)) - 1
    ending = lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("-"), k.cast("string")))
    plain = rows.join(mixed, inside, "left_anti").withColumn("__n", place)

    def numbered(family: pd.DataFrame) -> pd.DataFrame:
        family = family.sort_values("at", kind="stable")
        used: set[str] = set()
        after: dict[str, int] = {}
        numbers = []
        for stem in family["low"]:
            n = after.get(stem, 0)
            while (name := f"{stem}-{n}" if n else stem) in used:
                n += 1
            used.add(name)
            after[stem] = n + 1
            numbers.append(n)
        return pd.DataFrame({"__at": family["at"], "__n": numbers})

    crowd = rows.join(mixed, inside, "left_semi")
    kind = docs.schema[order].dataType.simpleString()
    given = crowd.select("__family", F.col(order).alias("at"), F.col("__low").alias("low")).groupBy("__family").applyInPandas(numbered, f"__at {kind}, __n int")
    crowd = crowd.join(given, F.col(order) == F.col("__at"))
    both = plain.select(*docs.columns, "__n").unionByName(crowd.select(*docs.columns, "__n"))
    return both.withColumn(out, F.concat(F.col(stem), ending(F.col("__n")), F.lit(suffix))).drop("__n")
