"""License scans: phrases, and an exact set-similarity join of text blocks with license templates. Built-in functions only.

Tokens of templates are ordered by their document frequency in the whole corpus, rarest first (ties by the token). A block
can only reach the containment threshold t of a template T, |B & T| >= a = ceil(t * |T|), where it holds one of the first
|T| - a + 1 tokens of T (prefix filter), has at least a tokens (length filter), and where the tokens from the common one
on, in either set, still suffice (positional filter). Pairs that remain are verified by their whole intersection.

Blocks are a text's lines and its paragraphs (split at blank lines). Templates of any number are tables of tokens, joined
with the texts' words; a table is broadcast where it measures little, else shuffled. Documents with equal texts are
scanned once; results come back by 128 bits of the text, so ids may be null or repeat.

Defined results: a null text is empty: no words, no labels, score 0; ties of containment make no difference, as all
labels are kept and the score is the greatest; a template without tokens fits nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, sent_if_small, staged, words_column

THRESHOLD = 0.8
#: What separates words (A-Z being in lower case), and the base phrases with their labels.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices by which licenses are granted, and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "Distributed under the GNU General Public License version 3"),
    ("cc-by-4.0", "This work is licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "Copyright All rights reserved"),
)


def words(lowered: Column) -> Column:
    return words_column(lowered, SEPARATOR)


def tokens_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+|[^\x00-\x7f]+", text.lower())))


def phrase_places(lowered: Column, words: Column, phrases=PHRASES) -> Column:
    """(start, label) of each place where a phrase's words stand one after another. Rows whose text the phrases'
    pattern doesn't match have none and aren't stepped through."""
    pattern = "|".join(SEPARATOR.join(p.split()) for p, _ in phrases)

    def at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in phrases:
            fits = F.lit(True)
            for k, w in enumerate(phrase.split()):
                fits = fits & (F.get(words, i + k) == w)
            out = F.when(F.coalesce(fits, F.lit(False)), F.lit(label)).otherwise(out)
        return out

    places = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("start"), at(i).alias("label")))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(lowered.rlike(pattern), F.filter(places, lambda x: x["label"].isNotNull())).otherwise(none)


def template_tables(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """template, label, size, least (tokens that a block must share), token: a row per token of each template."""
    rows = []
    for k, (label, text) in enumerate(templates):
        tokens = tokens_of(text)
        rows += [(k, label, len(tokens), math.ceil(threshold * len(tokens) - 1e-9), t) for t in tokens]
    return staged(spark.createDataFrame(rows, "template int, label string, size int, least int, token string"), "templates")


def held_tokens(rows: DataFrame, text: Column, vocabulary: DataFrame) -> DataFrame:
    """rows' columns with each token of the vocabulary (token, and what else it has) that their text holds, once."""
    each = rows.select(*rows.columns, F.explode(F.array_distinct(words(text))).alias("__token"))
    return each.join(vocabulary, F.col("__token") == F.col("token")).drop("__token")


def similar_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """By text (its 128 bits): every (label, block, containment) that reaches the threshold."""
    tokens = template_tables(docs.sparkSession, templates, threshold)
    width = F.octet_length("token") + 24
    vocabulary = tokens.select("token").distinct()
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(ascii_lower(text).alias("__low"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(7), text).alias("__t2"))
    held = staged(held_tokens(read, F.col("__low"), sent_if_small(vocabulary, width)).select("__t1", "__t2", "token"), "held-tokens")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    ordered = staged(vocabulary.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n")), "token-order")
    place = F.row_number().over(Window.partitionBy("template").orderBy("n", "token")) - 1
    prefix = tokens.join(ordered, "token").withColumn("place", place).filter("place <= size - least")
    prefix = staged(prefix.select("template", "label", "size", "least", "place", F.col("token").alias("rare")), "prefixes")
    rare = prefix.select("rare").distinct()
    near = held.join(sent_if_small(rare, F.octet_length("rare") + 24), F.col("token") == F.col("rare")).select(F.col("__t1").alias("__n1"), F.col("__t2").alias("__n2")).distinct()
    near = sent_if_small(staged(near, "near-licenses"), 32)
    some = read.join(near, (F.col("__t1") == F.col("__n1")) & (F.col("__t2") == F.col("__n2")), "left_semi").dropDuplicates(["__t1", "__t2"])
    pieces = F.array_distinct(F.concat(F.split("__low", "\n"), F.split("__low", r"\n[\x20\x09-\x0D]*\n")))
    blocks = some.select("__t1", "__t2", F.posexplode(pieces).alias("__block", "__piece"))
    own = held_tokens(blocks, F.col("__piece"), sent_if_small(ordered, width)).groupBy("__t1", "__t2", "__block").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("__own"))
    tried = own.select("*", F.posexplode("__own").alias("__j", "__x")).join(sent_if_small(prefix, F.octet_length("rare") + F.octet_length("label") + 48), F.col("__x.token") == F.col("rare"))
    # length and positional filters
    tried = tried.filter((F.size("__own") >= F.col("least")) & (F.least(F.col("size") - F.col("place"), F.size("__own") - F.col("__j")) >= F.col("least")))
    whole = tokens.groupBy(F.col("template").alias("__of")).agg(F.collect_list("token").alias("__all"))
    tried = tried.join(sent_if_small(whole, 16 + 24 * F.size("__all")), F.col("template") == F.col("__of"))
    common = F.size(F.array_intersect(F.transform("__own", lambda x: x["token"]), F.col("__all")))
    kept = tried.withColumn("__common", common).filter(F.col("__common") >= F.col("least"))
    return kept.select("__t1", "__t2", "__block", "label", "template", (F.col("__common") / F.col("size")).alias("containment")).distinct()


def scanned(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, places (start, label) of base phrases, base_labels, labels and score."""
    found = similar_blocks(docs, templates, threshold, text_column).groupBy(F.col("__t1").alias("__f1"), F.col("__t2").alias("__f2")).agg(F.collect_set("label").alias("__more"), F.max("containment").alias("__score"))
    found = staged(found, "licenses")  # a table, so AQE may split a group of copies in the join below
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), ascii_lower(text).alias("__low"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(7), text).alias("__t2"))
    base = base.withColumn("__words", words(F.col("__low")))
    base = base.select("doc_id", "__t1", "__t2", F.size("__words").cast("long").alias("n_words"), phrase_places(F.col("__low"), F.col("__words")).alias("places"))
    out = base.join(found, (F.col("__t1") == F.col("__f1")) & (F.col("__t2") == F.col("__f2")), "left")
    own = F.sort_array(F.array_distinct(F.transform("places", lambda x: x["label"])))
    out = out.withColumns({"base_labels": own, "score": F.coalesce("__score", F.lit(0.0))})
    every = F.sort_array(F.array_union("base_labels", F.coalesce("__more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "places", "base_labels", every.alias("labels"), "score")


def digest_columns(found: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
