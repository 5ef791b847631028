"""Every operator and stage on awkward tables: very long texts, nulls, repeated rows, no rows, clashing columns."""

import random

import pytest

import corpus_pipeline
from foliant.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DOCUMENTS = [name for name in queries.QUERIES if not name.startswith(("op2_", "op3_"))]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    rng = random.Random(1)
    big = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(100_000))
    rows = [(1, big), (2, "a " * 100_000), (3, "x" * 500_000), (4, big[:300_000] + " tail"), (5, "line\n" * 50_000), (6, None), (None, None), (None, "a short one"), (None, "a short one"), (7, "0123456789abcdef" * 10_000), (8, "aB3/" * 20_000), (8, "another text of one id"), (9, "")]
    frame = spark.createDataFrame([(i, t, None if i == 5 else "en", None if i == 3 else "s", 0) for i, t in rows], SCHEMA)
    clashes = {"__text": "1", "n_words": "'x'", "bands": "2", "stretches": "'y'", "label": "3", "kind": "'z'"}
    frame.selectExpr("*", *(f"{v} AS {k}" for k, v in clashes.items())).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder, len(rows)


@pytest.mark.parametrize("name", DOCUMENTS)
def test_operators(spark, long_texts, name):
    folder, n = long_texts
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) >= n if name.startswith("op1_") else len(got) == n


def test_stages(spark, long_texts):
    folder, _ = long_texts
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        assert out.count() >= 1 and (out.columns == docs.columns or "sequence_id" in out.columns)


def test_stages_without_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
