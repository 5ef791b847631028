"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, neardup, packing, quality, secrets
from foliant.llm.common import shared_path
from foliant.llm.queries import table, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from those that stay."""
    names = docs.columns
    judged = quality.judged(docs).filter("kept")
    return _counted(judged.withColumn("text", quality.without_lines(F.col("text"), F.col("gone"))).select(*names))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays."""
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; hit words go from those that stay."""
    return _counted(decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by a mark."""
    return _counted(secrets.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(packing.tokenised_pieces(docs, tokenizer_path()))


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("best-fit packing", best_fit_packing)]

#: Tokens, signatures and window counts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
