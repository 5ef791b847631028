"""Files and rows as streams, through the same transformations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from foliant.functions import text, tokens
from foliant.sources import files

#: Files as Spark's reader of binary files gives them.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, most_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, detected."""
    read = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_per_trigger).load(folder)
    return files.detections(read.filter(files.supported(F.col("path"))).select("path", "modificationTime", "length", "content"))


def without_copies(stream: DataFrame, at: str = "modificationTime", late: str = "1 hour") -> DataFrame:
    """A content once, as far back as the watermark keeps."""
    return stream.withColumn("sha256", F.sha2("content", 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["sha256"])


def converted(stream: DataFrame, options: files.Options = files.Options()) -> DataFrame:
    return files.converted(stream, options)


def sanitized(stream: DataFrame, column: str = "text") -> DataFrame:
    """Rows that already hold text: sanitized, with their estimated tokens."""
    return stream.withColumn("markdown", text.optimized(F.col(column))).withColumn("tokens", tokens.estimated(F.col("markdown")))


def tokens_by_window(stream: DataFrame, at: str, width: str = "10 minutes", late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Documents and tokens by window of time (and key); late rows count as long as the watermark waits."""
    keys = [F.window(at, width).alias("window"), *([key] if key else [])]
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(*keys).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def to_tables(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends results as Parquet, once each."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
