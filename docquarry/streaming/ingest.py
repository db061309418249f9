"""Documents that arrive as files, read as a stream: every step works on rows alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.classify import response_status
from docquarry.operators.search import pattern_matches
from docquarry.sources.readers import LARGEST, documents, oversized

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def incoming(spark: SparkSession, path: str, files_a_trigger: int = 1_000) -> DataFrame:
    """New files under ``path`` as documents."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_a_trigger).load(path)
    return documents(stream.filter(F.col("length") <= LARGEST)).unionByName(oversized(stream))


def watched(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """Sentences of incoming documents that hold a pattern; ``docs`` carries ``doc_id`` and ``text``."""
    return pattern_matches(docs, patterns)


def statuses(responses: DataFrame) -> DataFrame:
    """Incoming responses with their status."""
    return responses.withColumn("s", response_status(F.col("text"))).select("*", "s.status", F.col("s.confidence").alias("status_confidence")).drop("s")


def append(docs: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Append a stream to a Parquet table; a restart goes on where the checkpoint ends."""
    writer = docs.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
