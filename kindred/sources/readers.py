"""Line sources: bulk files and message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bulk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an uploaded file or folder; large files are split among tasks."""
    return spark.read.text(path)


def message_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of message files."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, max_per_batch: int | None = None
) -> DataFrame:
    """A stream of Kafka message values, read in parallel from all partitions of the topic.

    The Kafka connector package has to be on the cluster's class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Send encoded messages (a ``value`` column) to a topic."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
