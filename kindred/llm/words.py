"""What all text operators mean by a word, and tables written in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.session import work_folder

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def written(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame as a Parquet table in the shared work folder, so that a lost executor costs a
    read and not the steps before it."""
    spark: SparkSession = frame.sparkSession
    path = work_folder(spark, name)
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)
