"""What the two classifiers share: folds, bounded samples and features brought to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow import map_slices


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; never for a NULL id."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(remainder == fold, F.lit(False))


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label of the documents whose label rows all say the same."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    both = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    return both.filter("label = most").drop("most")


def sample(ids: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows whose ids have the smallest hashes: the same on every run, and a top-k of
    bounded size that no shuffle of the rest precedes."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def features_of(docs: DataFrame, chosen: DataFrame, make) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, label, features) of a bounded sample in the order of ids, on the driver.

    ``chosen`` has at most as many rows as the samples it was made from, so it is broadcast and
    the documents are read once. Of rows with one id, the smallest text counts.
    """

    def work():
        features = make()

        def rows(batch: pa.RecordBatch) -> dict:
            found = [features(text or "") for text in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"],
                "label": batch["label"],
                "features": [row.astype("<u4").tobytes() for row in found],
            }

        return rows

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    brought = map_slices(one, work, "doc_id bigint, label int, features binary").toArrow()
    rows = zip(*(brought[name].to_pylist() for name in ("doc_id", "label", "features")))
    return [(i, label, np.frombuffer(f, "<u4")) for i, label, f in sorted(rows)]


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -40, 40)))
