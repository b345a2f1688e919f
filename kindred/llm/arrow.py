"""Maps over Arrow batches in small slices, so that a task never holds many long texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256


def map_slices(
    frame: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: str,
    rows: int = SLICE,
) -> DataFrame:
    """``make`` runs once per task; what it returns turns a slice into columns by name."""
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                columns = work(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in arrow_schema], schema=arrow_schema
                )

    return frame.mapInArrow(run, schema)
