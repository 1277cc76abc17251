"""How much of a table a Python worker holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that Spark sends at once, and that are Python objects at once.
ROWS, HELD = 1_000, 128


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Have Spark send at most ``rows`` rows at once to Python from now on, for
    texts may be long; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def slices(batch: pa.RecordBatch, rows: int = HELD) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
