"""The change feed as a stream: each micro-batch becomes a version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.changes import net_changes
from ..sources.index import VersionedTable


def apply_batch(table: VersionedTable, batch: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: str = "path") -> None:
    """One micro-batch: net changes, deletions before upserts, one version.
    Running it again gives the same rows."""
    net = net_changes(batch).withColumnRenamed("path", key)
    table.apply(net, fetch(net.where("op = 'upsert'").select(key)), key)


def stream_changes(feed: DataFrame, table: VersionedTable, fetch: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "path", **trigger) -> StreamingQuery:
    """Follow a streaming feed (status, path, new_path, seq); ``fetch`` gives
    the present rows of keys."""

    def each(batch: DataFrame, _: int) -> None:
        apply_batch(table, batch, fetch, key)

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_feed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema("status string, path string, new_path string, seq long")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
