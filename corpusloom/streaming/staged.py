"""The state of every path in scope, kept across the batches of a change feed.

The feed may bring commits late, again, or in any order: a path's state is its
change with the largest number, and a batch gives only states that it changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import in_scope
from ..sources.index import VersionedTable

STATE = "path string, op string, seq long"
#: States with many keys live on disk beside the executor and in the checkpoint.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastChange(StatefulProcessor):
    """Keeps (seq, step, op) of a path and gives it when it has moved on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, step int, op string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        now = before and tuple(before)
        for frame in rows:
            for row in zip(frame["seq"].tolist(), frame["step"].tolist(), frame["op"].tolist(), strict=True):
                if now is None or row[:2] > now[:2]:
                    now = row
        if now is not None and now != (before and tuple(before)):
            self.last.update(now)
            yield pd.DataFrame({"path": [key[0]], "op": [now[2]], "seq": [now[0]]})

    def close(self) -> None:
        pass


def last_changes(feed: DataFrame, scope: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, op, seq) of a streaming feed (status, path, new_path, seq): in
    each batch the paths in scope whose last change is now another one."""
    moved = in_scope(feed, scope).where("path is not null and seq is not null")
    return moved.groupBy("path").transformWithStateInPandas(LastChange(), STATE, "Update", "None")


def follow(feed: DataFrame, table: VersionedTable, fetch: Callable[[DataFrame], DataFrame], checkpoint: str, scope: Callable[[Column], Column] | None = None, key: str = "path", **trigger) -> StreamingQuery:
    """Keep ``table`` at the rows that ``fetch`` gives for the paths whose state
    is an upsert.  A batch that runs again gives the same rows, and one whose
    commits are older than what is known changes nothing."""
    spark = feed.sparkSession
    if spark.conf.get(PROVIDER[0], "") != PROVIDER[1]:
        raise RuntimeError(f"set {PROVIDER[0]} to {PROVIDER[1]}")

    def each(batch: DataFrame, _: int) -> None:
        net = batch.select(F.col("path").alias(key), "op").persist()
        try:
            if not net.isEmpty():
                table.apply(net, fetch(net.where("op = 'upsert'").select(key)), key)
        finally:
            net.unpersist()

    return last_changes(feed, scope).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_state_store(spark: SparkSession):
    """A session beside ``spark`` whose streams keep their state in the store
    that :func:`follow` needs; the caller's settings stay."""
    made = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        made.conf.set(name, spark.conf.get(name))
    made.conf.set(*PROVIDER)
    return made
