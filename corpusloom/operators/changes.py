"""Change feeds: what a run of commits comes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_note_path


def expand_changes(feed: DataFrame) -> DataFrame:
    """(path, op, seq) from (status, path, new_path, seq): added, copied and
    modified files are upserts, a deletion deletes, and a rename deletes the
    old path and upserts the new one; of one commit deletions come first."""
    op = lambda name, path, step: F.struct(F.lit(name).alias("op"), path.alias("path"), F.lit(step).alias("step"))
    s = F.upper(F.substring("status", 1, 1))
    empty = F.array().cast("array<struct<op:string,path:string,step:int>>")
    ops = (
        F.when(s.isin("A", "M"), F.array(op("upsert", F.col("path"), 1)))
        .when(s == "C", F.array(op("upsert", F.coalesce("new_path", "path"), 1)))
        .when(s == "D", F.array(op("delete", F.col("path"), 0)))
        .when(s == "R", F.array(op("delete", F.col("path"), 0), op("upsert", F.col("new_path"), 1)))
        .otherwise(empty)
    )
    return feed.select("seq", F.explode(ops).alias("o")).select("o.path", "o.op", "seq", "o.step")


def in_scope(feed: DataFrame, scope: Callable[[Column], Column] | None = None) -> DataFrame:
    """:func:`expand_changes` for the paths in scope, by default those of
    notes: a file that moves out of it is deleted, one that moves in is new."""
    return expand_changes(feed).where((scope or is_note_path)(F.col("path")))


def staged_notes(feed: DataFrame, scope: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path): the notes that the added, copied and modified files of a feed
    (status, path, new_path) are; what is renamed or deleted is not staged."""
    s = F.upper(F.substring("status", 1, 1))
    path = F.when(s == "C", F.coalesce("new_path", "path")).otherwise(F.col("path"))
    return feed.where(s.isin("A", "C", "M")).select(path.alias("path")).where((scope or is_note_path)(F.col("path"))).distinct()


def net_changes(feed: DataFrame, path: str = "path") -> DataFrame:
    """(path, op): the last change of each path."""
    return expand_changes(feed).groupBy(path).agg(F.max_by("op", F.struct("seq", "step")).alias("op"))


def apply_changes(base: DataFrame, net: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """``base`` after ``net``: changed keys leave, and upserted ones come back
    from ``fresh`` (rows like ``base``'s, for the upserted keys)."""
    kept = base.join(net.select(key), key, "left_anti")
    return kept.select(*base.columns).unionByName(fresh.join(net.where("op = 'upsert'").select(key), key, "left_semi").select(*base.columns))
