"""Sidecar files as a data source: folders are read in tasks, and a write
either leaves all its files or none.

``spark.read.format("sidecars").load(base)`` gives (sidecar, json) of the files
below a folder.  Their names begin with a dot, which Spark's own readers skip.
Files are written by :func:`bring_in`, for which no list passes the driver.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import work_folder

NAME = "sidecars"
SUFFIX = ".embed.json"
#: Where a write keeps its files until it is complete, below the folder it writes to.
DRAFTS = "_drafts"
#: Files that a reader holds at once.
ROWS = 64


def opened(uri: str):
    """(file system, path) of a folder's URI; a plain path is a local one."""
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")
    return system, path.rstrip("/")


def is_sidecar(name: str) -> bool:
    return name.startswith(".") and name.endswith(SUFFIX)


@dataclass
class Folder(InputPartition):
    """A folder, with what is below it or alone."""

    path: str
    deep: bool

    def __hash__(self):
        return hash((self.path, self.deep))


class SidecarReader(DataSourceReader):
    """One partition for each folder right below the base, and one for the
    base's own files: the driver sees the names of those folders only."""

    def __init__(self, base: str):
        self.base = base

    def partitions(self) -> list[Folder]:
        from pyarrow.fs import FileSelector, FileType

        system, root = opened(self.base)
        below = system.get_file_info(FileSelector(root, allow_not_found=True))
        return [Folder("", False), *(Folder(f.base_name, True) for f in sorted(below, key=lambda f: f.path) if f.type == FileType.Directory and f.base_name != DRAFTS)]

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.base)
        names, texts = [], []
        for path in (f.path for f in files_below(system, posixpath.join(root, folder.path) if folder.path else root, folder.deep) if is_sidecar(f.base_name)):
            names.append(path[len(root) :].lstrip("/"))
            with system.open_input_stream(path) as file:
                texts.append(file.read().decode("utf-8", "replace"))
            if len(names) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["sidecar", "json"])
                names, texts = [], []
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["sidecar", "json"])


def files_below(system, folder: str, deep: bool) -> Iterator:
    """The files of a folder in order, a folder's list at a time."""
    from pyarrow.fs import FileSelector, FileType

    left = [folder]
    while left:
        found = sorted(system.get_file_info(FileSelector(left.pop(), allow_not_found=True)), key=lambda f: f.path)
        yield from (f for f in found if f.type == FileType.File)
        if deep:
            left += [f.path for f in reversed(found) if f.type == FileType.Directory]


#: For mapInArrow, what writes the content of a row's file.
Fill = Callable[[BinaryIO, dict], None]


def drafted(rows: DataFrame, base: str, drafts: str, fill: Fill) -> DataFrame:
    """(draft, path, source) of rows (path, ...) whose files tasks have written
    below ``drafts``; a source that the rows don't have is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(base)
        folder, n = f"{drafts}/{uuid.uuid4().hex}", 0
        system.create_dir(f"{root}/{folder}", recursive=True)
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                clean = posixpath.normpath(row["path"])
                if clean.startswith(("..", "/")):
                    raise ValueError(f"{row['path']!r} is outside")
                made.append((f"{folder}/{n}", clean, row.get("source")))
                with system.open_output_stream(f"{root}/{made[-1][0]}") as out:
                    fill(out, row)
                n += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made, strict=True)], DRAFTED)

    return rows.mapInArrow(run, ", ".join(f"{name} string" for name in DRAFTED))


DRAFTED = ["draft", "path", "source"]


def run_on(rows: DataFrame, base: str, do: Callable) -> int:
    """Tasks do something with each row, given the file system, the folder's
    path in it and the row; how many it was done with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(base)
        for batch in batches:
            n = sum(bool(do(system, root, row)) for row in batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def place(system, root: str, row: dict) -> bool:
    """Move a draft to its place; one that an earlier attempt has moved is there."""
    from pyarrow.fs import FileType

    to = f"{root}/{row['path']}"
    if system.get_file_info(f"{root}/{row['draft']}").type == FileType.NotFound:
        if system.get_file_info(to).type == FileType.NotFound:
            raise FileNotFoundError(f"the draft of {row['path']} is gone")
        return True
    system.create_dir(posixpath.dirname(to), recursive=True)
    system.move(f"{root}/{row['draft']}", to)
    return True


def bring_in(rows: DataFrame, base: str, fill: Fill, check: Callable[[DataFrame], None] = lambda made: None) -> DataFrame:
    """Write a file for each row (path, ...) below a folder that all nodes see,
    and give (draft, path, source).  Tasks write drafts; when all are there and
    ``check`` has raised nothing, tasks move them to their places.  Which draft
    is whose stands in a table, of which the driver sees nothing."""
    spark, drafts = rows.sparkSession, f"{DRAFTS}/{uuid.uuid4().hex}"
    try:
        kept = work_folder(spark, "drafts")
        made = drafted(rows, base, drafts, fill)
        made.write.parquet(kept)
        made = spark.read.schema(made.schema).parquet(kept)
        check(made)
        run_on(made, base, place)
        return made
    finally:
        clear(base, drafts)


def clear(base: str, drafts: str) -> None:
    """Remove what attempts that don't count have left, and the drafts' folder if it is empty."""
    from pyarrow.fs import FileSelector, FileType

    system, root = opened(base)
    if system.get_file_info(f"{root}/{drafts}").type == FileType.Directory:
        system.delete_dir(f"{root}/{drafts}")
    if system.get_file_info(f"{root}/{DRAFTS}").type == FileType.Directory and not system.get_file_info(FileSelector(f"{root}/{DRAFTS}")):
        system.delete_dir(f"{root}/{DRAFTS}")


class SidecarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "sidecar string, json string"

    def reader(self, schema) -> SidecarReader:
        return SidecarReader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        raise ValueError("sidecars are written by write_files, which appends; a file replaces the one in its place")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SidecarSource)
