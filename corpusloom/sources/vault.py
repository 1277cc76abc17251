"""The files of a vault: listed, brought in, seeded and wiped by tasks.

``spark.read.format("vault_files").load(base)`` gives (path, size) of all files
below a folder, those with a leading dot as well, which Spark's own readers
skip.  Files come in by tasks that leave all of them or none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.text import ROOTS
from .shared import work_folder
from .sidecar_files import DRAFTS, SUFFIX, Folder, bring_in, files_below, opened, run_on

NAME = "vault_files"
#: Files that a reader lists at once, and bytes that a copy holds at once.
ROWS, BLOCK = 4096, 1 << 20


class FilesReader(DataSourceReader):
    """A partition for each folder two levels down, with all below it, and one
    for the files of each folder above those."""

    def __init__(self, base: str, roots: list[str] | None = None):
        self.base, self.roots = base, roots

    def partitions(self) -> list[Folder]:
        system, root = opened(self.base)
        found = [Folder("", False)] if self.roots is None or "" in self.roots else []
        for name in folders(system, root) if self.roots is None else filter(None, self.roots):
            found += [Folder(name, False), *(Folder(f"{name}/{below}", True) for below in folders(system, f"{root}/{name}"))]
        return found

    def read(self, folder: Folder | None) -> Iterator[pa.RecordBatch]:
        if folder is None:  # without roots there is no partition
            return
        system, root = opened(self.base)
        rows: list[tuple[str, int]] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])
            rows.clear()
            return made

        for file in files_below(system, f"{root}/{folder.path}".rstrip("/"), folder.deep):
            rows.append((file.path[len(root) :].lstrip("/"), file.size))
            if len(rows) == ROWS:
                yield batch()
        yield batch()


def folders(system, folder: str) -> list[str]:
    """The names of the folders right below one, drafts left out."""
    from pyarrow.fs import FileSelector, FileType

    found = system.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == FileType.Directory and f.base_name != DRAFTS)


def delete(system, root: str, row: dict) -> bool:
    """Delete a file; one that is gone is no error."""
    from pyarrow.fs import FileType

    there = system.get_file_info(f"{root}/{row['path']}").type == FileType.File
    if there:
        system.delete_file(f"{root}/{row['path']}")
    return there


def is_taken(system, root: str, row: dict) -> bool:
    from pyarrow.fs import FileType

    return system.get_file_info(f"{root}/{row['path']}").type != FileType.NotFound


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> FilesReader:
        roots = self.options.get("roots")
        return FilesReader(self.options["path"], None if roots is None else json.loads(roots))


def list_vault(spark: SparkSession, base: str, roots: tuple[str, ...] | None = None) -> DataFrame:
    """(path, size) of all files below a folder, or of those below the
    ``roots`` in it, where an empty name stands for its own files; a missing
    folder has none."""
    spark.dataSource.register(VaultSource)
    read = spark.read.format(NAME)
    return (read if roots is None else read.option("roots", json.dumps(roots))).load(base)


def read_texts(files: DataFrame, base: str) -> DataFrame:
    """(path, text) of files (path) below a folder.  Paths are few bytes and are
    dealt anew, as a folder of many files is listed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(base)
        for batch in batches:
            paths, texts, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}") as file:
                    texts.append(file.read())
                paths.append(path)
                held += len(texts[-1])
                if held >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], ["path", "content"])
                    paths, texts, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], ["path", "content"])

    found = files.select("path").repartition("path").mapInArrow(run, "path string, content binary")
    return found.select("path", F.col("content").cast("string").alias("text"))


def take_in(files: DataFrame, source_base: str, base: str, move: bool = False, replace: bool = False) -> None:
    """Copy files (path below ``base``, source below ``source_base``) to their
    places, or move them.  Two files with one place, and without ``replace`` a
    place that is taken, are errors that leave all as it was; an empty table
    does nothing; other columns are not read."""

    def fill(out, row: dict) -> None:
        system, root = opened(source_base)
        with system.open_input_stream(f"{root}/{row['source']}") as file:
            while block := file.read(BLOCK):
                out.write(block)

    def check(made: DataFrame) -> None:
        if not made.groupBy("path").count().where("count > 1").isEmpty():
            raise ValueError("two files have one place")
        if not replace and (n := run_on(made, base, is_taken)):
            raise FileExistsError(f"{n} places are taken")

    made = bring_in(files.select("path", "source"), base, fill, check)
    if move:
        run_on(made.select(F.col("source").alias("path")), source_base, delete)


def seed(spark: SparkSession, seeds: str, base: str) -> None:
    """Copy all files of ``seeds`` to the same places below ``base``; those
    that are there already are replaced, others stay."""
    files = list_vault(spark, seeds)
    take_in(files.select("path", F.col("path").alias("source")), seeds, base, replace=True)


def is_wiped(path: Column, roots: tuple[str, ...] = ROOTS) -> Column:
    """Whether a wipe removes a file: notes, and sidecars, at any depth below a root."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    sidecar = name.startswith(".") & name.endswith(SUFFIX)
    return (F.size(parts) > 1) & parts[0].isin(*roots) & (name.endswith(".md") | sidecar)


def wipe(spark: SparkSession, base: str, force: bool = False, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """(path, size) of the notes and sidecars below the roots, which only
    ``force`` deletes.  Folders, and files of other kinds, stay."""
    found = list_vault(spark, base).where(is_wiped(F.col("path"), roots))
    if not force:
        return found
    kept = work_folder(spark, "wiped")
    found.write.parquet(kept)
    targets = spark.read.schema(found.schema).parquet(kept)
    run_on(targets, base, delete)  # a task that runs twice finds nothing left to do
    return targets
