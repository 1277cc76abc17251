"""Readers of notes, sidecars, terms and paged files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ROOTS, display_title, parse_aliases, parse_tags, stem
from .sidecar_files import NAME as SIDECARS
from .sidecar_files import register
from .vault import list_vault, read_texts

#: Files and folders below a root that Spark's readers skip, and so no notes.
HIDDEN = "/([.]|_[^/=]*(/|$))"

#: Sidecars of notes and of chunked sources; which one a file is, ``chunks`` tells.
SIDECAR = "source_file string, type string, content_hash string, vector array<double>, embedded_at string, chunking struct<chunk_tokens:int,chunk_overlap:double>, chunks array<struct<chunk_id:int,page:int,char_start:int,char_end:int,text:string,vector:array<double>>>, _corrupt_record string"


def read_notes(spark: SparkSession, base: str, roots: tuple[str, ...] = ROOTS) -> DataFrame:
    """(source_file, root, stem, text, tags) of the ``*.md`` files at any depth
    under the roots; other folders are not read.  Tasks list the folders and
    read the files, so the driver holds no list of them."""
    path = F.col("path")
    found = list_vault(spark, base, roots).where(path.endswith(".md") & ~path.rlike(HIDDEN))
    rows = read_texts(found, base).withColumnRenamed("path", "source_file")
    return rows.select("source_file", F.split("source_file", "/")[0].alias("root"), stem(F.col("source_file")).alias("stem"), "text", parse_tags(F.col("text")).alias("tags"))


def read_sidecars(spark: SparkSession, base: str) -> DataFrame:
    """Sidecars as rows with doc_kind (note, chunked or unreadable); a file that
    is no JSON is kept as unreadable.  Tasks list and read the files, a folder each."""
    register(spark)
    files = spark.read.format(SIDECARS).load(base)
    parsed = files.withColumn("r", F.from_json("json", SIDECAR, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).select("sidecar", "r.*")
    kind = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.col("chunks").isNotNull(), "chunked").otherwise("note")
    return parsed.withColumn("doc_kind", kind)


def read_glossary(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, display, aliases, text) of a glossary folder's terms; README.md
    and files that begin with ``_`` are none."""
    path = F.col("path")
    found = list_vault(spark, folder, ("",)).where(path.endswith(".md") & (path != "README.md") & ~path.rlike("^[._]"))
    rows = read_texts(found, folder).withColumnRenamed("path", "file")
    slug = stem(F.col("file"))
    return rows.select(slug.alias("slug"), display_title(F.col("text"), slug).alias("display"), parse_aliases(F.col("text")).alias("aliases"), "text")


def note_at(notes: DataFrame, path: str) -> DataFrame:
    """One note by its path; a path that leaves the folder is refused."""
    clean = os.path.normpath(path)
    if clean.startswith(("..", "/")):
        raise ValueError(f"{path!r} is outside")
    return notes.where(F.col("source_file") == clean)


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf", newest_first: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """(name, modified, size) of a folder's files, a page at a time.  A folder
    that may not be read is an error, an empty one is empty."""
    local = folder.removeprefix("file://")
    if "://" not in local and not os.access(local, os.R_OK | os.X_OK):
        raise PermissionError(f"{folder} can't be read")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    order = [F.col("modified").desc(), F.col("name").desc()] if newest_first else [F.lower("name"), F.col("name")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def resolve_folder(folder: str, base: str) -> str:
    """``~`` expanded, a relative folder taken from ``base``."""
    path = Path(folder).expanduser()
    return str(path if path.is_absolute() else Path(base) / path)


def inside(path: str, *folders: str) -> bool:
    """Whether a local path lies in one of the folders, links followed."""
    real = Path(path).resolve()
    return any(real.is_relative_to(Path(f).resolve()) for f in folders)


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, page, text) of PDF files; needs the pypdf package."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf package") from e

    def pages(batches):
        import io

        import pyarrow as pa
        from pypdf import PdfReader

        for batch in batches:
            for row in batch.to_pylist():
                texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(row["content"])).pages]
                yield pa.RecordBatch.from_pydict({"source_file": [row["path"]] * len(texts), "page": list(range(1, len(texts) + 1)), "text": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(pages, "source_file string, page long, text string")
