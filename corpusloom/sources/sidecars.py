"""Sidecar files: vectors beside their sources, as JSON that is the same byte for
byte whenever source, backend and parameters are."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sidecar_path
from .sidecar_files import bring_in, register

CHUNK_FIELDS = ("chunk_id", "page", "char_start", "char_end", "text", "vector")
#: Fixed value: how a time is written.
STAMP = "%Y-%m-%dT%H:%M:%SZ"


def rendered(payload: dict, embedded_at) -> str:
    """A sidecar's text; the fields' names and order and the indent are fixed values."""
    if embedded_at is not None:
        payload["embedded_at"] = embedded_at.astimezone(timezone.utc).strftime(STAMP)
    return json.dumps(payload, indent=2) + "\n"


def note_sidecars(rows: DataFrame) -> DataFrame:
    """(path, content) of the sidecars of vector rows (source_file, backend,
    content_hash, vector, embedded_at); a null time is left out."""
    asked = rows.select(sidecar_path(F.col("source_file")).alias("path"), "source_file", "backend", "content_hash", "vector", "embedded_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rendered({"source_file": r["source_file"], "type": r["backend"], "content_hash": r["content_hash"], "vector": r["vector"]}, r["embedded_at"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["path", "content"])

    return asked.mapInArrow(run, "path string, content string")


def chunk_sidecars(rows: DataFrame) -> DataFrame:
    """(path, content) of the sidecars of passage rows as
    :func:`corpusloom.api.ingest_paged_source` gives them, one per source.

    A source's passages meet in one row, as they do in its file.
    """
    source = ["source_file", "backend", "content_hash", "chunk_tokens", "chunk_overlap"]
    stamp = F.max("embedded_at") if "embedded_at" in rows.columns else F.lit(None).cast("timestamp")
    whole = rows.groupBy(*source).agg(F.sort_array(F.collect_list(F.struct(*CHUNK_FIELDS))).alias("chunks"), stamp.alias("embedded_at"))
    asked = whole.select(sidecar_path(F.col("source_file"), keep_suffix=True).alias("path"), *source, "chunks", "embedded_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (r,) = batch.slice(at, 1).to_pylist()
                how = {"chunk_tokens": r["chunk_tokens"], "chunk_overlap": r["chunk_overlap"]}
                made = rendered({"source_file": r["source_file"], "type": r["backend"], "content_hash": r["content_hash"], "chunking": how, "chunks": r["chunks"]}, r["embedded_at"])
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([made])], ["path", "content"])

    return asked.mapInArrow(run, "path string, content string")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) below a folder that all nodes see, all files or
    none: they get their places when every task has done its part.  Gives
    (path, n_bytes) of what was written."""
    rows = files.select("path", "content")
    register(files.sparkSession)
    bring_in(rows, root, lambda out, row: out.write(row["content"].encode()))
    return rows.select("path", F.octet_length("content").cast("long").alias("n_bytes"))
