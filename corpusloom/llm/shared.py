"""Helpers the operators share: the folder every node sees, tables written
there, and a bounded prefilter for semi-joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the bits in a membership bitmap.  The bitmap is at most
#: 2**MEMBER_BITS / 8 bytes (16 MiB) whatever the input, so it may be broadcast.
MEMBER_BITS = 27

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one is set only
    where the session has none and its tasks all run in this process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes see")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)
        _written[:] = [w for w in _written if w[1] != df.scratch_path]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def member_bitmap(ids: DataFrame, *columns: str) -> DataFrame:
    """Rows (bucket, bits): a bitmap of the hashes of ``columns``; at most
    2**MEMBER_BITS / 32768 rows of 4 KiB."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(1 << MEMBER_BITS))
    return (
        ids.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )


def _flagged(df: DataFrame, ids: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df`` with a column ``name``: whether its ``columns`` may occur in ``ids``."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(1 << MEMBER_BITS))
    bucket, bits = free_name(df, "_bucket"), free_name(df, "_bits")
    bitmap = member_bitmap(ids, *columns).withColumnsRenamed({"bucket": bucket, "bits": bits})
    position = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(1) != 0, F.lit(False))
    joined = df.withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), bucket, "left")
    return joined.withColumn(name, hit).drop(bucket, bits)


def maybe_in(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``df`` whose ``columns`` may occur in ``ids``: all that do, and
    few others.  The broadcast side is a bitmap of at most 16 MiB, so no row of
    ``df`` is shuffled.  Use it before an exact join to keep the rest at home.
    """
    hit = free_name(df, "_hit")
    return _flagged(df, ids, hit, *columns).where(hit).drop(hit)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name.lower() in map(str.lower, df.columns):
        name = "_" + name
    return name


def split_by(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``column`` is surely not in ``ids``, which stay
    where they are, and the others."""
    hit = free_name(df, "hit")
    flagged = _flagged(df, ids, hit, column)
    return flagged.where(~F.col(hit)).drop(hit), flagged.where(hit).drop(hit)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark send at most ``rows`` rows at once to Python from now on, for
    texts may be long; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def parts(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and, but for single rows,
    ``size`` bytes of the column ``text``, so that long texts don't add up."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


_owner: tuple[str, Callable[[], None] | None] = ("", None)


def lean(name: str, forget: Callable[[], None] | None = None):
    """For functions of mapInArrow: a worker process that comes from another
    operator first drops what it remembers for that one, and after each task
    gives free memory back; Spark keeps idle workers beside its own heap."""

    def wrap(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            global _owner
            if _owner[0] != name:
                if _owner[1]:
                    _owner[1]()
                _owner = (name, forget)
                trim()
            yield from run(batches)
            trim()

        return leaner

    return wrap


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
