"""Codes of vectors: product quantisation in whole numbers.

Vectors are cut into parts, each with a codebook of few entries.  In a round
every task finds the nearest entry of each part in a kd-tree of the codebook,
which travels with the task, and sums the parts by entry; the sums of all tasks
are added up and give the next entries.  All of it is exact, so that the codes
don't depend on how the rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries in a leaf of a tree.
LEAF = 2
#: Labels whose sums are sent to every task (some 16 bytes each); with more of them the rows are shuffled.
LABELS = 200_000
#: Parts that the rows of one label are dealt to where they are shuffled.
SALTS = 64


class KdTree:
    """The entries of one codebook, split at the median of their widest
    dimension; every node knows the box around its entries."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.members: list[np.ndarray | None] = []  # of a leaf, ascending
        self.dim: list[int] = []
        self.cut: list[int] = []
        self.child: list[tuple[int, int]] = []
        self._add(np.arange(len(entries)), leaf)

    def _add(self, members: np.ndarray, leaf: int) -> int:
        at, own = len(self.low), self.entries[members]
        low, high = own.min(axis=0), own.max(axis=0)
        dim = int(np.argmax(high - low))
        for column, value in ((self.low, low), (self.high, high), (self.members, None), (self.dim, dim), (self.cut, 0), (self.child, (at, at))):
            column.append(value)
        values = np.sort(own[:, dim])
        cut = int(values[(len(values) - 1) // 2])
        right = own[:, dim] > cut
        if len(members) <= leaf or not right.any():
            self.members[at] = members
        else:
            self.cut[at] = cut
            self.child[at] = self._add(members[~right], leaf), self._add(members[right], leaf)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row of ``x``; of equally near
        entries the one with the lowest index."""
        n = len(x)
        dim, cut, child, inner = np.array(self.dim), np.array(self.cut), np.array(self.child), np.array([m is None for m in self.members])
        rows, home = np.arange(n), np.zeros(n, np.int64)
        best, entry = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        while inner[home].any():
            home = child[home, (x[rows, dim[home]] > cut[home]).astype(np.int64)]

        def measure(node: int, rows: np.ndarray) -> None:
            members = self.members[node]
            d = ((x[rows, None, :] - self.entries[members]) ** 2).sum(axis=2)
            first = d.argmin(axis=1)
            d, index = d[np.arange(len(rows)), first], members[first]
            better = (d < best[rows]) | ((d == best[rows]) & (index < entry[rows]))
            best[rows[better]], entry[rows[better]] = d[better], index[better]

        def visit(node: int, rows: np.ndarray) -> None:
            own = x[rows]
            bound = (np.maximum(np.maximum(self.low[node] - own, own - self.high[node]), 0) ** 2).sum(axis=1)
            rows = rows[bound <= best[rows]]  # an equal bound may hold a lower index
            if self.members[node] is not None:
                rows = rows[home[rows] != node]
                if len(rows):
                    measure(node, rows)
            elif len(rows):
                for c in self.child[node]:
                    visit(c, rows)

        for node in np.flatnonzero(~inner).tolist():
            if len(at := np.flatnonzero(home == node)):
                measure(node, at)
        if n and inner[0]:
            visit(0, rows)
        return entry, best


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers): the vectors of a batch without nulls and non-finite
    components, as rows of whole numbers floor(SCALE * x)."""
    lists = vectors.slice(0)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum()))
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~np.isfinite(values), len(sizes)) > 0
    keep = ~bad & lists.is_valid().to_numpy(zero_copy_only=False)
    values = values[np.repeat(keep, sizes)]
    of = set(sizes[keep].tolist())
    if len(of) > 1:
        raise ValueError(f"vectors have several lengths: {sorted(of)[:5]}")
    dim = of.pop() if of else 0
    scaled = np.floor(values * SCALE).reshape(int(keep.sum()), dim)
    if scaled.size and np.abs(scaled).max() > math.isqrt((1 << 61) // dim):
        raise ValueError("a component is too large for distances of 64 bits")
    return np.flatnonzero(keep), scaled.astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """entries[part][index][position], whole numbers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[KdTree]:
        return [KdTree(book) for book in self.entries]

    def of(self, numbers: np.ndarray) -> list[np.ndarray]:
        """``numbers``, rows of vectors, cut into parts."""
        parts, _, width = self.entries.shape
        if numbers.shape[1] != parts * width:
            raise ValueError(f"a vector has {numbers.shape[1]} components, not {parts * width}")
        return [numbers[:, p * width : (p + 1) * width] for p in range(parts)]

    def encode(self, numbers: np.ndarray, trees: list[KdTree]) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, squared distances) of rows of vectors, a column per part."""
        found = [tree.nearest(part) for tree, part in zip(trees, self.of(numbers), strict=True)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def decode(self, indexes: np.ndarray) -> np.ndarray:
        """The vectors that rows of indexes stand for."""
        return np.concatenate([book[indexes[:, p]] for p, book in enumerate(self.entries)], axis=1) / SCALE


def is_whole(vector: Column) -> Column:
    """Whether a vector has a value and no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def first_codebooks(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; null without any."""
    fine = vectors.where(is_whole(F.col(vector))).select(F.col(id_).alias("id"), F.col(vector).alias("vector"))
    seeds = fine.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow()
    if not seeds.num_rows:
        return None
    _, numbers = whole(seeds.column("vector").combine_chunks())
    dim = numbers.shape[1]
    if not dim or dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    return Codebooks(np.ascontiguousarray(numbers.reshape(len(numbers), parts, dim // parts).transpose(1, 0, 2)))


def next_codebooks(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> Codebooks:
    """One round: every part goes to its nearest entry, and an entry becomes
    the mean of its parts, rounded down; entries without parts stay.  A task
    gives one row per component of the codebooks, whatever it reads, and so
    many reach the driver."""
    shape = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, trees = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64), books.trees()
        for batch in batches:
            _, numbers = whole(batch.column(0))
            if len(numbers):
                indexes, _ = books.encode(numbers, trees)
                for p, part in enumerate(books.of(numbers)):
                    np.add.at(sums[p], indexes[:, p], part)
                    counts[p] += np.bincount(indexes[:, p], minlength=shape[1])
        place = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), shape[2]))], ["place", "total", "n"])

    rows = vectors.select(vector).mapInArrow(run, "place long, total long, n long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy().ravel()
    for place, total, n in rows.where("n > 0").collect():
        entries[place] = int(total) // n
    return Codebooks(entries.reshape(shape))


def fit_codebooks(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors; null without any."""
    books = first_codebooks(vectors, id_, vector, parts, entries)
    if books is not None:
        for _ in range(rounds):
            books = next_codebooks(vectors, books, vector)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, code, error) of every vector: two hex digits per part, and
    the squared distances to the entries added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for batch in batches:
            places, numbers = whole(batch.column(2))
            if len(places):
                indexes, distances = books.encode(numbers, trees)
                codes = indexes.astype(np.uint8).tobytes().hex()
                size = 2 * indexes.shape[1]
                kept = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([codes[i : i + size] for i in range(0, len(codes), size)]), pa.array(distances.sum(axis=1))], ["id", "label", "code", "error"])

    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector))
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, label {kind}, code string, error long")


def with_label_error(codes: DataFrame, labels: int = LABELS, salts: int = SALTS) -> DataFrame:
    """``codes`` with label_error: the error summed over the rows of one label,
    nulls together.  The sums are sent to all tasks if there are few; else
    the rows of a label are dealt to several tasks, each with a copy of its sum."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(labels + 1).count() <= labels:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salt = free_name(codes, "salt")
    copies = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = codes.withColumn(salt, F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
    return dealt.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col(salt) == F.col("copy"))).drop("of", "copy", salt)


def compress(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all vectors: (vec_id, code, error, label_error,
    codebooks_sha256), a row for each that is kept.

    Vectors that are null or hold null or non-finite components are dropped.
    With fewer vectors than ``entries`` the codebooks have one entry for each.
    Repeated rows stay, each with its code; among rows of one id the smaller
    vector comes first, a null id after all.  A null label is a label.  An
    empty table gives no rows; other columns are not read.  Vectors of
    different lengths, of a length that can't be cut into equal parts, or with
    components whose distances don't fit 64 bits (over some 40,000 in size) are an error.

    The codebooks, ``parts`` x ``entries`` short rows, are all that reaches
    the driver; ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    books = fit_codebooks(vectors, id_, vector, parts, entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = materialize(encode(vectors, books, id_, vector, label), "codes")
    return with_label_error(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
