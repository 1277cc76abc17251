"""Exact and approximate nearest vectors by cosine distance; for a stored index see :mod:`.cells`."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
#: What packed values begin with.
WHOLE, AS_THEY_ARE = b"whole  .", b"as is  ."
#: Vectors in a block; a task multiplies two blocks.
BLOCK = 2048


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def in_blocks(df: DataFrame, id_: str, vector: str, names: tuple[str, str, str], size: int = BLOCK, stored: bool = False) -> DataFrame:
    """Rows (block, ids, matrix): bounded groups of vectors as arrays; to be
    ``stored``, only those that have a direction, as :func:`packed`."""
    block, ids, matrix = names
    bytes_of = packed if stored else np.ndarray.tobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held_ids, held = TaskContext.get().partitionId(), 0, [], []

        def row():
            nonlocal made
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([held_ids], pa.list_(pa.int64())), pa.array([bytes_of(np.concatenate(held))], pa.binary())], [block, ids, matrix])
            made += 1
            return out

        # Null vectors go here: a filter in the plan would make the others twice.
        for batch in (b.filter(b.column(1).is_valid()) for b in batches):
            for at in range(0, batch.num_rows, size):
                cut = batch.slice(at, size)
                n, own, flat = cut.num_rows, cut.column(0).to_pylist(), cut.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if stored:
                    fine = with_direction(flat.reshape(n, -1))
                    n, own, flat = len(fine), [own[i] for i in fine], flat.reshape(n, -1)[fine].ravel()
                if held_ids and len(held_ids) + n > size:
                    yield row()
                    held_ids, held = [], []
                if n:
                    held_ids = held_ids + own
                    held.append(flat)
        if held_ids:
            yield row()

    return df.select(F.col(id_).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, f"{block} long, {ids} array<long>, {matrix} binary")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rounded cosine distances of all rows of ``x`` to all of ``y``; infinite where a vector has no direction."""
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.round(1 - (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :], DIGITS)
    return np.where(np.isnan(d), np.inf, d)


def nearest(queries: DataFrame, base: DataFrame, k: int | None, query_id: str = "query_id", base_id: str = "id", vector: str = "vector", exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest base vectors of every query, or all of them without
    ``k``: (query_id, rank, id, distance), distance rounded, ties by id.

    Blocks of queries meet blocks of vectors, each pair keeps its own k best,
    and the best of those are ranked; no pair of vectors leaves its task.
    """
    q = in_blocks(queries, query_id, vector, ("qb", "qids", "qm"))
    b = in_blocks(base, base_id, vector, ("bb", "bids", "bm"))
    found = each_with_each(q, b, "qb", "bb", base.count(), queries.count()).select("qids", "qm", "bids", "bm").mapInArrow(meeting(k, exclude_self), FOUND)
    return best(found, k)


def each_with_each(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n: int, n_left: int = 1) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``, both blocks of
    bounded size.  Blocks of ``n`` vectors are dealt to as many tasks as a
    shuffle has partitions, or fewer for few.  The tasks are a grid: a block of
    either side visits those of its row or column, so with many blocks of
    ``n_left`` vectors on the left each is copied about as often as the root of
    the tasks.  Neither side is broadcast, whatever its size is taken for, and
    a block is made once; the right side stays while the left passes."""
    tasks = max(1, min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * n // BLOCK))
    rows = max(1, min(math.isqrt(tasks), -(-n_left // BLOCK)))
    columns = -(-tasks // rows)
    at = lambda id_, groups: F.pmod(F.xxhash64(id_), F.lit(groups)).cast("int")
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    key = ["_row", "_column"]
    visiting = left.withColumn("_row", at(left_id, rows)).withColumn("_column", each(columns))
    staying = right.withColumn("_column", at(right_id, columns)).withColumn("_row", each(rows))
    return visiting.repartition(*key).join(staying.repartition(*key).hint("shuffle_hash"), key).drop(*key)


FOUND = "query_id long, id long, distance double"


def meeting(k: int | None, exclude_self: bool = False):
    """For mapInArrow, over rows (qids, qm, bids, bm) of a block of queries and
    a block of vectors: the ``k`` nearest for each query, or all.

    Rows of one block of queries come one after another; what it has found so
    far tells which vectors of the next block can matter, and only its best of
    all are given out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                qi, qm, bi, bm = (batch.column(i)[at] for i in range(4))
                qi, bi = (x.values.to_numpy(zero_copy_only=False) for x in (qi, bi))
                key = (qi.tobytes(), qm.as_buffer())
                if now is None or now[0] != key[0] or not now[1].equals(key[1]):
                    if met is not None:
                        yield met.found()
                    now, met = key, Met(qi.copy(), np.frombuffer(qm.as_buffer()).reshape(len(qi), -1), k, exclude_self)
                met.add(bi, np.frombuffer(bm.as_buffer()).reshape(len(bi), -1))
                if k is None:
                    yield met.found()
                    now, met = None, None
        if met is not None:
            yield met.found()

    return run


class Met:
    """A block of queries and the ``k`` nearest vectors that it has met.

    One product in single precision tells which pairs may count: those whose
    cosine is within its error of the k-th best.  Only their distances are taken
    in double precision, by the formula of :func:`distances`."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int | None, exclude_self: bool, most: np.ndarray | None = None):
        self.ids, self.x, self.k, self.exclude_self = ids, x, k, exclude_self
        self.norm, self.unit = directions(x)
        self.slack = (x.shape[1] + 8) * 2.0**-23 + 10.0**-DIGITS
        self.most = np.full(len(ids), np.inf) if most is None else most.copy()  # the k-th distance so far
        self.row, self.id, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, y: np.ndarray, who: np.ndarray | None = None) -> None:
        """Meet vectors, all queries or those at the places ``who``."""
        who = np.arange(len(self.ids)) if who is None else who
        norm, unit = directions(y)
        cosine = self.unit[who] @ unit.T
        if not np.isfinite(cosine[:, 0].sum() + cosine[:1].sum()):  # a vector without a direction
            cosine[~np.isfinite(cosine)] = -np.inf
        if self.exclude_self and np.isin(ids, self.ids[who]).any():
            cosine[self.ids[who][:, None] == ids[None, :]] = -np.inf
        least = (1 - self.most[who] - self.slack).astype(np.float32)
        if self.k is not None and self.k < len(ids) and (new := np.flatnonzero(np.isinf(least))).size:
            at = len(ids) - self.k
            least[new] = np.partition(cosine[new], at, axis=1)[:, at] - np.float32(2 * self.slack)
        row, at = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))
        row = who[row]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            d = np.concatenate([np.round(1 - np.einsum("ij,ij->i", self.x[r], y[c]) / self.norm[r] / norm[c], DIGITS) for r, c in zip(cuts(row), cuts(at), strict=True)] or [np.zeros(0)])
        fine = np.isfinite(d)
        self.row, self.id, self.distance = np.concatenate([self.row, row[fine]]), np.concatenate([self.id, ids[at[fine]]]), np.concatenate([self.distance, d[fine] + 0.0])
        if self.k is not None:
            self.keep()

    def keep(self) -> None:
        order = np.lexsort((self.id, self.distance, self.row))
        row = self.row[order]
        start = np.searchsorted(row, np.arange(len(self.ids)))
        order = order[np.arange(len(row)) - start[row] < self.k]
        self.row, self.id, self.distance = self.row[order], self.id[order], self.distance[order]
        n = np.bincount(self.row, minlength=len(self.ids))
        full = n == self.k
        self.most[full] = self.distance[np.cumsum(n)[full] - 1]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.distance)], ["query_id", "id", "distance"])


#: Pairs whose distances are taken at once.
PAIRS = 1 << 17


def cuts(x: np.ndarray) -> list[np.ndarray]:
    return [x[i : i + PAIRS] for i in range(0, len(x), PAIRS)]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and vectors of length one in single precision; not finite without a direction."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        norm = np.linalg.norm(x, axis=1)
        return norm, (x / norm[:, None]).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """Values as bytes: as whole numbers where all have at most DIGITS decimals, else as they are."""
    with np.errstate(over="ignore"):
        whole = np.rint(x * 10.0**DIGITS)
    if (np.abs(whole) < 2**31).all() and (whole / 10.0**DIGITS == x).all():
        return WHOLE + whole.astype(np.int32).tobytes()
    return AS_THEY_ARE + x.tobytes()


def unpacked(values: pa.BinaryScalar | bytes, n: int) -> np.ndarray:
    """``n`` rows of what :func:`packed` gave."""
    data = memoryview(values if isinstance(values, bytes) else values.as_buffer())
    if data[: len(WHOLE)] == WHOLE:
        return (np.frombuffer(data[len(WHOLE) :], np.int32) / 10.0**DIGITS).reshape(n, -1)
    return np.frombuffer(data[len(WHOLE) :]).reshape(n, -1)


def with_direction(x: np.ndarray) -> np.ndarray:
    """The places of the rows that have a direction; no other is near anything."""
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.linalg.norm(x, axis=1)
    return np.flatnonzero(np.isfinite(norm) & (norm > 0))


def before(mine: np.ndarray, own: np.ndarray, theirs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of ``ids``, at distances ``theirs``, come before each of ``own``,
    at ``mine``, for each query (a row): the nearer ones, and of equal distance those with a smaller id."""
    (n, m), order = mine.shape, np.unique(np.concatenate([own, ids]), return_inverse=True)[1]
    size = m + len(ids)
    span = (2 * 10**DIGITS + 3) * size  # distances are at most 2
    key = lambda d, at: np.rint(np.minimum(d, 2 + 2 * 10.0**-DIGITS) * 10**DIGITS).astype(np.int64) * size + at
    offset = np.arange(n)[:, None]
    keys = key(mine, order[:m])
    places = np.argsort(keys, axis=1, kind="stable")
    at = np.searchsorted((np.take_along_axis(keys, places, axis=1) + offset * span).ravel(), (key(theirs, order[m:]) + offset * span).ravel(), side="right").reshape(n, -1) - offset * m
    met = np.bincount((at + offset * (m + 1)).ravel(), minlength=n * (m + 1)).reshape(n, m + 1).cumsum(axis=1)[:, :m]
    out = np.empty((n, m), np.int64)
    np.put_along_axis(out, places, met, axis=1)
    return out


def best(found: DataFrame, k: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    found = found.withColumn("rank", rank)
    return (found if k is None else found.where(F.col("rank") <= k)).select("query_id", "rank", "id", "distance")


def ranks_among(queries: DataFrame, some: DataFrame, others: DataFrame, query_id: str = "query_id", base_id: str = "id", vector: str = "vector") -> DataFrame:
    """The rank that every vector of ``some`` has for each query among those of
    ``some`` and ``others`` together: (query_id, rank, id, distance), as
    :func:`nearest` over all of them would give.

    A block of ``others`` only counts how many of its vectors come before each
    of ``some``; no other vector is listed, and none is left out.
    """
    own = nearest(queries, some, None, query_id, base_id, vector)
    q = in_blocks(queries, query_id, vector, ("qb", "qids", "qm"))
    s = in_blocks(some, base_id, vector, ("sb", "sids", "sm"))
    asked = each_with_each(q, s, "qb", "sb", some.count()).withColumn("ab", F.struct("qb", "sb"))
    b = in_blocks(others, base_id, vector, ("bb", "bids", "bm"))
    met = each_with_each(asked, b, "ab", "bb", others.count()).select("qids", "qm", "sids", "sm", "bids", "bm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, si, bi = (np.array(row[name], dtype=np.int64) for name in ("qids", "sids", "bids"))
                x, y, z = (np.frombuffer(row[name]).reshape(len(ids), -1) for name, ids in (("qm", qi), ("sm", si), ("bm", bi)))
                mine, theirs = distances(x, y), distances(x, z)
                ids, is_mine = np.concatenate([si, bi]), np.arange(len(si) + len(bi)) < len(si)
                for i, asked_by in enumerate(qi):
                    order = np.lexsort((ids, np.concatenate([mine[i], theirs[i]])))
                    at = np.flatnonzero(is_mine[order])
                    before = at - np.arange(len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), asked_by)), pa.array(ids[order[at]]), pa.array(before.astype(np.int64))], ["query_id", "id", "before"])

    before = met.mapInArrow(run, "query_id long, id long, before long").groupBy("query_id", "id").agg(F.sum("before").alias("before"))
    rank = (F.col("rank") + F.coalesce("before", F.lit(0))).cast("int").alias("rank")
    return own.join(before, ["query_id", "id"], "left").select("query_id", rank, "id", "distance")


def nearest_lsh(queries: DataFrame, base: DataFrame, k: int, query_id: str = "query_id", base_id: str = "id", vector: str = "vector", bits: int = 8, tables: int = 12, dim: int = 64, seed: int = 7) -> DataFrame:
    """As :func:`nearest`, among vectors that share a bucket of random
    hyperplanes; every row is indexed, some true neighbours may be missed."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            code = (np.einsum("nd,tbd->ntb", x, planes) > 0) @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.list_(pa.int64()))], ["id", "vector", "buckets"])

    def coded(df: DataFrame, id_: str, names: tuple[str, str]) -> DataFrame:
        rows = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        rows = rows.mapInArrow(run, "id long, vector array<double>, buckets array<long>")
        return rows.select(F.col("id").alias(names[0]), F.col("vector").alias(names[1]), F.explode("buckets").alias("bucket"))

    q, b = coded(queries, query_id, ("query_id", "qv")), coded(base, base_id, ("id", "bv"))
    met = q.join(b, "bucket").dropDuplicates(["query_id", "id"]).select("query_id", "id", F.round(cosine_distance(F.col("qv"), F.col("bv")), DIGITS).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
