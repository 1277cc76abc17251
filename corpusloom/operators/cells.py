"""An inverted file of vectors: cells around centroids, of which a query reads few.

Every vector lies in the cell of the nearest centroid.  A cell knows how far it
reaches, so a query can leave out the cells whose nearest point lies beyond
what it has found: that search is exact.  With ``probes`` it reads so many of
the nearest cells instead and may miss neighbours elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import HELD, slices, small_batches
from .vectors import BLOCK, DIGITS, FOUND, Met, before, best, directions, distances, in_blocks, packed, ranks_among, unpacked, with_direction

#: Cells of an index: the root of the number of vectors, but not so many that a cell has
#: fewer than these on average; the centroids, which travel with every task, have a bound.
CELL, MOST_CELLS = 16, 4096
#: Vectors that a centroid is taught by, on average; a sample by the ids' hashes. All vectors are indexed.
TAUGHT_BY = 200
ROUNDS = 5
#: Vectors that tell how many cells to read, and what is added to the share they are to find.
TUNED_BY, MARGIN = 256, 0.03
#: Distances are rounded, so a cell counts if it may reach so near.
SLACK = 10.0**-DIGITS

#: Buckets that the cells' blocks are dealt to; a query is sent to each at most once.
BUCKETS = 32
#: Queries that every task holds beside the cells, which stay where they are; more are sent to the cells' buckets.
FEW = BLOCK
VISITS = "bucket int, n long, qids array<long>, qm binary, bounds binary, cells array<int>, marks binary"

Put = Callable[[str, DataFrame], DataFrame]


@dataclass(frozen=True)
class VectorIndex:
    """``centroids`` (cell, centroid, reach, groups, n) and ``cells`` (cell,
    grp, ids, matrix): blocks of at most some thousand vectors, packed."""

    centroids: DataFrame
    cells: DataFrame

    def nearest(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector", exclude_self: bool = False, probes: int | None = None) -> DataFrame:
        """As :func:`.vectors.nearest`: (query_id, rank, id, distance).  Exact,
        or among the ``probes`` nearest cells."""
        known = Centroids.read(self.centroids)
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
        if probes is None and len(known.cells) == 1:
            probes = 1
        if (few := held(asked)) is not None:
            return self._beside(known, *few, k, exclude_self, probes)
        if probes is not None:
            return best(self._met(asked.withColumn("bound", F.lit(None).cast("double")), known.first(probes), k, exclude_self), k)
        # The k-th distance in the nearest cell bounds how far other cells matter.
        near = self._met(asked.withColumn("bound", F.lit(None).cast("double")), known.first(1), k, exclude_self)
        bound = best(near, k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
        far = self._met(asked.join(bound, "query_id", "left"), known.others(), k, exclude_self)
        return best(near.unionByName(far), k)

    def _beside(self, known: Centroids, ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool, probes: int | None) -> DataFrame:
        """:meth:`nearest` for a few queries, which go to the cells."""
        spark = self.cells.sparkSession
        if not len(ids) or not len(known.cells):
            return best(spark.createDataFrame([], FOUND), k)
        cosine = (x / np.linalg.norm(x, axis=1)[:, None]) @ known.points.T
        near = self._in_cells(known, ids, x, np.full(len(ids), np.inf), known.nearest(cosine, probes or 1), k, exclude_self)
        if probes is not None:
            return best(near, k)
        found = best(near, k).toArrow()  # at most FEW * k rows
        last = found.filter(pc.equal(found.column("rank"), k))
        bound = dict(zip(last.column("query_id").to_pylist(), last.column("distance").to_pylist()))
        bound = np.array([bound.get(i, np.inf) for i in ids.tolist()])
        far = self._in_cells(known, ids, x, bound, known.reaching(cosine, bound), k, exclude_self)
        return best(spark.createDataFrame(found.select(["query_id", "id", "distance"]), FOUND).unionByName(far), k)

    def _in_cells(self, known: Centroids, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, marked: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
        """The ``k`` nearest of each query in the cells that it has marked, once a task."""
        used = np.flatnonzero(marked.any(axis=0))
        places, marks = {c: i for i, c in enumerate(known.cells[used].tolist())}, marked[:, used]
        stored = self.cells if len(used) == len(known.cells) else self.cells.where(F.col("cell").isin(list(places)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = Met(ids, x, k, exclude_self, bound)
            for cell, own, y in blocks_of(batches):
                if cell in places:
                    met.add(own, y, np.flatnonzero(marks[:, places[cell]]))
            yield met.found()

        return stored.select("cell", "ids", "matrix").mapInArrow(run, FOUND)

    def ranks_among(self, queries: DataFrame, some: DataFrame, others: DataFrame, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """As :func:`.vectors.ranks_among`, where the index has the vectors of ``some`` and ``others``.
        Few of ``some`` and of the queries go to the cells, where the vectors before each are counted."""
        asked, own = held(queries.select(F.col(query_id).cast("long"), vector)), held(some.select(F.col("id").cast("long"), vector))
        if asked is None or own is None:
            return ranks_among(queries, some, others, query_id, "id", vector)
        (asked_ids, x), (own_ids, y) = asked, own
        names = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("before", pa.int64()), ("distance", pa.float64())])
        shape = "query_id long, id long, before long, distance double"
        spark = self.cells.sparkSession
        if not len(asked_ids) or not len(own_ids):
            return spark.createDataFrame([], shape).select("query_id", F.lit(0).alias("rank"), "id", "distance")
        mine = distances(x, y)
        pairs = [pa.array(np.repeat(asked_ids, len(own_ids))), pa.array(np.tile(own_ids, len(asked_ids)))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros(mine.shape, np.int64)
            for _, ids, z in blocks_of(batches):
                met += before(mine, own_ids, distances(x, z), ids)
            yield pa.RecordBatch.from_arrays([*pairs, pa.array(met.ravel()), pa.array(mine.ravel() + 0.0)], schema=names)

        met = self.cells.select("cell", "ids", "matrix").mapInArrow(run, shape).groupBy("query_id", "id").agg(F.sum("before").alias("before"), F.first("distance").alias("distance"))
        return met.select("query_id", (F.col("before") + 1).cast("int").alias("rank"), "id", "distance")

    def _met(self, asked: DataFrame, choose, k: int, exclude_self: bool) -> DataFrame:
        visits = asked.select("query_id", "vector", "bound").mapInArrow(choose, VISITS)
        stored = self.cells.withColumn("_bucket", F.pmod(F.col("cell") + F.col("grp"), F.lit(BUCKETS)))
        marked = (F.col("bucket") == F.col("_bucket")) & F.array_contains("cells", F.col("cell"))
        met = visits.join(stored.hint("shuffle_hash"), marked).select("qids", "qm", "bounds", "cells", "marks", "cell", "ids", "matrix")
        return met.mapInArrow(visiting(k, exclude_self), FOUND)

    def probes_for(self, vectors: DataFrame, k: int, recall: float = 0.9) -> int:
        """How many cells a query has to read to find a share of ``recall`` of
        its ``k`` neighbours: as many as vectors (id, vector) out of TUNED_BY,
        chosen by hash, need for a little more than that."""
        some = vectors.select(F.col("id").cast("long").alias("query_id"), F.col("vector").cast("array<double>")).orderBy(F.xxhash64("query_id"), "query_id").limit(TUNED_BY).persist()
        true = self.nearest(some, k, exclude_self=True).select("query_id", "id")
        homes = self.cells.select("cell", F.explode("ids").alias("id")).join(F.broadcast(true), "id")  # TUNED_BY * k rows
        near = homes.groupBy("query_id").agg(F.collect_list("cell").alias("homes")).join(some, "query_id").collect()
        some.unpersist()
        known, places = Centroids.read(self.centroids), []
        for r in near:
            order = known.cells[np.argsort(-(known.points @ np.array(r.vector)), kind="stable")].tolist()
            places += [order.index(c) for c in r.homes]
        if not places:
            return 1
        wanted = min(1.0, recall + MARGIN)
        return int(np.sort(places)[min(len(places) - 1, int(np.ceil(wanted * len(places))) - 1)]) + 1

    def work(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(probed, stored) as one row: pairs of a query and a cell that a
        search reads, and all that there are."""
        asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"), F.lit(None).cast("double").alias("bound"))
        known = Centroids.read(self.centroids)
        count = lambda rows: rows.select("n")
        shape = VISITS
        first = count(asked.mapInArrow(known.first(probes or 1), shape))
        if probes is None:
            bound = self.nearest(queries, k, probes=1).where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
            first = first.unionByName(count(asked.drop("bound").join(bound, "query_id", "left").select("query_id", "vector", "bound").mapInArrow(known.others(), shape)))
        probed = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("probed"))
        return probed.crossJoin(F.broadcast(asked.agg((F.count("*") * len(known.cells)).alias("stored"))))  # two single rows


@dataclass(frozen=True)
class Centroids:
    """The centroids as arrays; at most MOST_CELLS rows."""

    cells: np.ndarray
    points: np.ndarray
    reach: np.ndarray
    groups: np.ndarray

    @staticmethod
    def read(table: DataFrame) -> Centroids:
        rows = table.orderBy("cell").collect()
        return Centroids(np.array([r.cell for r in rows], dtype=np.int64), np.array([r.centroid for r in rows] or [[]], dtype=float), np.array([r.reach for r in rows]), np.array([r.groups for r in rows], dtype=np.int64))

    def visits(self, batch: pa.RecordBatch, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, n, qids, qm, bounds, cells, marks) of the cells that
        ``choose`` marks for each query, given its cosines to the centroids and
        its bound: a bucket of cells gets a query once, however many of them it
        visits.  ``n`` counts the visits to cells whose first group is there."""
        vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        ids = batch.column(0).to_numpy()
        norm = np.linalg.norm(vectors, axis=1)
        fine = np.flatnonzero(np.isfinite(norm) & (norm > 0))
        if not len(fine) or not len(self.cells):
            return
        cosine = (vectors[fine] / norm[fine, None]) @ self.points.T
        bound = batch.column(2).cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)[fine]
        marked = choose(cosine, bound)
        for bucket in range(BUCKETS):
            here = np.flatnonzero((bucket - self.cells) % BUCKETS < self.groups)
            own = marked[:, here]
            who, used = np.flatnonzero(own.any(axis=1)), own.any(axis=0)
            if len(who):
                marks, home = own[np.ix_(who, used)], self.cells[here[used]]
                n = int(marks[:, home % BUCKETS == bucket].sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), pa.array([ids[fine[who]].tolist()], pa.list_(pa.int64())), pa.array([vectors[fine[who]].tobytes()], pa.binary()), pa.array([bound[who].tobytes()], pa.binary()), pa.array([home.tolist()], pa.list_(pa.int32())), pa.array([marks.tobytes()], pa.binary())],
                    ["bucket", "n", "qids", "qm", "bounds", "cells", "marks"],
                )

    def nearest(self, cosine: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each query, marked."""
        marked = np.zeros(cosine.shape, bool)
        np.put_along_axis(marked, np.argsort(-cosine, axis=1, kind="stable")[:, :probes], True, axis=1)
        return marked

    def reaching(self, cosine: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """All cells but the nearest that may hold a vector within the bound:
        the angle to a cell's nearest point is at least that to its centroid
        less the cell's reach."""
        angle = np.arccos(np.clip(cosine, -1, 1)) - self.reach[None, :]
        marked = 1 - np.cos(np.maximum(angle, 0)) <= bound[:, None] + SLACK
        marked[np.arange(len(marked)), np.argmax(cosine, axis=1)] = False
        return marked

    def first(self, probes: int):
        return self._mapped(lambda cosine, _: self.nearest(cosine, probes))

    def others(self):
        return self._mapped(self.reaching)

    def _mapped(self, choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    cut = batch.slice(at, BLOCK)
                    if held and sum(b.num_rows for b in held) + cut.num_rows > BLOCK:
                        yield from self.visits(together(held), choose)
                        held = []
                    held.append(cut)
            if held:
                yield from self.visits(together(held), choose)

        return run


def held(asked: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(id, vector) rows with a direction as arrays; nothing if there are more than FEW."""
    rows = asked.where(F.col(asked.columns[1]).isNotNull()).limit(FEW + 1).toArrow()
    if rows.num_rows > FEW:
        return None
    x = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
    fine = with_direction(x)
    return rows.column(0).to_numpy()[fine], x[fine]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, ids, vectors) of rows (number, ids, matrix)."""
    for batch in batches:
        for at in range(batch.num_rows):
            own = batch.column(1)[at].values.to_numpy(zero_copy_only=False)
            yield batch.column(0)[at].as_py(), own, unpacked(batch.column(2)[at], len(own))


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def visiting(k: int, exclude_self: bool):
    """For mapInArrow, over rows (qids, qm, bounds, cells, marks, cell, ids,
    matrix) of a visit to a bucket and a block of a cell in it: the ``k`` nearest
    of each query in the cells that it has marked.  Rows of a visit come one
    after another, so it gives out its best once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met, places, marks = None, None, {}, None
        for batch in batches:
            for at in range(batch.num_rows):
                qi, qm, bounds, cells, marked, cell, bi, bm = (batch.column(i)[at] for i in range(8))
                key = tuple(x.as_buffer().to_pybytes() for x in (qm, marked)) + (qi.values.to_numpy(zero_copy_only=False).tobytes(), tuple(cells.as_py()))
                if key != now:
                    if met is not None:
                        yield met.found()
                    ids = np.frombuffer(key[2], dtype=np.int64)
                    met = Met(ids, np.frombuffer(key[0]).reshape(len(ids), -1), k, exclude_self, np.frombuffer(bounds.as_buffer()))
                    now, places, marks = key, {c: i for i, c in enumerate(key[3])}, np.frombuffer(key[1], dtype=bool).reshape(len(ids), -1)
                own = bi.values.to_numpy(zero_copy_only=False)
                met.add(own, unpacked(bm, len(own)), np.flatnonzero(marks[:, places[cell.as_py()]]))
        if met is not None:
            yield met.found()

    return run


def fraction(ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that ids are dealt by."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2.0**53


def learn(stored: DataFrame, n: int, cells: int) -> np.ndarray:
    """Unit centroids by k-means over unit vectors, ``n`` in blocks, from a sample of about
    TAUGHT_BY vectors a cell, chosen by the hash of the id, whose first serve to begin with."""
    share = min(1.0, TAUGHT_BY * cells / n)
    taught = stored.select("block", "ids", "matrix").mapInArrow(sampling(share), "block long, ids array<long>, matrix binary").persist()
    begin = taught.mapInArrow(beginning(min(share, (2 * cells + 64) / n)), "at double, id long, vector binary").orderBy("at", "id").limit(cells).toArrow()
    points = np.unique(np.frombuffer(b"".join(begin.column("vector").to_pylist()), np.float32).reshape(begin.num_rows, -1), axis=0).astype(float)
    for _ in range(ROUNDS if cells > 1 else 0):  # a single point is any
        parts = taught.mapInArrow(summing(points), "cell int, n long, total binary").repartition("cell")
        sums = parts.mapInArrow(adding, "cell int, n long, total binary").toArrow()  # one row a cell
        totals = np.frombuffer(b"".join(sums.column("total").to_pylist())).reshape(sums.num_rows, -1)
        points = points.copy()
        points[sums.column("cell").to_numpy()] = totals / sums.column("n").to_numpy()[:, None]
    taught.unpersist()
    norm = np.linalg.norm(points, axis=1)
    return points[norm > 0] / norm[norm > 0, None]


def sampling(share: float):
    """For mapInArrow, over (block, ids, matrix): the vectors with a fraction below ``share``,
    at length one in single precision, in blocks of as many as meet all points at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([np.concatenate(ids).tolist()], pa.list_(pa.int64())), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block", "ids", "matrix"])

        for _, own, x in blocks_of(batches):
            some = np.flatnonzero(fraction(own) < share)
            ids.append(own[some])
            held.append(directions(x[some])[1])
            if sum(map(len, ids)) >= 2 * HELD:
                yield block()
                ids, held = [], []
        if sum(map(len, ids)):
            yield block()

    return run


def taught_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(batch.num_rows):
            own = batch.column(1)[at].values.to_numpy(zero_copy_only=False)
            yield own, np.frombuffer(batch.column(2)[at].as_buffer(), np.float32).reshape(len(own), -1)


def beginning(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, x in taught_of(batches):
            at = fraction(own)
            some = np.flatnonzero(at < share)
            yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(own[some]), pa.array([x[i].tobytes() for i in some], pa.binary())], ["at", "id", "vector"])

    return run


def summing(points: np.ndarray):
    """For mapInArrow, over blocks of the sample: how many vectors are nearest to each point, and their sum, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, half = points.T.astype(np.float32), (np.square(points).sum(axis=1) / 2).astype(np.float32)
        n, totals = np.zeros(len(points), np.int64), np.zeros(points.shape)
        for _, x in taught_of(batches):
            cell = (x @ near - half).argmax(axis=1)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            n += np.bincount(cell, minlength=len(n))
            totals[cell[order][first]] += np.add.reduceat(x[order].astype(float), first, axis=0)
        yield from summed({int(c): (int(n[c]), totals[c]) for c in np.flatnonzero(n)})

    return run


def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, n, total) of a cell as one."""
    known: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for cell, n, total in zip(*(c.to_pylist() for c in batch.columns)):
            before_n, so_far = known.get(cell, (0, 0.0))
            known[cell] = before_n + n, so_far + np.frombuffer(total)
    yield from summed(known)


def summed(known: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows = list(known.items())
    for at in range(0, len(rows), HELD):
        part = rows[at : at + HELD]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int32()), pa.array([n for _, (n, _) in part], pa.int64()), pa.array([t.tobytes() for _, (_, t) in part], pa.binary())], ["cell", "n", "total"])


def build(vectors: DataFrame, put: Put, points: np.ndarray | None = None, cells: int | None = None) -> VectorIndex:
    """Index vectors (id, vector).  ``put`` writes a named part and reads it
    back: the vectors are made once, and stored in blocks as they come;
    ``points`` are centroids of an older index, else they are learnt."""
    spark = vectors.sparkSession
    small_batches(spark)
    stored = put("unsorted", in_blocks(vectors, "id", "vector", ("block", "ids", "matrix"), 2 * HELD, stored=True))
    n = stored.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    if points is None:
        points = learn(stored, n, min(cells or max(1, min(int(n**0.5), n // CELL)), MOST_CELLS, n)) if n else np.zeros((0, 0))

    placed = lambda columns, shape: stored.select("block", "ids", "matrix").mapInArrow(lambda batches: columns(placing(points)(as_rows(batches))), shape)
    stats = placed(lambda made: (b.select(["cell", "cosine"]) for b in made), "cell int, cosine double").groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    known = {r.cell: r for r in stats.collect()}  # one row a cell
    made = [(c, points[c].tolist(), float(np.arccos(np.clip(r.least, -1, 1))) + 1e-9, -(-r.n // (BLOCK // 2)), r.n) for c, r in sorted(known.items())]
    centroids = put("centroids", spark.createDataFrame(made, "cell int, centroid array<double>, reach double, groups int, n long"))
    # A large cell is dealt to groups of about half a block each.
    groups = np.ones(len(points), np.int64)
    groups[list(known)] = [-(-r.n // (BLOCK // 2)) for r in known.values()]
    dealt = placed(dealing(groups), "cell int, grp int, id long, vector binary").repartition("cell", "grp").sortWithinPartitions("cell", "grp", "id")
    return VectorIndex(centroids, put("cells", dealt.mapInArrow(pack, "cell int, grp int, ids array<long>, matrix binary")))


def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, ids, matrix) as rows (id, vector)."""
    for _, own, x in blocks_of(batches):
        vector = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own), vector], ["id", "vector"])


def placing(points: np.ndarray):
    """For mapInArrow, over (id, vector): each vector's nearest point, as single precision tells, and the
    cosine to it.  Few vectors meet all points at once, as there are more points of more vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = points.T.astype(np.float32)
        for batch in (s for b in batches for s in slices(b, 2 * HELD)):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm, unit = directions(x)
            cell = (unit @ near).argmax(axis=1)
            cosine = np.einsum("ij,ij->i", x, points[cell]) / norm
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(cosine)], ["id", "vector", "cell", "cosine"])

    return run


def dealing(groups: np.ndarray):
    """Rows (id, vector, cell, cosine) as (cell, grp, id, vector), the vector packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            vector = pa.array([packed(row) for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array((fraction(ids) * groups[cell]).astype(np.int32)), batch.column(0), vector], ["cell", "grp", "id", "vector"])

    return run


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, grp, id, packed vector), sorted, as blocks of one group each."""
    now, ids, held = None, [], []

    def block():
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([packed(np.concatenate(held))], pa.binary())], ["cell", "grp", "ids", "matrix"])

    for batch in batches:
        cell, grp = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(grp) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = (int(cell[a]), int(grp[a]))
            for at in range(a, b, BLOCK):
                own = batch.slice(at, min(BLOCK, b - at))
                if ids and (key != now or len(ids) + own.num_rows > BLOCK):
                    yield block()
                    ids, held = [], []
                now = key
                ids = ids + own.column(2).to_pylist()
                held.append(np.concatenate([unpacked(v, 1)[0] for v in own.column(3).to_pylist()]))
    if ids:
        yield block()
