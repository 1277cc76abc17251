"""Jaccard join on word shingles, exact, by signature trees.

Texts with the same shingle set form a class, and only one of each class is
compared.  In a common order of shingles, rare ones first, two sets that link
share one of the first fifth of the larger set, and that first common shingle
is among the first ninth of the smaller one.  Sets of one range of sizes that
share such a shingle form a tile; of tiles that hold the same sets one is kept.

Over the sets of a tile a signature tree is built: a leaf is the bitmap of a
set, an inner node the OR and the AND of the bitmaps below and their range of
sizes.  A traversal of node pairs from the root drops those whose largest
possible overlap is too small.  This is done twice.  First the bitmaps are short
signatures, and the sets of which a pair is left go on.  For those the bitmaps have one bit for each shingle that the tile has twice, so what
reaches the leaves is decided there, exactly.  A tile's links are given as a
forest, a row for each set but one of a component, however many pairs link.

A large tile is dealt out at random to trees of bounded size.  Most of what
links is then connected.  What is left are pairs of different components that
never met: the sets of small components meet the large ones, and each other,
in further trees, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, free_name, lean, materialize, maybe_in, parts, short_batches, split_by

WIDTH = 5
PERCENT = 80
#: Shingles that a text set's task has seen this often are frequent; the most
#: frequent of them, at most so many, are put last in the common order.  This
#: bounds what is broadcast, and decides only how fast the join is.
LOCAL_COUNT, FREQUENT = 2, 1 << 17
#: Shingles that are counted at once in a task.
COUNTED = 1 << 21
#: Sets, and shingles in them, that one tree holds.
TREE, TREE_SHINGLES = 512, 1 << 20
#: Node pairs whose bitmaps are compared at once, in 64-bit words.
FRONTIER = 1 << 20
#: Nodes for rows without doc_id are numbered from here on.
NO_ID = 1 << 62

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles."""
    split = [(t or "").encode().lower().split() for t in texts]
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), dtype=np.uint64, count=sum(map(len, split)))
    out, at = [], 0
    with np.errstate(over="ignore"):
        n = max(0, len(flat) - WIDTH + 1)
        grams = np.full(n, np.uint64(WIDTH))
        for k in range(WIDTH):
            grams = (grams * MULTIPLY) ^ flat[k : n + k]
            grams ^= grams >> np.uint64(29)
        grams = mix(grams)
        for words in split:
            end = at + len(words)
            if len(words) >= WIDTH:
                own = np.sort(grams[at : end - WIDTH + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif words:
                whole = np.full(1, np.uint64(len(words)))
                for h in flat[at:end]:
                    whole = (whole * MULTIPLY) ^ h
                    whole ^= whole >> np.uint64(29)
                out.append(mix(whole))
            else:
                out.append(flat[:0])
            at = end
    return out


def identify(doc_ids: list[int | None], sets: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(node, size, and two sums that tell the sets apart) of each text."""
    out = []
    with np.errstate(over="ignore"):
        for i, s in zip(doc_ids, sets, strict=True):
            a, b = (int(x.sum(dtype=np.uint64)) - (1 << 63) for x in (s, mix(s ^ MULTIPLY)))
            out.append((NO_ID + a % (1 << 60) if i is None else i, len(s), a, b))
    return out


def size_bands(largest: int) -> np.ndarray:
    """The least size of each band.  Sizes that can link lie in one band or two
    that follow each other."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // PERCENT + 1)
    return np.array(low, dtype=np.int64)


BANDS = size_bands(1 << 40)


def long_prefix(n):
    """Shingles of a set of which a similar set, no larger, must have one."""
    return n - -(-PERCENT * n // 100) + 1


def short_prefix(n):
    """The same for a similar set that is no smaller."""
    return n - least_overlap(n, n) + 1


def least_overlap(n, m):
    """Shingles that sets of these sizes share at least if they link."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


@lean("ngram")
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: doc_id, size, sums.  Kind 1: shingles frequent in this task."""
    held: list[np.ndarray] = []
    seen: set[tuple] = set()

    def rows(kind, *columns):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["kind", "a", "n", "b", "c"])

    def frequent():
        token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        often = count >= LOCAL_COUNT
        held.clear()
        seen.clear()
        zero = np.zeros(int(often.sum()), dtype=np.int64)
        return rows(1, token[often].view(np.int64), count[often], zero, zero)

    for batch in batches:
        for part in parts(batch, 1):
            ids, sets = part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist())
            found = identify(ids, sets)
            for f, s in zip(found, sets, strict=True):
                if f[1:] not in seen:
                    seen.add(f[1:])
                    held.append(s)
            _, n, b, c = zip(*found, strict=True)
            yield rows(0, ids, n, b, c)
            if sum(map(len, held)) >= COUNTED:
                yield frequent()
    yield frequent()


def frequent_shingles(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (a, sorted) of the highest counts (n), at most ``most``,
    and their grades.  A histogram of the counts gives the least one taken, so
    no more rows than that reach the driver."""
    often = counted.groupBy("a").agg(F.sum("n").alias("n"))
    # Eight steps to a doubling: at most 504 rows.
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in often.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r.step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = often.where(step >= least).toArrow()
    token = table["a"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(np.log2(table["n"].to_numpy()).astype(np.int64), 30)[order]


def order_keys(shingles: np.ndarray, frequent: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A shingle's place in the common order: 5 bits of frequency, 58 of hash."""
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    grade = np.where(frequent[at] == shingles, level[at], 0).astype(np.int64) if len(frequent) else np.zeros(len(shingles), np.int64)
    return grade << 58 | (shingles >> np.uint64(6)).view(np.int64)


class Tree:
    """A signature tree over sets, each level as arrays: level 0 has the sets,
    each further level half as many nodes.  A node has the OR and the AND of
    the bitmaps below it and their range of sizes."""

    def __init__(self, leaves: np.ndarray, size: np.ndarray):
        self.levels = [(leaves, leaves, size, size)]
        while len(self.levels[-1][0]) > 1:
            some, every, low, high = self.levels[-1]
            if len(some) % 2:  # the last node is its own neighbour
                some, every, low, high = (np.concatenate([x, x[-1:]]) for x in (some, every, low, high))
            self.levels.append((some[::2] | some[1::2], every[::2] & every[1::2], np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        """A level, where the root stands for all above it."""
        return self.levels[min(k, len(self.levels) - 1)]

    def below(self, k: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of level k that are below ``node``, one level up, and for
        each the place in ``node``."""
        place = np.arange(len(node))
        if k >= len(self.levels) - 1:
            return node, place
        child = np.concatenate([2 * node, 2 * node + 1])
        inside = child < len(self.levels[k][0])
        return child[inside], np.concatenate([place, place])[inside]


def enough_shared(x: tuple, y: tuple) -> np.ndarray:
    """For bitmaps with a bit for every shingle that may be shared: the bits in
    common bound the overlap of any two sets below, and are it at the leaves."""
    shared = np.bitwise_count(x[0] & y[0]).sum(axis=1, dtype=np.int64)
    return shared >= least_overlap(x[2], y[2])


def signatures_allow(x: tuple, y: tuple) -> np.ndarray:
    """For bitmaps in which shingles share bits: bits that all sets of one side
    have and none of the other are shingles that are not shared."""
    alone_x = np.bitwise_count(x[1] & ~y[0]).sum(axis=1, dtype=np.int64)
    alone_y = np.bitwise_count(y[1] & ~x[0]).sum(axis=1, dtype=np.int64)
    return np.minimum(x[3] - alone_x, y[3] - alone_y) >= least_overlap(x[2], y[2])


def tree_pairs(x: Tree, y: Tree, bound=enough_shared) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets (places in level 0), one of each tree, that neither
    their sizes nor the bound of any nodes above them rule out; of a tree with
    itself each pair once."""
    a = b = np.zeros(1, dtype=np.int64)
    top = max(len(x.levels), len(y.levels)) - 1
    for level in range(top, -1, -1):
        if level < top:
            a, place = x.below(level, a)
            b, other = y.below(level, b[place])
            a = a[other]
        if x is y:
            keep = a < b if level == 0 else a <= b
            a, b = a[keep], b[keep]
        nx, ny = x.level(level), y.level(level)
        ok = (100 * nx[3][a] >= PERCENT * ny[2][b]) & (100 * ny[3][b] >= PERCENT * nx[2][a])
        at = np.flatnonzero(ok)
        step = max(1, FRONTIER // nx[0].shape[1])
        for i in (at[s : s + step] for s in range(0, len(at), step)):
            ok[i] = bound(tuple(c[a[i]] for c in nx), tuple(c[b[i]] for c in ny))
        a, b = a[ok], b[ok]
    return a, b


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap in which each shingle has one bit, of four to eight for each
    shingle, a power of two."""
    bits = max(64, 4 << (len(shingles) - 1).bit_length())
    member = np.zeros(bits, dtype=np.uint8)
    member[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(member, bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures of several widths as rows of the least one."""
    words = [np.frombuffer(x, dtype=np.uint64) for x in signatures]
    width = min(map(len, words))
    return np.stack([np.bitwise_or.reduce(w.reshape(-1, width)) for w in words])


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, a bit for each shingle that two of them have."""
    size = [len(s) for s in sets]
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bit = np.cumsum(count > 1) - 1
    shared = (count > 1)[place]
    member = np.zeros((len(sets), -(-max(1, int((count > 1).sum())) // 64) * 64), dtype=bool)
    member[np.repeat(np.arange(len(sets)), size)[shared], bit[place[shared]]] = True
    return np.packbits(member, axis=1, bitorder="little").view(np.uint64)


def dual(bits: np.ndarray, size: np.ndarray, side: np.ndarray, bound) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile's sets: of side 1 with those of side 2, else of all."""
    if not side.any():
        tree = Tree(bits, size)
        return tree_pairs(tree, tree, bound)
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    a, b = tree_pairs(Tree(bits[left], size[left]), Tree(bits[right], size[right]), bound)
    return left[a], right[b]


def may_link(node: np.ndarray, group: np.ndarray, side: np.ndarray, size: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """Which of a tile's sets may link with one of another group, by their
    signatures."""
    order = np.lexsort([node, size])
    a, b = dual(folded([signatures[i] for i in order]), size[order], side[order], signatures_allow)
    a, b = order[a], order[b]
    apart = group[a] != group[b]
    out = np.zeros(len(node), dtype=bool)
    out[a[apart]] = out[b[apart]] = True
    return out


def forest(node: np.ndarray, group: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A star for every component that the links in a tile make of its groups.
    Sets of one group count as linked."""
    order = np.lexsort([node, [len(s) for s in sets]])
    sets = [sets[i] for i in order]
    return joined(group[order], *dual(bitmaps(sets), np.array([len(s) for s in sets]), side[order], enough_shared))


def joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for every component that the links (places a, b) make of the
    groups: edges between groups only, one fewer than the groups it joins."""
    names, g = np.unique(group, return_inverse=True)
    least = np.arange(len(names))
    a, b = g[a], g[b]
    differ = a != b
    a, b = a[differ], b[differ]
    while len(a):
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for x in (a, b, least[a], least[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(names)))
    return names[moved], names[least[moved]]


def _by_tile(batches: Iterator[pa.RecordBatch], payload: Callable, run: Callable) -> Iterator[pa.RecordBatch]:
    """``run`` with the rows of each tile, which lie together, the last column
    read by ``payload``: a batch of what it gives for each batch of rows."""
    tile, held, found = None, [], []

    def end() -> None:
        if len(held) > 1 and len({r[1] for r in held}) > 1:
            found.append(run(tile, *zip(*held, strict=True)))

    for batch in batches:
        values = payload(batch.column(batch.num_columns - 1))
        for t, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 1)), values, strict=True):
            if t != tile:
                end()
                tile, held = t, []
            held.append(row)
        if found:
            yield _rows(found)
            found.clear()
    end()
    if found:
        yield _rows(found)


def _rows(found: list[tuple[list, np.ndarray]]) -> pa.RecordBatch:
    names = found[0][0]
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*(x[1] for x in found), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


@lean("ngram")
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (tile, node, group, side, n, b, signature), those that may link."""

    def run(tile, node, group, side, n, b, signatures):
        columns = [np.full(len(node), tile), *map(np.array, (node, group, side, b))]
        ok = may_link(*columns[1:4], np.array(n), list(signatures))
        return ["tile", "node", "group", "side", "b"], [c[ok] for c in columns]

    return _by_tile(batches, lambda c: c.to_pylist(), run)


@lean("ngram")
def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (tile, node, group, side, shingles), edges between groups."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        return [values[s:e] for s, e in zip(ends, ends[1:], strict=False)]

    def run(tile, node, group, side, shingles):
        return ["a", "b"], forest(*map(np.array, (node, group, side)), list(shingles))

    return _by_tile(batches, sets, run)


def _sets(batches: Iterator[pa.RecordBatch], short: bool) -> Iterator[pa.RecordBatch]:
    """(node, b, n, signature) of texts, or (node, b, shingles)."""
    for batch in batches:
        for part in parts(batch, 1):
            sets = shingle_sets(part.column(1).to_pylist())
            found = identify(part.column(0).to_pylist(), sets)
            node, n, b = (pa.array([f[k] for f in found], pa.int64()) for k in range(3))
            if short:
                yield pa.RecordBatch.from_arrays([node, b, n, pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())], ["node", "b", "n", "bits"])
            else:
                yield pa.RecordBatch.from_arrays([node, b, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "b", "shingles"])


def without_parts_of_others(members: DataFrame) -> DataFrame:
    """``members`` (tile, k, parts, node, b) without tiles whose sets are all in
    one larger tile that a single tree holds.

    Each set names the largest such tile that it is in; if all sets of a tile
    name one and the same other tile, that one has them all.  It stays itself,
    since those sets name it.
    """
    whole = members.where("parts = 1")
    largest = whole.groupBy("node", "b").agg(F.max(F.struct("k", "tile"))["tile"].alias("largest"))
    named = whole.join(largest, ["node", "b"]).groupBy("tile").agg(F.min("largest").alias("low"), F.max("largest").alias("high"))
    return members.join(named.where("low = high and low <> tile").select("tile"), "tile", "left_anti")


def blocks(rows: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Tiles in which each ``left`` row of a ``key`` meets each ``right`` one:
    both sides are dealt out to blocks of TREE rows by hash, and every block of
    one meets every block of the other."""
    count = lambda c: F.greatest(F.ceil(F.count_if(c) / TREE), F.lit(1)).cast("int")
    counts = rows.groupBy(key).agg(count(left).alias("pl"), count(right).alias("pr"), F.count_if(left).alias("kl"), F.count_if(right).alias("kr")).where("kl > 0 and kr > 0").drop("kl", "kr")
    dealt = rows.join(counts, key)
    place = lambda n: F.pmod(F.xxhash64("node", "b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = dealt.where(left).select("*", place("pl").alias("i"), every("pr").alias("j"), F.lit(1).cast("long").alias("side")).unionByName(dealt.where(right).select("*", every("pl").alias("i"), place("pr").alias("j"), F.lit(2).cast("long").alias("side")))
    return sides.select(F.xxhash64(key, "i", "j").alias("tile"), "node", "b", "group", "side")


def left_over(placed: DataFrame) -> DataFrame:
    """Tiles for the pairs of a large tile that have not met.

    ``placed`` has the sets of large tiles (tile, node, b, group, s), s where
    the smaller one of a pair has to be.  A group of more than TREE sets meets
    each set once that shares a tile with it, however many tiles they share;
    the sets of the other groups of a tile meet each other.
    """
    sized = placed.select("group", "node", "b").distinct().groupBy("group").agg(F.count("*").alias("k"))
    large = materialize(sized.where(F.col("k") > TREE).select(F.col("group").alias("g")), "large")
    marked = materialize(placed.join(large, F.col("group") == F.col("g"), "left"), "marked")
    there = marked.where("g is not null").groupBy("tile", F.col("g").alias("key")).agg(F.max("s").alias("any"))
    asked = marked.join(there, "tile").where((F.col("group") != F.col("key")) & (F.col("s") | F.col("any")) & (F.col("g").isNull() | (F.col("g") < F.col("key"))))
    sides = asked.select("key", "node", "b", "group", F.lit(1).alias("of")).unionByName(marked.where("g is not null").select(F.col("g").alias("key"), "node", "b", "group", F.lit(2).alias("of"))).distinct()
    rest = marked.where("g is null")
    h = F.xxhash64("node", "b")
    kept = rest.groupBy("tile").agg(F.count("*").alias("k"), F.bit_xor(h).alias("f1"), F.bit_xor(F.xxhash64(h, "s")).alias("f2"), F.max("s").alias("any"), F.min("group").alias("low"), F.max("group").alias("high"))
    kept = kept.where("any and low < high").groupBy("k", "f1", "f2").agg(F.min("tile").alias("tile")).select("tile")
    rest = rest.join(kept, "tile", "left_semi")
    return blocks(sides, "key", F.col("of") == 1, F.col("of") == 2).unionByName(blocks(rest, "tile", F.col("s"), F.lit(True)))


def ngram_components(docs: DataFrame) -> DataFrame:
    """Link texts whose sets of 5-word shingles have a Jaccard similarity of
    0.8 or more, and find the components.

    Returns a row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id that links reach).  A text of fewer than five words is one
    shingle; without words, or null, it has none, and its component is its own
    doc_id.  Rows without doc_id take part and may get the component of others,
    else null; rows that repeat a doc_id count as one document; an empty table
    gives no rows; very long texts are read whole; other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialize(source.mapInArrow(_measure, "kind int, a long, n long, b long, c long"), "shingles")
    sizes = measured.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "b", "c", F.coalesce("a", F.lit(NO_ID) + F.pmod("b", F.lit(1 << 60))).alias("node"))
    classes = materialize(sizes.where("n > 0").groupBy("b", "c", "n").agg(F.min("node").alias("rep")), "classes")
    shipped = spark.sparkContext.broadcast(frequent_shingles(measured.where("kind = 1"), FREQUENT))

    @lean("ngram")
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, grade = shipped.value
        for batch in batches:
            for part in parts(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist())
                found = identify(part.column(0).to_pylist(), sets)
                some = [i for i, s in enumerate(sets) if len(s)]
                n = np.array([len(sets[i]) for i in some], dtype=np.int64)
                first = [np.sort(order_keys(sets[i], often, grade))[: long_prefix(len(sets[i]))] for i in some]
                band = np.searchsorted(BANDS, n, "right") - 1
                least = -(-PERCENT * n // 100)
                # The last place in the prefix that counts for a pair with a set that is
                # no smaller, for one of the same band, and for one of the band below.
                own = n - least_overlap(n, np.maximum(least, BANDS[band]))
                below = np.where((band > 0) & (least < BANDS[band]), n - least_overlap(n, np.maximum(least, BANDS[band - 1])), -1)
                ids = [pa.array([found[i][k] for i in some], pa.int64()) for k in range(4)]
                places = [pa.array(x, pa.int64()) for x in (band, short_prefix(n) - 1, own, below)]
                yield pa.RecordBatch.from_arrays([*ids, *places, pa.array(first, pa.list_(pa.int64()))], ["node", "n", "b", "c", "band", "short", "own", "below", "prefix"])

    def texts_of(nodes: DataFrame) -> DataFrame:
        """Rows of ``source`` whose doc_id may be among ``nodes``, and those without."""
        ids = nodes.select(F.col("node").alias("_id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("_id")))
        return maybe_in(source.withColumn("_id", F.coalesce("doc_id", F.lit(-1))), ids, "_id").select("doc_id", "text")

    kinds = "node long, n long, b long, c long, band long, short long, own long, below long, prefix array<long>"
    made = texts_of(classes.select(F.col("rep").alias("node"))).mapInArrow(prefixes, kinds)
    reps = materialize(made.join(classes.withColumnRenamed("rep", "node"), ["b", "c", "n", "node"]).dropDuplicates(["node", "b"]), "prefixes")

    # Shingles that two sets have, one of them where the smaller one of a pair has to.
    spread = reps.select("node", "b", "n", "band", "short", "own", "below", F.posexplode("prefix").alias("pos", "token"))
    open_ = materialize(spread.groupBy("token").agg(F.count("*").alias("k"), F.max(F.col("pos") <= F.col("short")).alias("s")).where("k > 1 and s").select("token"), "tokens")
    in_bands = F.array(
        F.when(F.col("pos") <= F.col("own"), F.struct(F.col("band").alias("band"), (F.col("pos") <= F.col("short")).alias("s"))),
        F.when(F.col("pos") <= F.col("below"), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("s"))),
    )
    entries = maybe_in(spread, open_, "token").select("node", "b", "n", "token", F.explode(F.array_compact(in_bands)).alias("x"))
    entries = materialize(entries.select(F.xxhash64("token", "x.band").alias("tile"), "node", "b", "n", "x.s"), "entries")
    discard(open_, reps)

    # Tiles with the same sets need one tree; in a large one, which of them are
    # the smaller ones of pairs matters too.
    h = F.xxhash64("node", "b")
    tiles = entries.groupBy("tile").agg(F.count("*").alias("k"), F.max("s").alias("any"), F.bit_xor(h).alias("f1"), F.bit_xor(F.xxhash64(h)).alias("f2"), F.bit_xor(F.xxhash64(h, "s")).alias("f3"), F.sum("n").alias("weight"), F.min("n").alias("low"), F.max("n").alias("high"))
    tiles = tiles.where((F.col("k") > 1) & F.col("any") & ((F.col("k") > 2) | (100 * F.col("low") >= PERCENT * F.col("high"))))
    parts_ = F.greatest(F.ceil(F.col("k") / TREE), F.ceil(F.col("weight") / TREE_SHINGLES)).cast("int")
    tiles = tiles.withColumn("parts", parts_).groupBy("k", "parts", "f1", "f2", F.when(F.col("parts") > 1, F.col("f3"))).agg(F.min("tile").alias("tile"))
    every = materialize(entries.join(tiles.select("tile", "k", "parts"), "tile"), "members")
    discard(entries)
    members = materialize(without_parts_of_others(every), "members")
    discard(every)

    def read(tiles: DataFrame, short: bool, schema: str) -> DataFrame:
        return texts_of(tiles.select("node")).mapInArrow(lean("ngram")(partial(_sets, short=short)), schema).dropDuplicates(["node", "b"])

    def solved(tiles: DataFrame, label: str) -> DataFrame:
        """The edges of tiles (tile, node, b, group, side): trees of signatures
        tell which sets may link, and trees of the whole sets which do."""
        marks = read(tiles, True, "node long, b long, n long, bits binary")
        rows = tiles.join(marks, ["node", "b"]).select("tile", "node", "group", "side", "n", "b", "bits")
        rows = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_possible, "tile long, node long, group long, side long, b long")
        rows = materialize(rows, "possible")
        rows = rows.join(read(rows, False, "node long, b long, shingles array<long>"), ["node", "b"]).select("tile", "node", "group", "side", "shingles")
        return materialize(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_solve, "a long, b long").distinct(), label)

    part = F.pmod(F.xxhash64("node", "b", "tile"), F.col("parts"))
    dealt = members.select(F.when(F.col("parts") > 1, F.xxhash64("tile", part)).otherwise(F.col("tile")).alias("tile"), "node", "b", F.col("node").alias("group"), F.lit(0).cast("long").alias("side"))
    edges = solved(dealt, "links")
    known = materialize(components(edges), "components")
    discard(edges)
    if members.where("parts > 1").limit(1).count():
        placed = members.where("parts > 1").join(known, "node", "left").select("tile", "node", "b", "s", F.coalesce("component", "node").alias("group"))
        still = placed.groupBy("tile").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("tile")
        placed = materialize(placed.join(still, "tile", "left_semi"), "placed")
        edges = solved(left_over(placed), "links")
        first = known
        known = materialize(components(edges.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
        discard(edges, first, placed)
    discard(members)
    shipped.destroy()

    of_class = classes.join(known.withColumnsRenamed({"node": "rep"}), "rep", "left").select("b", "c", "n", F.coalesce("component", "rep").alias("component"))
    found = sizes.join(of_class, ["b", "c", "n"], "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(component < NO_ID, component).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component:
    the one with the smallest doc_id.  Rows without doc_id stay, and so do
    texts without words; rows that repeat a doc_id stay or go together; an
    empty table gives no rows; other columns, whatever their names, pass."""
    found = materialize(ngram_components(docs), "ngram")
    key = free_name(docs, "_key")
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    sure, others = split_by(docs.withColumn(key, F.col("doc_id").cast("long")), dropped, key)
    return sure.unionByName(others.join(dropped, key, "left_anti").select(*sure.columns)).drop(key)
