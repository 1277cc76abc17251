"""Ranked lexical search: many items against all documents, in windows of doc_ids.

The terms of the items are numbered; one pass over the texts leaves, for each
document, the numbers and counts of those it has.  These postings are dealt by
ranges of doc_id.  A task walks them in fixed windows of doc_ids: a window's
postings are turned term by term, every item adds its terms' parts into one
array of scores that fits a processor's cache, a bitset tells which places were
touched, and the best of those go to the item's heap.  Only heaps leave a task.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, parts, short_batches

#: doc_ids in a window, and at most so many documents: an array of scores has 128 KiB.
WINDOW = 1 << 14
#: Documents that an item keeps.
BEST = 50
#: (item, term) pairs that are asked at once; more items are asked in blocks.
PAIRS = 200_000

# Letters and digits of ASCII and all other characters make terms.
KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in KEEP else 0x20 for b in range(0x100))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased."""
    return text.translate(FOLD).split()


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def item_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item, of all its rows if it has several."""

    @lean("ranked_search")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(terms_of(t))) for t in texts_of(batch.column(1))]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(chain.from_iterable(sets)), pa.binary())], ["item_id", "term"])

    return queries.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(run, "item_id long, term binary").distinct()


def postings(documents: DataFrame, numbers: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, counts), a row per document: how many terms it
    has, and the numbers and counts of those that are numbered."""
    many = len(numbers)

    @lean("ranked_search")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                split = [terms_of(t) for t in texts_of(part.column(1))]
                n = np.fromiter(map(len, split), np.int64, len(split))
                found = np.fromiter(map(numbers.get, chain.from_iterable(split), repeat(many)), np.int64, n.sum())
                place = np.repeat(np.arange(len(split)), n)
                pairs, counts = np.unique((place * (many + 1) + found)[found < many], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(len(split) + 1) * (many + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((pairs % (many + 1), pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])

    rows = documents.select(F.col(doc_id).cast("long"), F.coalesce(text, F.lit("")).alias("text"))
    made = rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def statistics(table: DataFrame, many: int) -> tuple[int, int, list[int]]:
    """Documents with a term, all their terms, and the documents of each
    numbered term, from the postings; two more rows than terms reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, documents, length = np.zeros(many, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            seen += np.bincount(batch.column(1).flatten().to_numpy(), minlength=many)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()]), pa.array([length, documents, *seen[at].tolist()])], ["term", "n"])

    rows = table.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = dict(map(tuple, rows.collect()))
    return known.get(-1, 0), known.get(-2, 0), [known.get(t, 0) for t in range(many)]


def gains(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What postings add to a score, in whole numbers: ``weight`` times
    ``tf`` against the document's length ``n``.  Python's numbers stand in
    where a product would not fit 64 bits."""
    if max(int(n.max(initial=0)) * documents * 50, int(tf.max(initial=0)) * 10**9) >= 1 << 62:
        weight, tf, n = (a.astype(object) for a in (weight, tf, n))
    m = 100 - 50 + (50 * n * documents) // length
    return (weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))).astype(np.int64)


def windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[pa.Array]]:
    """Rows sorted by their first column, a doc_id, cut wherever a window of
    ``width`` ids ends; a window with repeated ids is cut after ``width`` rows."""
    held, now, size = [], None, 0
    for batch in batches:
        of = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy() // width
        start = 0
        while start < batch.num_rows:
            if held and (of[start] != now or size == width):
                yield held
                held, size = [], 0
            now = of[start]
            stop = min(int(np.searchsorted(of, now, "right")), start + width - size)
            held.append(batch.slice(start, stop - start))
            size, start = size + stop - start, stop
    if held:
        yield held


class WindowPostings:
    """A window's postings by term: places and gains, and the places' bits in
    words of 64."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table.column(0).to_pylist()
        n = table.column(1).to_numpy()
        lists = [table.column(i).combine_chunks() for i in (2, 3)]
        terms, tf = (a.flatten().to_numpy() for a in lists)
        place = np.repeat(np.arange(len(n)), np.diff(lists[0].offsets.to_numpy()))
        order = np.argsort(terms, kind="stable")
        terms, self.places = terms[order], place[order]
        self.gains = gains(weights[terms], tf[order], n[self.places], documents, length)
        every = np.arange(len(weights) + 1)
        self.start = np.searchsorted(terms, every).tolist()
        # One word of bits for all postings of a term in the same 64 places.
        word = self.places >> 6
        first = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(word, prepend=-1)) if len(terms) else np.zeros(0, int)
        bit = np.left_shift(np.uint64(1), (self.places & 63).astype(np.uint64))
        self.words, self.bits = word[first], np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.word_start = np.searchsorted(terms[first], every).tolist()


def rank(documents: DataFrame, queries: DataFrame, k: int = BEST, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW, pairs: int = PAIRS) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: (item_id, rank,
    doc_id, score), equal scores by ascending doc_id.

    Every whole text is read; null counts as empty, and a document or an item
    without terms has no rows.  Several rows of an item (a null item_id is
    one) are one item; each row of a document stands for itself, repeated ones
    have ranks of their own, and one without doc_id comes after its equals.
    Empty tables give no rows; other columns are not read.

    Items are asked in blocks of about ``pairs`` pairs of item and term, which
    bounds what a task holds, but for a single item's own text; the documents
    are read once for each block.  A document's postings are one row and rows
    of one doc_id may be dealt to several tasks, so no doc_id is a hot key.
    """
    spark = documents.sparkSession
    short_batches(spark)
    asked = materialize(item_terms(queries, item_id, text), "asked")
    items, total = asked.agg(F.count_distinct(F.struct("item_id")), F.count("*")).first()
    blocks = -(-total // pairs)
    block = lambda: F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    while blocks > 1 and blocks < 8 * items and asked.groupBy(block().alias("b")).count().agg(F.max("count")).first()[0] > pairs:
        blocks *= 2
    found = [_ranked_block(documents, asked.where(block() == b), k, doc_id, text, window) for b in range(blocks)]
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _ranked_block(documents: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str, window: int) -> DataFrame | None:
    by_item: dict[int | None, list[bytes]] = defaultdict(list)
    for row in asked.toArrow().to_pylist():
        by_item[row["item_id"]].append(row["term"])
    if not by_item:
        return None
    numbers = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(by_item.values()))))}
    table = materialize(postings(documents, numbers, doc_id, text), "postings")
    n_docs, length, df = statistics(table, len(numbers))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df])
    # Terms that add nothing, as almost all documents have them or none has, are left out.
    items = [(item, [i for t in terms if weights[i := numbers[t]] > 0 and df[i]]) for item, terms in by_item.items()]

    @lean("ranked_search")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in items]
        scores, touched = np.zeros(window, np.int64), np.zeros(-(-window // 64), np.uint64)
        for held in windows(batches, window):
            w = WindowPostings(held, weights, n_docs, length)
            for heap, (_, terms) in zip(heaps, items, strict=True):
                for t in terms:
                    if (a := w.start[t]) < (b := w.start[t + 1]):
                        scores[w.places[a:b]] += w.gains[a:b]
                        a, b = w.word_start[t], w.word_start[t + 1]
                        touched[w.words[a:b]] |= w.bits[a:b]
                at = np.flatnonzero(np.unpackbits(touched.view(np.uint8), bitorder="little"))
                found = scores[at]
                scores[at] = 0
                touched[:] = 0
                keep = found > 0 if len(heap) < k else found >= heap[0][0]
                at, found = at[keep], found[keep]
                if len(at) > k:  # places ascend with the doc_ids, so ties go to the smaller
                    best = np.argsort(-found, kind="stable")[:k]
                    at, found = at[best], found[best]
                for place, score in zip(at.tolist(), found.tolist(), strict=True):
                    # The heap's head is the worst: the lowest score, and of equals no id or the largest.
                    one = w.ids[place]
                    entry = (score, one is not None, -(one or 0))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        rows = [(item, -e[2] if e[1] else None, e[0]) for (item, _), heap in zip(items, heaps, strict=True) for e in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

    dealt = table.repartitionByRange(F.asc_nulls_last("doc_id"), "row").sortWithinPartitions(F.asc_nulls_last("doc_id"), "row")
    best = dealt.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
