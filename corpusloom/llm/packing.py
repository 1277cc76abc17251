"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each task packs the rows of its own input split, in groups of a bounded number
of tokens, so nothing is shuffled, memory does not grow with the input, and a
task that is run again after a lost executor makes the same pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, parts, short_batches
from .tokens import word_ids

CAPACITY = 2048
#: Windows in a group that is differenced at once.
GROUP_WINDOWS = 256
#: Share of padding up to which the window count rises; beyond it, what is over is cut off.
MOST_PADDING = 0.01

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each item.

    A partial partition is k sums.  The two with the widest spread are merged,
    the largest sum of one with the smallest of the other, until one is left.
    Each merge notes which slot went where; the windows are read back from the
    last merge to the items.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    heap, sums, merges = [], {}, []
    for i, size in enumerate(sizes.tolist()):
        first = np.zeros(k, dtype=np.int64)
        first[0] = size
        sums[i] = first  # always in descending order, smallest sum 0
        heap.append((-size, i))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        merges.append((a, b, order))
        sums[made] = total
        heapq.heappush(heap, (-int(total[0]), made))
        made += 1
    windows = {made - 1: np.arange(k)}
    for made_id in range(made - 1, n - 1, -1):
        a, b, order = merges[made_id - n]
        window = windows.pop(made_id)
        slots = np.empty(k, dtype=np.int64)
        slots[order] = window
        windows[a], windows[b] = slots, slots[::-1]
    return np.array([windows[i][0] for i in range(n)], dtype=np.int64)


def pack_items(sizes: list[int], capacity: int = CAPACITY, most_padding: float | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length), none over ``capacity``.

    The count starts at the least possible and rises whenever a window exceeds
    the capacity.  With ``most_padding`` it rises while no more than that share
    of the windows is free; then what is still over is cut off and moved to
    windows with room.  Without it, items stay whole, and each size must fit
    the capacity.
    """
    sizes_ = np.asarray(sizes, dtype=np.int64)
    if not len(sizes_):
        return []
    total, large = int(sizes_.sum()), int((2 * sizes_ > capacity).sum())
    if most_padding is None and sizes_.max() > capacity:
        raise ValueError("an item is larger than a window")
    k = max(1, -(-total // capacity), large if most_padding is None else 0)
    while True:
        window = karmarkar_karp(sizes_, k)
        load = np.bincount(window, weights=sizes_, minlength=k).astype(np.int64)
        over = np.maximum(load - capacity, 0).sum()
        more = k + max(1, int((load > capacity).sum()) // 8)  # in steps, as each count is differenced anew
        if over and most_padding is not None:
            more = min(more, int(total / capacity / (1 - most_padding)))
        if not over or more <= k:
            break
        k = more
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for item, w in enumerate(window.tolist()):
        out[w].append((item, 0, int(sizes_[item])))
    room = [w for w in range(k) if load[w] < capacity]
    for w in range(k) if over else ():
        while load[w] > capacity:
            item, start, length = out[w].pop()
            to = room[-1]
            move = int(min(length, load[w] - capacity, capacity - load[to]))
            if move < length:
                out[w].append((item, start, length - move))
            out[to].append((item, start + length - move, move))
            load[w] -= move
            load[to] += move
            if load[to] == capacity:
                room.pop()
    return [w for w in out if w]


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Packs one task's documents; ``rows`` collects the finished pieces."""

    def __init__(self, partition: int, capacity: int, group_windows: int, most_padding: float | None):
        self.capacity, self.group, self.most_padding = capacity, group_windows * capacity, most_padding
        self.next_id = partition << 40
        self.items: list[tuple] = []  # (doc_id, ids, start, length)
        self.held = 0
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length in pieces:
            crc = zlib.crc32(ids[start : start + length].tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), self.next_id, offset))
            offset += length
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= self.capacity:
            self.sequence([(doc_id, ids, start, self.capacity)])
            start += self.capacity
        length = len(ids) - start
        if self.held + length >= self.group:  # the group's total is a whole number of windows
            first = self.group - self.held
            self.items.append((doc_id, ids, start, first))
            self.held += first
            self.flush()
            start, length = start + first, length - first
        if length:
            self.items.append((doc_id, ids, start, length))
            self.held += length

    def flush(self) -> None:
        """Pack what is held.  What does not fill windows goes to sequences
        whose lengths are powers of two, which need no padding."""
        items, self.items, rest, self.held = self.items, [], self.held % self.capacity, 0
        tails: list[tuple] = []
        for size in powers_of_two(rest):
            parts, want = [], size
            while want:
                doc_id, ids, start, length = items.pop()
                take = min(want, length)
                parts.append((doc_id, ids, start + length - take, take))
                if take < length:
                    items.append((doc_id, ids, start, length - take))
                want -= take
            tails.append(parts)
        for window in pack_items([x[3] for x in items], self.capacity, self.most_padding):
            self.sequence([(*items[i][:2], items[i][2] + start, length) for i, start, length in window])
        for parts in tails:
            self.sequence(parts)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, most_padding: float | None = MOST_PADDING) -> DataFrame:
    """Pack the documents' token ids, each with ``end_id`` behind it.

    Returns the pieces: doc_id, start (of the document's ids), length,
    ids_crc32, doc_tokens, sequence_id, offset.  Every id lies in exactly one
    piece, pieces fill a sequence without gaps, no sequence is over
    ``capacity``; all but those at a power of two are full but for at most
    ``most_padding`` of a group: a group's window count rises while a window
    exceeds the capacity and so much is not free, and then what is over is cut
    off.  With None the count rises until nothing is over, and texts are cut
    only where they are longer than a window and at the ends of a group; with
    two or three texts to a window that leaves some 5 % free, which is why it
    is not the default.  Very long texts are cut into whole windows and a rest.
    Null and empty texts have only ``end_id``.  A null doc_id stays null; repeated rows are
    documents of their own; an empty table gives no rows; other columns are
    not read.
    """

    @lean("packing", word_ids.cache_clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(TaskContext.get().partitionId(), capacity, group_windows, most_padding)
        encode = word_ids(tokenizer)
        end = np.array([end_id], dtype="<u4")

        def rows():
            done, packer.rows = packer.rows, []
            columns = list(zip(*done, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for part in parts(batch, 1):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc_id, np.concatenate([ids, end]))
            yield rows()
        packer.flush()
        yield rows()

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)
