"""Token counts that follow edits.

Each document has a segment tree over its chunks (runs between white space,
each with the space before it), whose nodes hold sums of chunks, characters and
tokens.  An edit finds its chunks from the root, encodes anew only those that it
touches plus the context at both ends that the pre-tokens may depend on, and
updates the sums on the paths from them to the root.  A node that gets too many
children splits where it stands, and small neighbours become one, so an edit
costs what it brings and the depth of the tree, however long the document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, byte_bpe
from .shared import lean, parts, short_batches

Edit = tuple[int, int, str]

#: Children of a node at most; a node of less than a fourth joins its neighbour.
WIDTH = 32

# Unicode's White_Space, as in the chunks' pattern.
_WHITE = {c for part in (range(9, 14), (32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000), range(0x2000, 0x200B)) for c in map(chr, part)}


class Node:
    """A leaf has chunks and their token counts, an inner node has nodes; both
    have the sums of what is below."""

    __slots__ = ("kids", "counts", "n", "chars", "tokens")

    def __init__(self, kids: list, counts: list[int] | None):
        self.kids, self.counts = kids, counts
        self.add_up()

    def add_up(self) -> None:
        if self.counts is not None:
            self.n, self.chars, self.tokens = len(self.kids), sum(map(len, self.kids)), sum(self.counts)
        else:
            self.n, self.chars, self.tokens = sum([k.n for k in self.kids]), sum([k.chars for k in self.kids]), sum([k.tokens for k in self.kids])

    def parts(self) -> list[Node]:
        """The node itself or, if it is too wide, nodes of about one width; none without children."""
        size = len(self.kids)
        if 0 < size <= WIDTH:
            self.add_up()
            return [self]
        cuts = [size * i // max(1, -(-size // (WIDTH * 3 // 4))) for i in range(-(-size // (WIDTH * 3 // 4)) + 1)]
        return [Node(self.kids[x:y], self.counts and self.counts[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]

    def splice(self, a: int, b: int, chunks: list[str], counts: list[int]) -> list[Node]:
        """The nodes that take this one's place when the chunks from ``a`` to
        ``b`` below it give way to others."""
        if self.counts is not None:
            self.kids[a:b], self.counts[a:b] = chunks, counts
            return self.parts()
        at, first, start = 0, 0, 0
        while first < len(self.kids) - 1 and a >= at + self.kids[first].n:
            at += self.kids[first].n
            first += 1
        last, start = first, at
        while b > at + self.kids[last].n:
            at += self.kids[last].n
            last += 1
        if first == last:
            new = self.kids[first].splice(a - start, b - start, chunks, counts)
        else:
            new = self.kids[first].splice(a - start, self.kids[first].n, chunks, counts) + self.kids[last].splice(0, b - at, [], [])
        self.kids[first : last + 1] = new
        # A small node among these joins the one before it.
        for i in range(min(first + len(new), len(self.kids) - 1), max(first - 1, 0), -1):
            x, y = self.kids[i - 1], self.kids[i]
            if min(len(x.kids), len(y.kids)) < WIDTH // 4 and len(x.kids) + len(y.kids) <= WIDTH:
                self.kids[i - 1 : i + 1] = [Node(x.kids + y.kids, None if x.counts is None else x.counts + y.counts)]
        return self.parts()


class TokenTree:
    """A text's chunks with the sums of their characters and tokens."""

    def __init__(self, text: str, bpe: ByteBPE, chunks: list[str] | None = None):
        self.bpe = bpe
        chunks = [c for found in bpe.chunks(text) for c in found] if chunks is None else chunks
        self._grow(Node(chunks, self._counts(chunks)).parts())

    def _grow(self, nodes: list[Node]) -> None:
        """Put a root above ``nodes``."""
        while len(nodes) > 1:
            nodes = Node(nodes, None).parts()
        self.root = nodes[0] if nodes else Node([], [])
        while self.root.counts is None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    def _counts(self, chunks: list[str]) -> list[int]:
        try:
            return [x[1] for x in map(self.bpe.known.__getitem__, chunks)]
        except KeyError:
            new = set(chunks).difference(self.bpe.known)
            self.bpe.learn(new)
            out = [self.bpe.known[c][1] for c in chunks]
            self.bpe.forget(new)
            return out

    @property
    def characters(self) -> int:
        return self.root.chars

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def __len__(self) -> int:
        return self.root.n

    @property
    def slots(self) -> list[str]:
        """All chunks in order."""
        out, left = [], [self.root]
        while left:
            node = left.pop()
            if node.counts is None:
                left += reversed(node.kids)
            else:
                out += node.kids
        return out

    def chunk(self, index: int) -> str:
        node = self.root
        while node.counts is None:
            for node in node.kids:  # noqa: B020
                if index < node.n:
                    break
                index -= node.n
        return node.kids[index]

    def find(self, position: int) -> tuple[int, int]:
        """The chunk that holds a character, and the chunk's first position."""
        node, index, start = self.root, 0, 0
        while node.counts is None:
            for node in node.kids:  # noqa: B020
                if position - start < node.chars:
                    break
                index, start = index + node.n, start + node.chars
        for text in node.kids:
            if position - start < len(text):
                break
            index, start = index + 1, start + len(text)
        return index, start

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from ``start`` to ``end`` (both cut to the
        text); returns how many chunks were encoded for it."""
        return self.commit(*self.prepare(start, end, new))

    def prepare(self, start: int, end: int, new: str) -> tuple[int, int, list[str]]:
        """The chunks that an edit touches, first and behind the last, and those
        that take their place; nothing is changed yet."""
        start = min(max(start, 0), self.characters)
        end = min(max(end, start), self.characters)
        n = len(self)
        if not n:
            return 0, 0, [c for found in self.bpe.chunks(new) for c in found]
        first, at = self.find(start) if start < self.characters else (n - 1, self.characters - len(self.chunk(n - 1)))
        held = [self.chunk(first)]
        # Back to where white space that stays follows something else that stays:
        # what is before such a place is chunked alike whatever comes after it.
        while first > 0:
            before = self.chunk(first - 1)
            if at < start and held[0][:1] in _WHITE and before[-1] not in _WHITE:
                break
            held.insert(0, before)
            first, at = first - 1, at - len(before)
        stop, last = at, first
        for text in held:
            if last > first and stop > end and text[0] in _WHITE and held[last - first - 1][-1] not in _WHITE:
                break
            stop, last = stop + len(text), last + 1
        else:
            while last < n:
                text = self.chunk(last)
                if stop > end and text[0] in _WHITE and held[-1][-1] not in _WHITE:
                    break
                held.append(text)
                stop, last = stop + len(text), last + 1
        whole = "".join(held[: last - first])
        whole = whole[: start - at] + new + whole[end - at :]
        return first, last, [c for found in self.bpe.chunks(whole) for c in found]

    def commit(self, first: int, last: int, chunks: list[str]) -> int:
        counts = self._counts(chunks)
        self._grow(self.root.splice(first, last, list(chunks), counts))
        return len(chunks)


def count_with_edits(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Count tokens before and after each document's edits.

    ``docs`` has doc_id, text and edits, an array of (start, end, replacement)
    in code points, end exclusive, each of the text that the ones before it
    left.  Returns doc_id, n_tokens, n_chunks, n_edits, n_tokens_edited,
    n_chars_edited and n_reencoded (chunks encoded for the edits).  Null texts
    count as empty and null edits as none; positions outside the text are cut
    to it, a null start or end is its end, a null replacement is empty.
    Repeated rows are counted alike; a null doc_id stays null; an empty table
    gives no rows; very long texts are read whole; other columns are not read.
    """

    @lean("bpe", byte_bpe.cache_clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            for part in parts(batch, 1, 128):
                texts = [t or "" for t in part.column(1).to_pylist()]
                split = [[c for found in bpe.chunks(t) for c in found] for t in texts]
                bpe.learn(new := set().union(*split).difference(bpe.known))  # in one batch of merge rounds
                trees = [TokenTree(t, bpe, chunks) for t, chunks in zip(texts, split, strict=True)]
                edits = [list(e or ()) for e in part.column(2).to_pylist()]
                rows = [[t.tokens, len(t), len(e)] for t, e in zip(trees, edits, strict=True)]
                redone = [0] * len(trees)
                for turn in range(max(map(len, edits), default=0)):  # the documents' first edits, then their second ones
                    now = [i for i, e in enumerate(edits) if turn < len(e)]
                    plans = []
                    for i in now:
                        n, e = trees[i].characters, edits[i][turn]
                        plans.append(trees[i].prepare(n if e["start"] is None else e["start"], n if e["end"] is None else e["end"], e["replacement"] or ""))
                    bpe.learn(more := set().union(*(p[2] for p in plans)).difference(bpe.known))
                    new |= more
                    for i, p in zip(now, plans, strict=True):
                        redone[i] += trees[i].commit(*p)
                rows = [[*r, t.tokens, t.characters, k] for r, t, k in zip(rows, trees, redone, strict=True)]
                bpe.forget(new)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "n_chunks", "n_edits", "n_tokens_edited", "n_chars_edited", "n_reencoded"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "edits")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_chunks long, n_edits long, n_tokens_edited long, n_chars_edited long, n_reencoded long")


def with_sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits each: an insertion in the middle, a deletion of
    ten characters a quarter in, and the last five replaced."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    half, quarter = (n / 2).cast("int"), (n / 4).cast("int")
    edit = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(s).alias("replacement"))
    after = n + 9 - F.least(F.lit(10), n + 9 - quarter)  # the length once the first two are done
    edits = F.array(edit(half, half, " inserted"), edit(quarter, quarter + 10, ""), edit(F.greatest(after - 5, F.lit(0)), after, "\n\nThe end."))
    return docs.select("doc_id", "text", edits.alias("edits"))
