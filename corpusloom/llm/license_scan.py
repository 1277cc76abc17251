"""License notices in texts, with a few letters wrong.

A notice that stands in a text with at most k edits has one of k + 1 pieces
untouched.  One automaton finds the pieces of all notices in a text's words;
around each find the regex library looks for the whole notice with at most k
edits.  Only places with a piece are looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked_search import FOLD
from .shared import lean, parts, short_batches

#: Letters of a notice per edit that is allowed in it.
LETTERS_PER_EDIT = 10

# The phrases whose exact places are counted, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Short notices and names of further licenses, as words.
NOTICES = [
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("sil open font license", "ofl"),
    ("bsd 2 clause license", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("all rights reserved", "all-rights-reserved"),
]


@dataclass(frozen=True)
class Notice:
    """``words`` with single spaces; ``edits`` letters may be wrong."""

    words: str
    label: str
    edits: int
    base: bool

    def pieces(self) -> Iterator[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces of about one length."""
        n = len(self.words)
        cuts = [n * i // (self.edits + 1) for i in range(self.edits + 2)]
        for a, b in zip(cuts, cuts[1:]):
            yield a, self.words[a:b]


def all_notices() -> tuple[Notice, ...]:
    given = [(w, label, True) for w, label in BASE] + [(w, label, False) for w, label in NOTICES]
    return tuple(Notice(w, label, len(w) // LETTERS_PER_EDIT, base) for w, label, base in given)


@dataclass(frozen=True)
class Match:
    """A notice in a text's words joined by single spaces: [start, stop)."""

    notice: Notice
    start: int
    stop: int
    edits: int

    @property
    def closeness(self) -> float:
        return 1 - self.edits / len(self.notice.words)


class Finder:
    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        seeds: dict[str, list[tuple[Notice, int]]] = {}
        for notice in notices:
            for offset, piece in notice.pieces():
                seeds.setdefault(piece, []).append((notice, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()
        # Whole words, the best of what a window holds.
        self.patterns = {n: regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") for n in notices if n.edits}
        self.verify = lru_cache(maxsize=65_536)(self._verify)

    def _verify(self, notice: Notice, window: str) -> tuple[int, int, int] | None:
        """(start, stop, edits) of the best match in a window."""
        found = self.patterns[notice].search(window)
        return found and (*found.span(), sum(found.fuzzy_counts))

    def find(self, joined: str) -> list[Match]:
        """All exact places of the notices, and places with edits that overlap
        no closer one of the same notice."""
        exact: set[tuple[Notice, int]] = set()
        near: set[Match] = set()
        tried: set[tuple[Notice, int]] = set()
        for last, (length, of) in self.seeds.iter(joined):
            for notice, offset in of:
                start = last + 1 - length - offset
                stop, k = start + len(notice.words), notice.edits
                if (notice, start) in tried:
                    continue
                tried.add((notice, start))
                if joined.startswith(notice.words, start) and start >= 0 and joined[start - 1 : start] in ("", " ") and joined[stop : stop + 1] in ("", " "):
                    exact.add((notice, start))
                elif k:
                    # Whole words that a match through this piece may have.
                    a = joined.rfind(" ", 0, max(start - k, 0)) + 1
                    b = joined.find(" ", stop + k)
                    if found := self.verify(notice, joined[a : b if b >= 0 else len(joined)]):
                        near.add(Match(notice, a + found[0], a + found[1], found[2]))
        out = [Match(n, at, at + len(n.words), 0) for n, at in exact]
        taken: dict[Notice, list[tuple[int, int]]] = {}
        for m in out:
            taken.setdefault(m.notice, []).append((m.start, m.stop))
        spans = {n: sorted(s) for n, s in taken.items()}
        for m in sorted(near, key=lambda m: (m.edits, m.start, m.stop, m.notice.words)):
            own = spans.setdefault(m.notice, [])
            at = bisect_right(own, (m.start, m.stop))
            if (at and own[at - 1][1] > m.start) or (at < len(own) and own[at][0] < m.stop):
                continue
            own.insert(at, (m.start, m.stop))
            out.append(m)
        return sorted(out, key=lambda m: (m.start, m.stop, m.notice.label, m.notice.words))


@lru_cache(maxsize=2)
def finder(notices: tuple[Notice, ...]) -> Finder:
    return Finder(notices)


#: A match, for Spark and for Arrow.
MATCHES = "array<struct<label:string,notice:string,first_word:long,last_word:long,start:long,stop:long,edits:int,base:boolean,closeness:double>>"

ARROW_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), *((n, pa.int64()) for n in ("first_word", "last_word", "start", "stop")), ("edits", pa.int32()), ("base", pa.bool_()), ("closeness", pa.float64())]))


def scan_text(text: str, search: Finder) -> tuple[int, list[dict]]:
    """The number of words of a text and its notices as rows of MATCHES."""
    words = text.encode().translate(FOLD).split()
    joined = b" ".join(words).decode()
    found = search.find(joined)
    if not found:
        return len(words), []
    import regex

    # A word stands for itself in the text, where any other marks may lie between them.
    ends = list(accumulate(map(len, joined.split(" ")), lambda a, n: a + n + 1))
    spans = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    rows = []
    for m in found:
        a, b = bisect_right(ends, m.start), bisect_right(ends, m.stop - 1)
        rows.append({"label": m.notice.label, "notice": m.notice.words, "first_word": a, "last_word": b, "start": spans[a][0], "stop": spans[b][1], "edits": m.edits, "base": m.notice.base and not m.edits, "closeness": m.closeness})
    return len(words), rows


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, matches) of every whole text; null counts as empty.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased.  A match has the notice and its label, its first
    and last word (from 0), its span in the text (code points, ``stop``
    exclusive), how many letters are wrong, whether it is a base phrase
    without any, and how close it is (1: exact).  A text has all places of
    its notices that are exact, and of those with edits the closest wherever
    several of one notice overlap, the first among equals.

    Very long texts are searched whole, in time that grows with them.  Empty
    texts and tables have no matches; null and repeated doc_ids stay, a row
    each; other columns are not read.  No row leaves its task.
    """
    short_batches(docs.sparkSession)
    notices = notices or all_notices()

    @lean("license_scan", finder.cache_clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = finder(notices)
        for batch in batches:
            for part in parts(batch, 1):
                n, rows = zip(*(scan_text(t, search) for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(rows, ARROW_MATCHES)], ["doc_id", "n_words", "matches"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id long, n_words long, matches {MATCHES}")


def labels_of(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans) of :func:`license_scan`'s rows: the base phrases' places, the
    smallest and largest word they begin at (null without any), labels sorted
    and joined, and how close the closest notice is (0 without any)."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first_word"])
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["start"].cast("string"), m["stop"].cast("string"), m["edits"].cast("string")))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["closeness"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(F.col("matches")).alias("labels"), best.alias("score"), F.array_join(spans, ",").alias("spans"),
    )
