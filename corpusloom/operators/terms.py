"""Controlled terms in texts, found by one automaton over all of them.

The terms come as a table.  Their phrases, in one case, make an automaton whose
failure links lead from a phrase that breaks off to the longest ending that
another one begins with, so a text is read once however many terms there are.
What it finds is held against the exact pattern of the term.
"""

from __future__ import annotations

import re
import uuid
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .batches import slices, small_batches

#: Terms of one automaton, which each worker holds; more terms take a reading of the texts for each so many.
TERMS = 200_000

# A link and its target; a link of any kind; a phrase stands as whole words, in any case.
LINKED = re.compile(r"\[\[([^\]|]*)[^\]]*\]\]")
PHRASE = r"(?<!\w){}(?!\w)"


class Fold(dict):
    """One case for all letters that a pattern in any case takes for each
    other, one character for each."""

    # Letters whose other case has several characters.
    ODD = {"İ": "i", "ΐ": "ΐ", "ΰ": "ΰ", "ﬅ": "ﬆ"}

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper()
        lower = (upper if len(upper) == 1 else c).lower()
        self[code] = made = self.ODD.get(c) or (lower if len(lower) == 1 else c)
        return made


_FOLD = Fold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


@lru_cache(maxsize=65_536)
def phrase(surface: str) -> re.Pattern:
    return re.compile(PHRASE.format(re.escape(surface)), re.IGNORECASE)


def opened(body: str) -> tuple[set[str], str]:
    """The targets of a body's links, in lower case, and a copy of the body in
    which the links are blanked and everything else keeps its place."""
    targets, free, end = set(), [], 0
    for m in LINKED.finditer(body):
        targets.add(m[1].strip().lower())
        free += [body[end : m.start()], "\0" * len(m[0])]
        end = m.end()
    return targets, "".join([*free, body[end:]])


class Vocabulary:
    """Terms (slug, surface) in order, and the automaton of their phrases."""

    def __init__(self, terms: list[tuple[str, str]]):
        import ahocorasick

        self.terms = terms
        by_phrase: dict[str, list[int]] = {}
        for i, (_, surface) in enumerate(terms):
            if surface:
                by_phrase.setdefault(fold(surface), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for words, of in by_phrase.items():
            self.automaton.add_word(words, (len(words), of))
        if by_phrase:
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """(start, terms) wherever a phrase's letters stand, in any case."""
        if len(self.automaton):
            for last, (length, of) in self.automaton.iter(fold(text)):
                yield last + 1 - length, of

    def free(self, term: int, targets: set[str]) -> bool:
        slug, surface = self.terms[term]
        return targets.isdisjoint((slug.lower(), surface.lower()))

    def mentioned(self, body: str) -> list[int]:
        """The terms that a body mentions and does not link, each on its own."""
        targets, text = opened(body)
        found: set[int] = set()
        for start, of in self.places(text):
            for term in of:
                if term not in found and phrase(self.terms[term][1]).match(text, start):
                    found.add(term)
        return [t for t in sorted(found) if self.free(t, targets)]

    def link(self, body: str) -> tuple[str, list[str]]:
        """The body with each term linked once, in order, each seeing the links
        before it; and the slugs that were linked.

        A phrase that is linked is blanked, and all links are put in at the end.
        """
        targets, text = opened(body)
        where: dict[int, list[int]] = {}
        for start, of in self.places(text):
            for term in of:
                where.setdefault(term, []).append(start)
        done: list[tuple[int, int, str]] = []
        linked: list[str] = []
        for term in sorted(where):
            slug, surface = self.terms[term]
            if not self.free(term, targets):
                continue
            m = next((m for at in sorted(where[term]) if (m := phrase(surface).match(text, at))), None)
            if m:
                insort(done, (m.start(), m.end(), slug))
                linked.append(slug)
                targets.add(slug.lower())
                text = text[: m.start()] + "\0" * len(m[0]) + text[m.end() :]
        out, end = [], 0
        for start, stop, slug in done:
            said = body[start:stop]
            out += [body[end:start], f"[[{slug}]]" if said == slug else f"[[{slug}|{said}]]"]
            end = stop
        return "".join([*out, body[end:]]), linked


_vocabulary: tuple[str, Vocabulary | None] = ("", None)


def vocabulary(name: str, terms) -> Vocabulary:
    """The vocabulary of a broadcast, built once in each worker."""
    global _vocabulary
    if _vocabulary[0] != name:
        _vocabulary = (name, Vocabulary([(slug, surface) for slug, surface in terms.value]))
    return _vocabulary[1]


def in_groups(notes: DataFrame, terms: DataFrame | list[tuple[str, str]], size: int = TERMS) -> list[tuple[str, object]]:
    """The terms (slug, surface), by slug and surface or in the order of a
    column ``ord`` or a list, as broadcasts of at most ``size`` terms."""
    spark = notes.sparkSession
    if isinstance(terms, list):
        rows = terms
        groups = [rows[i : i + size] for i in range(0, len(rows), size)]
        return [(uuid.uuid4().hex, spark.sparkContext.broadcast(g)) for g in groups]
    terms = terms.where("slug is not null and surface is not null")
    order = [c for c in ("ord", "slug", "surface") if c in terms.columns]
    made, after, n = [], 0, terms.count()
    while after < n:
        # A page of the sorted terms at a time: no more than a group reaches the driver.
        page = terms.orderBy(*order).offset(after).limit(size).select("slug", "surface").toArrow().to_pydict()
        made.append((uuid.uuid4().hex, spark.sparkContext.broadcast(list(zip(page["slug"], page["surface"], strict=True)))))
        after += size
    return made


def link(notes: DataFrame, terms: DataFrame | list[tuple[str, str]], id_: str, body: str, size: int = TERMS) -> DataFrame:
    """(id, new_body, linked) of every note; a group of terms sees the links of those before it."""
    small_batches(notes.sparkSession)
    rows = notes.select(id_, F.coalesce(body, F.lit("")).alias("new_body"), F.array().cast("array<string>").alias("linked"))
    shape = StructType([rows.schema.fields[0], StructField("new_body", StringType()), StructField("linked", ArrayType(StringType()))])
    for name, group in in_groups(notes, terms, size):

        def run(batches: Iterator[pa.RecordBatch], name=name, group=group) -> Iterator[pa.RecordBatch]:
            known = vocabulary(name, group)
            for batch in (s for b in batches for s in slices(b)):
                bodies, linked = zip(*(known.link(b) for b in batch.column(1).to_pylist()), strict=True)
                before = batch.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array([a + b for a, b in zip(before, linked, strict=True)], pa.list_(pa.string()))], [id_, "new_body", "linked"])

        rows = rows.mapInArrow(run, shape)
    return rows


def unlinked(notes: DataFrame, terms: DataFrame | list[tuple[str, str]], id_: str, body: str, size: int = TERMS) -> DataFrame:
    """(id, slug, surface) of terms that notes mention and don't link."""
    small_batches(notes.sparkSession)
    rows = notes.select(id_, F.coalesce(body, F.lit("")).alias("body"))
    shape = StructType([rows.schema.fields[0], StructField("slug", StringType()), StructField("surface", StringType())])
    found = notes.sparkSession.createDataFrame([], shape)
    for name, group in in_groups(notes, terms, size):

        def run(batches: Iterator[pa.RecordBatch], name=name, group=group) -> Iterator[pa.RecordBatch]:
            known = vocabulary(name, group)
            for batch in (s for b in batches for s in slices(b)):
                at, terms = [], []
                for i, b in enumerate(batch.column(1).to_pylist()):
                    said = known.mentioned(b)
                    at += [i] * len(said)
                    terms += said
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([known.terms[t][0] for t in terms], pa.string()), pa.array([known.terms[t][1] for t in terms], pa.string())], [id_, "slug", "surface"])

        found = found.unionByName(rows.mapInArrow(run, shape))
    return found
