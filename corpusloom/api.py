"""The entry points that compose the operators, one per task of a user."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.embedding import Embedder, HashEmbedder
from .operators import audit as _audit
from .operators import blocks, cells, changes, chunking, glossary, graph, tags
from .operators import search as _search
from .settings import Settings
from .sources.index import Draft, Part, VersionedTable

VECTOR_ROWS = "source_file string, backend string, content_hash string, vector array<double>, embedded_at timestamp"
PASSAGE_ROWS = "id long, source_file string, backend string, content_hash string, chunk_tokens int, chunk_overlap double, chunk_id int, page int, char_start int, char_end int, text string, vector array<double>"
#: Decimals of a score as a user sees it.
SCORE_DIGITS = 4


def embed_notes(notes: DataFrame, stored: DataFrame | None = None, embedder: Embedder = HashEmbedder(), force: bool = False) -> DataFrame:
    """Vector rows (VECTOR_ROWS) of the notes (source_file, text) whose body or
    backend differs from what is ``stored``; the others are not embedded again."""
    # The body is named twice here, so it is made once and not wherever it is used.
    now = notes.select("source_file", T.canonical_body(F.col("text")).alias("body"))
    now = now.select("source_file", F.lit(embedder.name).alias("backend"), T.raw_hash(F.col("body")).alias("content_hash"), "body")
    if stored is not None:
        now = _audit.change_gate(now, stored, ["source_file", "backend", "content_hash"], force)
    made = embedder.embed(now, "body", "vector", "document")
    stamp = F.lit(None).cast("timestamp") if embedder.deterministic else F.current_timestamp()
    return made.select("source_file", "backend", "content_hash", "vector", stamp.alias("embedded_at"))


def ingest_paged_source(pages: DataFrame, stored: DataFrame | None = None, settings: Settings = Settings(), embedder: Embedder = HashEmbedder(), force: bool = False) -> DataFrame:
    """Chunk rows of paged sources (source_file, page, text): source_file,
    backend, content_hash, chunk_tokens, chunk_overlap, chunk_id, page,
    char_start, char_end, text, vector.  A source is done again if its text,
    the backend or the parameters differ from what is ``stored``."""
    docs = chunking.paged_documents(pages, "source_file", "page", "text")
    docs = docs.select("source_file", "spans", "text", F.lit(embedder.name).alias("backend"), T.raw_hash(F.col("text")).alias("content_hash"), F.lit(settings.chunk_tokens).alias("chunk_tokens"), F.lit(float(settings.chunk_overlap)).alias("chunk_overlap"))
    if stored is not None:
        docs = _audit.change_gate(docs, stored, ["source_file", "backend", "content_hash", "chunk_tokens", "chunk_overlap"], force)
    chunks = chunking.chunk_documents(docs, tokens=settings.chunk_tokens, overlap=settings.chunk_overlap, spans="spans")
    return embedder.embed(chunks, "text", "vector", "document")


def numbered(rows: DataFrame, first: int = 0) -> DataFrame:
    """``rows`` with a number of its own each, from ``first`` on, with gaps.
    Write the result before use: a repeated task may number anew."""
    return rows.withColumn("id", F.monotonically_increasing_id() + F.lit(first))


def next_number(rows: DataFrame) -> int:
    """The number after the largest ``id``; 0 for an empty table."""
    return rows.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]


def put_postings(draft: Draft, fresh: DataFrame, *texts, gone: DataFrame | None = None) -> None:
    """Write the inverted index: of ``fresh`` (id and the columns ``texts``)
    alone or, given the ids that are ``gone``, with the old version's others,
    whose terms are stored and whose texts are not read again."""
    terms = blocks.listed(fresh, "id", *texts)
    if gone is not None:
        terms = draft.table.read("terms", draft.base).join(gone, "id", "left_anti").select("id", "terms").unionByName(terms)
    blocks.build(terms, draft.put)


def stored_postings(table: VersionedTable) -> blocks.BlockIndex:
    version = table.version
    return blocks.BlockIndex(*(table.read(part, version) for part in ("terms", "postings")))


def put_cells(draft: Draft, vectors: DataFrame) -> None:
    """Write the inverted file of vectors (id, vector).  The old version's
    centroids serve until there are twice as many vectors as they were taught for."""
    points = None
    if draft.base is not None:
        old = draft.table.read("centroids", draft.base).orderBy("cell").collect()  # at most cells.MOST_CELLS rows
        if old and vectors.count() <= 2 * sum(r.n for r in old):
            points = np.array([r.centroid for r in old])
    cells.build(vectors.select("id", "vector"), draft.put, points)


def stored_cells(table: VersionedTable) -> cells.VectorIndex:
    version = table.version
    return cells.VectorIndex(*(table.read(part, version) for part in ("centroids", "cells")))


def check_dimension(vectors: DataFrame, dim: int) -> None:
    if vectors.where(F.size("vector") != dim).limit(1).count():
        raise ValueError(f"a vector does not have {dim} values")


@dataclass(frozen=True)
class NoteIndex:
    """Vectors, bodies and postings of notes: parts of one version, which
    readers see change together.  A note has a number, which it keeps."""

    spark: SparkSession
    path: str

    @property
    def table(self) -> VersionedTable:
        return VersionedTable(self.spark, self.path)

    @property
    def vectors(self) -> Part:
        return Part(self.table, "vectors")

    @property
    def bodies(self) -> Part:
        return Part(self.table, "bodies")

    def build(self, notes: DataFrame, vectors: DataFrame, dim: int = 768) -> None:
        """Load everything anew; a vector of another length is refused."""
        draft, rows = self.table.draft(), self._rows(notes)
        # Vectors are made once: what is refused is a draft, which no reader sees.
        vectors = draft.put("made", vectors)
        check_dimension(vectors, dim)
        keys = draft.put("keys", numbered(vectors.select("source_file").union(rows.select("source_file")).distinct()))
        put_cells(draft, draft.put("vectors", vectors.join(keys, "source_file")))
        bodies = draft.put("bodies", rows.join(keys, "source_file"))
        put_postings(draft, bodies, "body", self._tags())
        draft.commit()

    def apply(self, feed: DataFrame, notes: DataFrame, embedder: Embedder = HashEmbedder()) -> None:
        """Follow a change feed (status, path, new_path, seq); ``notes`` has the
        present texts.  A changed note without text loses its lexical row; its
        vector row stays until it is deleted or has a text again.  Only what
        the feed touches is embedded and indexed again."""
        draft = self.table.draft()
        net = draft.put("changes", changes.net_changes(feed).withColumnRenamed("path", "source_file"))
        touched = notes.join(net.where("op = 'upsert'").select("source_file"), "source_file", "left_semi").where("text is not null")
        fresh = draft.put("fresh", embed_notes(touched, embedder=embedder))
        old = lambda part: self.table.read(part, draft.base)
        known = old("keys")
        new = fresh.select("source_file").distinct().join(known, "source_file", "left_anti")
        # Numbers of deleted notes go; their successors get larger ones.
        left = known.join(net.where("op = 'delete'"), "source_file", "left_anti")
        keys = draft.put("keys", left.unionByName(numbered(new, next_number(known))))
        gone = net.where("op = 'delete'").unionByName(net.join(fresh, "source_file", "left_semi")).select("source_file").distinct()
        kept = old("vectors").join(gone, "source_file", "left_anti")
        put_cells(draft, draft.put("vectors", kept.unionByName(fresh.join(keys, "source_file").select(*kept.columns))))
        rows = self._rows(touched).join(keys, "source_file")
        bodies = old("bodies").join(net, "source_file", "left_anti")
        bodies = draft.put("bodies", bodies.unionByName(rows.select(*bodies.columns)))
        put_postings(draft, bodies.join(net, "source_file", "left_semi"), "body", self._tags(), gone=known.unionByName(keys).join(net, "source_file", "left_semi").select("id").distinct())
        draft.commit()

    def search(self, queries: DataFrame, settings: Settings = Settings(), embedder: Embedder = HashEmbedder()) -> DataFrame:
        """(query_id, rank, source_file, score) for queries (query_id, text);
        without an index an error."""
        vectors = self.vectors.read()
        index = stored_postings(self.table) if settings.hybrid else None
        asked = embedder.embed(queries.select("query_id", "text"), "text", "vector", "query")
        hits = _search.search(asked, stored_cells(self.table), index, settings)
        return hits.join(vectors.select("id", "source_file"), "id").select("query_id", "rank", "source_file", F.round("score", SCORE_DIGITS).alias("score"))

    @staticmethod
    def _rows(notes: DataFrame) -> DataFrame:
        return notes.select("source_file", T.canonical_body(F.col("text")).alias("body"), T.parse_tags(F.col("text")).alias("tags"))

    @staticmethod
    def _tags() -> Column:
        return F.array_join("tags", " ")


@dataclass(frozen=True)
class PassageIndex:
    """Passages of chunked sources with their vectors and postings: parts of
    one version.  Every passage has a number of its own."""

    spark: SparkSession
    path: str

    @property
    def table(self) -> VersionedTable:
        return VersionedTable(self.spark, self.path)

    def read(self) -> DataFrame:
        """The passages; none before the first load."""
        if self.table.version is None:
            return self.spark.createDataFrame([], PASSAGE_ROWS)
        return self.table.read("passages")

    def load(self, rows: DataFrame, dim: int = 768) -> None:
        """Load everything anew from rows as :func:`ingest_paged_source` gives
        them; a vector of another length is refused."""
        self._write(rows, None, dim)

    def update(self, rows: DataFrame, dim: int = 768) -> None:
        """Replace the passages of the sources that ``rows`` has."""
        self._write(rows, None, dim, update=True)

    def remove(self, sources: DataFrame) -> None:
        """Take out the passages of sources (source_file)."""
        self._write(self.read().drop("id").limit(0), sources.select("source_file").distinct(), None)

    def clear(self) -> None:
        self._write(self.read().drop("id").limit(0), None, None)

    def sources(self) -> DataFrame:
        return self.read().select("source_file").distinct()

    def stats(self) -> DataFrame:
        """(n_chunks, max_id) as one row; 0 and 0 for an empty index."""
        return self.read().agg(F.count("*").alias("n_chunks"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))

    def fetch(self, source_file: str, chunk_id: int) -> DataFrame:
        return _search.fetch_passage(self.read(), source_file, chunk_id).drop("vector", "id")

    def search(self, queries: DataFrame, settings: Settings = Settings(), embedder: Embedder = HashEmbedder(), mode: str = "best_per_source", source: str | None = None) -> DataFrame:
        """(query_id, rank, source_file, chunk_id, page, snippet, score) of the
        best passages for queries (query_id, text); none without an index."""
        asked = embedder.embed(queries.select("query_id", "text"), "text", "vector", "query")
        stored = self.table.version is not None
        index = stored_postings(self.table) if settings.hybrid and stored else None
        vectors = stored_cells(self.table) if stored else None
        return _search.search_passages(asked, self.read(), index, settings, mode, source, vectors=vectors).withColumn("score", F.round("score", SCORE_DIGITS))

    def _write(self, rows: DataFrame, replaced: DataFrame | None, dim: int | None, update: bool = False) -> None:
        """Write ``rows`` beside the passages of other sources than those
        ``replaced``, or than their own in an ``update``; else alone."""
        draft = self.table.draft()
        names = [f.split()[0] for f in PASSAGE_ROWS.split(", ") if f != "id long"]
        alone = draft.base is None or (replaced is None and not update)
        old = None if alone else self.table.read("passages", draft.base)
        first = 1 if alone else max(next_number(old), 1)
        # Passages are made once: what is refused is a draft, which no reader sees.
        fresh = draft.put("passages" if alone else "fresh", numbered(rows.select(*names), first))
        if dim is not None:
            check_dimension(fresh, dim)
        if alone:
            put_cells(draft, fresh)
            put_postings(draft, fresh, "text")
        else:
            replaced = fresh.select("source_file").distinct() if update else replaced
            gone = old.join(replaced, "source_file", "left_semi").select("id")
            kept = old.join(replaced, "source_file", "left_anti")
            put_cells(draft, draft.put("passages", kept.unionByName(fresh)))
            put_postings(draft, fresh, "text", gone=gone)
        draft.commit()


def ingest_summary(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_file, pages, chunks) of an ingest: counts of its pages and of
    the passages made of them, 0 for a source without words."""
    p = pages.groupBy("source_file").agg(F.count("*").alias("pages"))
    c = rows.groupBy("source_file").agg(F.count("*").alias("chunks"))
    return p.join(c, "source_file", "left").select("source_file", "pages", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def link_notes(notes: DataFrame, vectors: DataFrame, settings: Settings = Settings(), mutual: bool = True) -> DataFrame:
    """(source_file, new_text) of the notes whose related block changes; notes
    without links lose theirs.  ``vectors`` has source_file, vector."""
    v = numbered(vectors.select("source_file", "vector")).checkpoint()  # in the folder of spark.checkpoint.dir
    links = graph.select_links(graph.neighbors(v.select("id", "vector"), settings.neighbors), settings.max_distance, mutual)
    names = graph.link_names(links, v.select("id", T.stem(F.col("source_file")).alias("name"))).join(v.select(F.col("id").alias("src"), "source_file"), "src")
    all_ = notes.join(names.select("source_file", "names"), "source_file", "left")
    new = graph.apply_links(F.col("text"), F.coalesce("names", F.array().cast("array<string>")))
    return all_.select("source_file", "text", new.alias("new_text")).where("new_text <> text").select("source_file", "new_text")


def check_term(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, slug, taken_by, near): whether a new term's key is taken, and the
    terms that it may be meant to be."""
    keys = glossary.key_index(terms)
    q = asked.select("term", T.normalise_key(F.col("term")).alias("slug"))
    taken = q.join(keys.select(F.col("key").alias("slug"), F.col("display").alias("taken_by")), "slug", "left")
    near = glossary.suggest(asked, keys).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("rank", "display"))).alias("n"))
    return taken.join(near, "term", "left").select("term", "slug", "taken_by", F.coalesce(F.transform("n", lambda x: x["display"]), F.array().cast("array<string>")).alias("near"))


def add_terms(asked: DataFrame, terms: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New glossary terms (term, definition, aliases) beside ``terms`` (slug,
    display, aliases), and the notes (source_file, text) that mention them.

    Gives (term, slug, refused, near, text): why a term is refused, if it is
    (its name or an alias is empty, taken, or asked for twice), terms that it
    may be meant to be, and its note's text; and (source_file, new_text,
    linked): the notes with the first mention of each accepted term and of its
    aliases linked.
    """
    keys = glossary.key_index(terms)
    none = F.array().cast("array<string>")
    q = asked.select("term", "definition", F.coalesce("aliases", none).alias("aliases"), T.normalise_key(F.col("term")).alias("slug"))
    named = q.select("term", "slug", F.explode(F.concat(F.array("term"), "aliases")).alias("surface")).withColumn("key", T.normalise_key(F.col("surface"))).where("key <> ''")
    taken = named.join(keys.select("key", F.col("slug").alias("by")), "key").groupBy("term").agg(F.min(F.struct("key", "by")).alias("t"))
    twice = named.select("key", "term").distinct().groupBy("key").agg(F.min("term").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = named.join(twice, "key").where("term <> first").groupBy("term").agg(F.min("key").alias("again"))
    hints = glossary.suggest(named.select(F.col("surface").alias("term")).distinct(), keys)
    near = named.join(hints.withColumnRenamed("term", "surface"), "surface").groupBy("term").agg(F.array_sort(F.collect_set("display")).alias("near"))
    refused = F.when(F.col("slug") == "", "it has no usable characters").when(F.col("t").isNotNull(), F.concat("t.key", F.lit(" is taken by "), "t.by")).when(F.col("again").isNotNull(), F.concat("again", F.lit(" is asked for twice")))
    text = T.term_note(F.col("term"), F.col("definition"), F.col("aliases"))
    made = q.join(taken, "term", "left").join(later, "term", "left").join(near, "term", "left").select("term", "slug", "aliases", refused.alias("refused"), F.coalesce("near", none).alias("near"), text.alias("text"))
    # A term goes before its aliases, which link to it as well.
    surfaces = made.where("refused is null").select("slug", F.posexplode(F.concat(F.array("term"), "aliases")).alias("place", "surface"))
    listed = surfaces.select("slug", "surface", F.struct("slug", "place").alias("ord"))
    return made.drop("aliases"), glossary.link_notes_by(notes, listed)


def check_intake(asked: DataFrame, existing: DataFrame, root: str, suffix: str = ".pdf") -> DataFrame:
    """(path, source_file, refused) of files (path) that are to go below a
    root: their place, and why one is refused, if it is: its suffix, a name
    that ``existing`` (source_file) has or that another file takes first."""
    if root not in T.ROOTS:
        raise ValueError(f"root is one of {T.ROOTS}, not {root!r}")
    name = F.element_at(F.split("path", "/"), -1)
    rows = asked.select("path", F.concat(F.lit(f"vault/{root}/"), name).alias("source_file"))
    first = rows.groupBy("source_file").agg(F.min("path").alias("first"))
    known = existing.select("source_file", F.lit(True).alias("known")).distinct()
    refused = F.when(~F.lower("path").endswith(suffix), F.concat(F.lit("not a "), F.lit(suffix))).when(F.col("known"), "destination exists").when(F.col("path") != F.col("first"), "another file takes this name")
    return rows.join(first, "source_file").join(known, "source_file", "left").select("path", "source_file", refused.alias("refused"))


def compose_notes(asked: DataFrame, existing: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(title, slug, exists, text, hints) of new notes (title, body, tags): their
    text, whether the name is taken, and tags that nearly exist."""
    q = asked.withColumn("slug", T.slugify_title(F.col("title")))
    q = q.join(existing.select(T.stem(F.col("source_file")).alias("slug"), F.lit(True).alias("taken")).distinct(), "slug", "left")
    hints = tags.write_hints(asked.select(F.explode("tags").alias("tag")).distinct(), vocabulary)
    own = q.select("title", F.explode("tags").alias("tag")).join(hints, "tag").groupBy("title").agg(F.array_sort(F.collect_list(F.concat_ws(" ~ ", "tag", "first"))).alias("hints"))
    text = F.concat(F.lit("---\n"), T.tags_line(F.col("tags")), F.lit("\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return q.join(own, "title", "left").select("title", "slug", F.coalesce("taken", F.lit(False)).alias("exists"), text.alias("text"), F.coalesce("hints", F.array().cast("array<string>")).alias("hints"))
