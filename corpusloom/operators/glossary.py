"""Controlled terms: keys, lookup, suggestions, link insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_key, split_frontmatter_strict, strip_lead_in
from . import spelling
from .tags import capped
from .terms import Vocabulary, link, unlinked

SUGGESTIONS, CUTOFF, FUZZY = 3, 0.6, 5


def key_index(terms: DataFrame) -> DataFrame:
    """(key, slug, display) of terms (slug, display, aliases): the normalised
    slug and aliases; of terms with one key the first by slug has it."""
    names = F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = terms.select("slug", "display", F.posexplode(F.transform(names, normalise_key)).alias("ordinal", "key")).where("key <> ''")
    first = F.row_number().over(Window.partitionBy("key").orderBy("slug", "ordinal"))
    return keys.withColumn("_first", first).where("_first = 1").select("key", "slug", "display")


def key_collisions(terms: DataFrame) -> DataFrame:
    """(key, slugs) of keys that several terms want."""
    names = F.concat(F.array("slug"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = terms.select("slug", F.explode(F.transform(names, normalise_key)).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.array_sort(F.collect_set("slug")).alias("slugs")).where(F.size("slugs") > 1)


def lookup(asked: DataFrame, keys: DataFrame, term: str = "term") -> DataFrame:
    """(term, slug, display) by the normalised term, else without a question's
    words around it; null if neither is a key."""
    one = keys.select(F.col("key").alias("k1"), F.col("slug").alias("s1"), F.col("display").alias("d1"))
    two = keys.select(F.col("key").alias("k2"), F.col("slug").alias("s2"), F.col("display").alias("d2"))
    q = asked.select(term).withColumn("k1", normalise_key(F.col(term))).withColumn("k2", strip_lead_in(F.col("k1")))
    found = q.join(one, "k1", "left").join(two, "k2", "left")
    return found.select(term, F.coalesce("s1", "s2").alias("slug"), F.coalesce("d1", "d2").alias("display"))


def listing(terms: DataFrame, match: str = "", cap: int = 50) -> DataFrame:
    """(slug, display, aliases, total, truncated): the first ``cap`` terms by
    slug of those that have ``match`` in the term or an alias, in any case."""
    m = match.lower()
    found = F.lower("display").contains(m) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(m))
    return capped(terms.select("slug", "display", "aliases").where(found), cap, F.col("slug"))


def suggest(asked: DataFrame, keys: DataFrame, term: str = "term", n: int = SUGGESTIONS) -> DataFrame:
    """(term, rank, display): the closest terms to one that is no key: those
    that begin alike, then those inside each other, then similar spellings.

    Questions and keys meet only where one may be inside the other or their
    letters allow for the similarity; see :mod:`.spelling`.
    """
    q = asked.select(term).distinct().withColumn("asked", strip_lead_in(normalise_key(F.col(term)))).where("asked <> ''")
    near = spelling.similar(q.select("asked").distinct(), keys.select("key").distinct(), CUTOFF)
    found = q.join(near, "asked").join(keys.select("key", "display", F.struct("slug", "key").alias("place")), "key")
    a, k = F.col("asked"), F.col("key")
    by_close = Window.partitionBy(term).orderBy(F.col("close").desc(), F.col("key").desc())
    tiers = found.withColumn("near", F.row_number().over(by_close)).withColumn(
        "tier",
        F.when(k.startswith(a) | a.startswith(k), 1).when(k.contains(a) | a.contains(k), 2).when((F.col("close") >= CUTOFF) & (F.col("near") <= FUZZY), 3),
    )
    order = F.struct("tier", F.when(F.col("tier") == 3, F.col("near")).otherwise(0), "place")
    best = tiers.where("tier is not null").groupBy(term, "display").agg(F.min(order).alias("order"))
    rank = F.row_number().over(Window.partitionBy(term).orderBy("order"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select(term, "rank", "display")


def surfaces(terms: DataFrame) -> DataFrame:
    """(slug, surface) of glossary terms (slug, display): what a text calls them."""
    return terms.select("slug", F.col("display").alias("surface")).where("slug is not null and surface <> ''")


def link_terms_in(body: str, terms: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """One body with each term (slug, surface) linked once, in order, and the slugs that were linked."""
    return Vocabulary(terms).link(body)


def link_terms(notes: DataFrame, terms: DataFrame | list[tuple[str, str]], id_: str = "source_file", body: str = "body") -> DataFrame:
    """(id, new_body, linked): each note's body with the glossary's ``terms``
    (slug, surface) linked; order matters within a note, notes are independent.
    A table of terms is taken by a column ``ord`` if it has one, then by slug."""
    return link(notes, terms, id_, body)


def unlinked_report(notes: DataFrame, terms: DataFrame | list[tuple[str, str]], id_: str = "source_file", body: str = "body") -> DataFrame:
    """(id, slug): terms (slug, surface) that a note mentions and does not link,
    each term on its own.  What a link says is no mention.  A note without id has no rows.
    """
    return unlinked(notes.where(F.col(id_).isNotNull()), terms, id_, body).select(id_, "slug")


def link_notes_to_terms(notes: DataFrame, terms: DataFrame, id_: str = "source_file", text: str = "text") -> DataFrame:
    """(id, new_text, linked) of the notes that get links to glossary terms
    (slug, display): a note's head stays as it is, only its body is linked."""
    return link_notes_by(notes, surfaces(terms), id_, text)


def link_notes_by(notes: DataFrame, listed: DataFrame, id_: str = "source_file", text: str = "text") -> DataFrame:
    """:func:`link_notes_to_terms` for what texts call the terms (slug, surface)."""
    split = notes.select(id_, text, split_frontmatter_strict(F.col(text)).alias("parts"))
    made = link(split.select(F.struct(id_, F.coalesce("parts.head", F.lit("")).alias("head")).alias("key"), F.col("parts.body").alias("body")), listed, "key", "body")
    return made.where(F.size("linked") > 0).select(F.col("key")[id_].alias(id_), F.concat("key.head", "new_body").alias("new_text"), "linked")
