"""Consistency of notes, sidecars and index, and what repairs it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE_REPAIRS = {
    "notes_wo_sidecar": "embed", "stale_hash": "embed", "mixed": "embed", "bad_dim": "embed", "unreadable": "embed",
    "orphan_sidecars": "drop_sidecar", "missing_from_db": "rebuild", "stale_in_db": "rebuild",
}


def layer_findings(notes: DataFrame, sidecars: DataFrame, rows: DataFrame | None, active: str, dim: int) -> DataFrame:
    """(kind, source_file): what disagrees between the layers.

    ``notes`` has source_file, content_hash; ``sidecars`` source_file, backend,
    content_hash, dim (null where unreadable); ``rows`` the index's
    source_file.  Without an index there is one finding db_missing, and every
    note with a sidecar is missing from it.
    """
    n = notes.select("source_file", F.col("content_hash").alias("now"), F.lit(True).alias("note"))
    s = sidecars.select("source_file", "backend", F.col("content_hash").alias("stored"), F.col("dim"), F.lit(True).alias("sidecar"))
    spark = notes.sparkSession
    r = (rows if rows is not None else spark.createDataFrame([], "source_file string").select(F.col("source_file").cast(notes.schema["source_file"].dataType))).select("source_file", F.lit(True).alias("row")).distinct()
    all_ = n.join(s, "source_file", "full").join(r, "source_file", "full")
    note, side, row = (F.coalesce(c, F.lit(False)) for c in ("note", "sidecar", "row"))
    readable = side & F.col("dim").isNotNull()
    kinds = {
        "notes_wo_sidecar": note & ~side,
        "orphan_sidecars": side & ~note,
        "missing_from_db": note & side & ~row,
        "stale_in_db": row & ~(note & side),
        "unreadable": side & F.col("dim").isNull(),
        "bad_dim": readable & (F.col("dim") != dim),
        "mixed": readable & ~F.col("backend").eqNullSafe(F.lit(active)),
        "stale_hash": readable & note & ~F.col("stored").eqNullSafe(F.col("now")),
    }
    found = all_.select("source_file", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))).alias("kind")).select("kind", "source_file")
    if rows is None:
        found = found.unionByName(notes.limit(1).select(F.lit("db_missing").alias("kind"), F.lit(None).cast(notes.schema["source_file"].dataType).alias("source_file")).limit(1))
    return found


def chunked_findings(sources: DataFrame, sidecars: DataFrame, rows: DataFrame | None, active: str, dim: int) -> DataFrame:
    """The same for chunked sources: orphan, mixed, bad_dim, stale,
    unverifiable (content_hash null: the text can't be read), missing_from_db.

    ``sidecars`` has source_file, backend, content_hash and dims, an array.
    """
    s = sidecars.select("source_file", "backend", F.col("content_hash").alias("stored"), "dims").join(sources.select("source_file", F.col("content_hash").alias("now"), F.lit(True).alias("here")), "source_file", "left")
    if rows is not None:
        s = s.join(rows.select("source_file", F.lit(True).alias("row")).distinct(), "source_file", "left")
    here = F.coalesce("here", F.lit(False))
    kinds = {
        "orphan": ~here,
        "mixed": ~F.col("backend").eqNullSafe(F.lit(active)),
        "bad_dim": F.exists("dims", lambda d: d != dim),
        "unverifiable": here & F.col("now").isNull(),
        "stale": here & F.col("now").isNotNull() & ~F.col("stored").eqNullSafe(F.col("now")),
    }
    if rows is not None:
        kinds["missing_from_db"] = here & F.col("row").isNull()
    return s.select("source_file", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))).alias("kind")).select("kind", "source_file")


def verdict(findings: DataFrame) -> DataFrame:
    """(kind, n) of the findings; a missing index counts once, not per note."""
    gone = findings.where("kind = 'db_missing'").limit(1).select(F.lit("missing_from_db").alias("kind"))
    return findings.join(gone, "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def repair_plan(findings: DataFrame) -> DataFrame:
    """(action, source_file): drop orphans, embed what is stale or broken and
    still there, rebuild the index rows of the rest."""
    table = F.create_map(*(F.lit(x) for kv in NOTE_REPAIRS.items() for x in kv))
    gone = findings.where("kind = 'orphan_sidecars'").select("source_file")
    acts = findings.select(F.element_at(table, F.col("kind")).alias("action"), "source_file").where("action is not null and source_file is not null").distinct()
    embed = acts.where("action = 'embed'").join(gone, "source_file", "left_anti").select("action", "source_file")
    return acts.where("action <> 'embed'").unionByName(embed)


def paged_repair_plan(findings: DataFrame) -> DataFrame:
    """(action, source_file) for :func:`chunked_findings`: sidecars of sources
    that are gone are dropped; a source that is still there is taken in again
    if its text, backend or dimension differs, and loaded if only its rows are
    missing.  What can't be verified is left alone."""
    f = findings.groupBy("source_file").agg(F.collect_set("kind").alias("kinds"))
    has = lambda *kinds: F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))
    action = F.when(has("orphan"), "drop_sidecar").when(has("stale", "mixed", "bad_dim"), "ingest").when(has("missing_from_db"), "load")
    return f.select(action.alias("action"), "source_file").where("action is not null")


def change_gate(now: DataFrame, stored: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows of ``now`` that the stored state does not have: by the source, the
    backend, the hash and, for chunked sources, the parameters."""
    return now if force else now.join(stored.select(*keys).distinct(), keys, "left_anti")


def long_documents(docs: DataFrame, text: str = "text", limit: int = 300, lines_name: str = "n_lines", path: str | None = None) -> DataFrame:
    """Documents with more than ``limit`` lines that aren't empty.  With their
    ``path``, only notes (``.md``) count, but no README.md and nothing below a
    folder named ``tasks``."""
    from ..functions.text import nonempty_lines

    if path is not None:
        p = F.split(path, "/")
        docs = docs.where(F.col(path).endswith(".md") & (F.element_at(p, -1) != "README.md") & ~F.array_contains(p, "tasks"))
    return docs.withColumn(lines_name, nonempty_lines(F.col(text))).where(F.col(lines_name) > limit)


def notes_under(notes: DataFrame, root: str, match: str = "", cap: int = 50, roots: list[str] | None = None) -> DataFrame:
    """(title, source_file, total, truncated): the first ``cap`` notes by path
    below ``root`` whose title, the file's name, has ``match`` in any case."""
    from ..functions.text import ROOTS, stem
    from .tags import capped

    if root not in (roots or ROOTS):
        raise ValueError(f"root is one of {roots or ROOTS}, not {root!r}")
    path = F.col("source_file")
    rows = notes.where(path.startswith(f"vault/{root}/") & path.endswith(".md")).select(stem(path).alias("title"), path)
    return capped(rows.where(F.lower("title").contains(match.lower())), cap, path)


def root_counts(notes: DataFrame, roots: list[str], root: str = "root") -> DataFrame:
    """(root, n) for every root, zero where it has no notes."""
    spark = notes.sparkSession
    known = spark.createDataFrame([(r,) for r in roots], "root string")
    n = notes.groupBy(F.col(root).alias("root")).agg(F.count("*").alias("n"))
    return known.join(n, "root", "left").select("root", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
