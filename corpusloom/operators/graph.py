"""The nearest-neighbour link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import related_lines, remove_block, splice_block
from .cells import VectorIndex
from .vectors import nearest

BEGIN, END = "# >>> related (managed) >>>", "# <<< related (managed) <<<"


def neighbors(vectors: DataFrame, k: int = 5, index: VectorIndex | None = None, probes: int | None = None) -> DataFrame:
    """(src, rank, dst, distance): the ``k`` nearest others of every vector.
    With a stored ``index`` of the vectors a vector meets only the cells that
    may hold one of them or, with ``probes``, so many of the nearest cells."""
    asked = vectors.withColumnRenamed("id", "query_id")
    found = index.nearest(asked, k, exclude_self=True, probes=probes) if index else nearest(asked, vectors, k, exclude_self=True)
    return found.select(F.col("query_id").alias("src"), "rank", F.col("id").alias("dst"), "distance")


def select_links(edges: DataFrame, max_distance: float = 0.45, mutual: bool = True) -> DataFrame:
    """The edges below a distance, by default only those that both ends have."""
    near = edges.where(F.col("distance") < max_distance)
    if not mutual:
        return near
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return near.join(back, ["src", "dst"], "left_semi").select(*edges.columns)


def distance_summary(edges: DataFrame) -> DataFrame:
    """Count, least, exact median and largest distance, as one row."""
    d = F.col("distance")
    return edges.agg(F.count(d).alias("n"), F.min(d).alias("min_distance"), F.round(F.percentile(d, 0.5), 6).alias("median_distance"), F.max(d).alias("max_distance"))


def calibrate(edges: DataFrame, names: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(src, src_name, rank, dst_name, distance, links): every directed edge
    with its ends' names (id, name) and, given a distance, whether it would be
    linked; sort it by distance for the sorted list."""
    a, b = names.withColumnsRenamed({"id": "src", "name": "src_name"}), names.withColumnsRenamed({"id": "dst", "name": "dst_name"})
    links = F.lit(None).cast("boolean") if max_distance is None else F.col("distance") < max_distance
    return edges.join(a, "src").join(b, "dst").select("src", "src_name", "rank", "dst_name", "distance", links.alias("links"))


def link_names(links: DataFrame, names: DataFrame) -> DataFrame:
    """(src, names): the sorted distinct names (id, name) that a source links to."""
    return links.join(names.withColumnsRenamed({"id": "dst"}), "dst").groupBy("src").agg(F.array_sort(F.collect_set("name")).alias("names"))


def apply_links(text: Column, names: Column) -> Column:
    """``text`` with the managed block in its frontmatter set to ``names``;
    empty names remove it, and a text without frontmatter gets one if needed."""
    open_ = F.regexp_extract(text, r"\A---(?:\r\n|\n)", 0)
    pattern = r"\A---(?:\r\n|\n)((?:(?!---(?:\r?\n|\z))[^\r\n]*+(?:\r\n|\n))*+)(---(?:\r\n|\n|\z))"
    closed = text.rlike(pattern)
    inner = F.regexp_extract(text, pattern, 1)
    close = F.regexp_extract(text, pattern, 2)
    body = F.substring(text, F.length(open_) + F.length(inner) + F.length(close) + 1, F.length(text))
    set_ = lambda s: F.when(F.size(names) > 0, splice_block(s, BEGIN, END, related_lines(names))).otherwise(remove_block(s, BEGIN, END))
    fresh = F.concat(F.lit("---\n"), set_(F.lit("")), F.lit("---\n"), text)
    new = set_(inner)
    same = new == inner
    return F.when(closed & same, text).when(closed, F.concat(open_, new, close, body)).when(F.size(names) == 0, text).otherwise(fresh)
