"""A query per operator over the test tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api
from ..functions import text as T
from ..functions.embedding import HashEmbedder, let
from ..operators import audit, blocks, cells, changes, chunking, glossary, graph, lexical, patches, search, tags, vectors
from ..settings import Settings
from ..sources.index import Draft, VersionedTable
from ..sources import sidecars, vault
from ..sources.notes import list_files, read_glossary, read_notes, read_sidecars
from ..sources.shared import work_folder
from ..streaming.apply import read_feed, stream_changes
from ..streaming.staged import follow, with_state_store
from .stored import cells_of, stored, words_of

#: The test vectors lie far apart: within the default distance none has a link.
MAX_DISTANCE = 0.9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TERMS = [("nation-one", "the of"), ("re", "re"), ("idiot", "Idiot"), ("de-la", "de la"), ("mit-license", "MIT License")]
MAPPING = {"PROMO": "promo", "ECONOMY": "budget", "SMALL": "budget", "small": "", "red": "crimson", "blue": "navy"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_text() -> Column:
    """Documents as notes: a frontmatter with tags and a few links before the text."""
    head = F.concat(F.lit("---\ntags: ["), F.col("lang"), F.lit(", '"), F.col("source"), F.lit("']\r\nkind: note\n---\n\n# Doc "), F.col("doc_id").cast("string"))
    return F.concat(head, F.lit("\r\nSee [["), F.col("source"), F.lit("| "), F.col("lang"), F.lit(" notes ]] and ![["), F.col("lang"), F.lit("]].\n"), F.col("text"))


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notes whose tags are their name's words, type and brand."""
    words = F.concat(F.split("p_name", " "), F.array("p_type", F.translate("p_brand", "#", "_")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_file"), words.alias("tags"))


def nation_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as glossary terms with aliases."""
    n = table(spark, sf_dir, "nation").select(F.lower(F.translate("n_name", "_", "-")).alias("slug"), F.col("n_name").alias("display"), F.array(F.concat(F.lit("Nation No. "), F.col("n_nationkey").cast("string")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("aliases"))
    r = table(spark, sf_dir, "region").select(T.normalise_key(F.col("r_name")).alias("slug"), F.col("r_name").alias("display"), F.array(F.concat(F.lit("region "), F.col("r_regionkey").cast("string"))).alias("aliases"))
    return n.unionByName(r)


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def benchmark_queries(spark: SparkSession, sf_dir: str, vector: bool = True) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return HashEmbedder().embed(q, "text", "vector", "query") if vector else q


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), "text")
    chunks = chunking.chunk_documents(docs)
    return chunks.select((F.col("source_file") * 1_000_000 + F.col("chunk_id")).alias("id"), "source_file", "chunk_id", "page", "char_start", "char_end", "text")


# Vectors


@query
def knn_exact(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    return vectors.nearest(v.withColumnRenamed("id", "query_id"), v, 5)


@query
def knn_label_vote(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    near = graph.neighbors(v, 5).join(v.select(F.col("id").alias("dst"), "label"), "dst")
    votes = near.groupBy("src", "label").agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.col("votes").desc(), "label"))
    return votes.withColumn("r", first).where("r = 1").select("src", "label", "votes")


@query
def knn_graph_neighbors(spark, sf_dir):
    return graph.neighbors(embedding_vectors(spark, sf_dir), 5)


@query
def knn_graph_mutual_links(spark, sf_dir):
    return graph.select_links(graph.neighbors(embedding_vectors(spark, sf_dir), 5), MAX_DISTANCE)


def vector_index(spark: SparkSession, sf_dir: str) -> cells.VectorIndex:
    v = embedding_vectors(spark, sf_dir).select("id", "vector")
    return cells_of(stored(spark, sf_dir, "embeddings", "vectors", lambda draft: cells.build(v, draft.put)))


@query
def knn_indexed(spark, sf_dir):
    """As knn_exact, from the stored index: cells that can't matter are left out."""
    v = embedding_vectors(spark, sf_dir)
    return vector_index(spark, sf_dir).nearest(v.withColumnRenamed("id", "query_id"), 5)


@query
def knn_graph_indexed(spark, sf_dir):
    """As knn_graph_mutual_links, from the stored index."""
    edges = graph.neighbors(embedding_vectors(spark, sf_dir), 5, vector_index(spark, sf_dir))
    return graph.select_links(edges, MAX_DISTANCE)


@query
def knn_probed_recall(spark, sf_dir):
    """Whether the neighbours found in as many cells as the index is tuned to
    are at least nine tenths of the true ones, and how many vectors were asked about."""
    v, index = embedding_vectors(spark, sf_dir), vector_index(spark, sf_dir)
    probes = index.probes_for(v, 5)
    pair = lambda rows: rows.select("src", "dst")
    true, found = pair(graph.neighbors(v, 5)), pair(graph.neighbors(v, 5, index, probes))
    hits = true.join(found.withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    return hits.agg(F.count_distinct("src").alias("n_vectors"), F.count("*").alias("n_true"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


@query
def knn_distance_summary(spark, sf_dir):
    return graph.distance_summary(graph.neighbors(embedding_vectors(spark, sf_dir), 5))


@query
def knn_calibration(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    names = v.select("id", F.concat(F.lit("note-"), F.col("id").cast("string")).alias("name"))
    return graph.calibrate(graph.neighbors(v, 5), names, MAX_DISTANCE)


@query
def rrf_vector_only(spark, sf_dir):
    v = embedding_vectors(spark, sf_dir)
    return search.search(v.withColumnRenamed("id", "query_id"), v, None, Settings(hybrid=False))


@query
def hash_embed(spark, sf_dir):
    q = benchmark_queries(spark, sf_dir)
    return q.select("query_id", F.posexplode("vector").alias("place", "value"))


# The inverted index


def document_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build_index(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query
def tokens_postings(spark, sf_dir):
    return document_index(spark, sf_dir).postings.select("term", F.col("id").alias("doc_id"), "tf")


@query
def corpus_stats(spark, sf_dir):
    index = document_index(spark, sf_dir)
    terms = lexical.document_frequencies(index).agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"))
    return lexical.corpus_stats(index).crossJoin(terms).select("n_docs", F.round("avg_len", 6).alias("avg_len"), "n_terms", "max_df")


@query
def query_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.size(T.query_terms(F.col("text"))).cast("long").alias("n_terms"), T.match_expression(F.col("text")).alias("expression"))


def stored_words(spark: SparkSession, sf_dir: str) -> blocks.BlockIndex:
    """The stored word index of the documents, whose texts are read once."""
    docs = table(spark, sf_dir, "documents")
    return words_of(stored(spark, sf_dir, "documents", "words", lambda draft: blocks.build(blocks.listed(docs, "doc_id", "text", "lang"), draft.put)))


@query
def bm25_topk(spark, sf_dir):
    found = blocks.top(benchmark_queries(spark, sf_dir, False), stored_words(spark, sf_dir), 20)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), "score")


@query
def bm25_unindexed(spark, sf_dir):
    """As bm25_topk, with postings made on the way."""
    scores = lexical.bm25(benchmark_queries(spark, sf_dir, False), document_index(spark, sf_dir))
    return lexical.ranked(scores, 20).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


@query
def bm25_phrases(spark, sf_dir):
    """Questions whose words are joined in pairs by ``_``: phrases of two words."""
    pairs = F.regexp_replace("text", r"([\p{L}\p{N}]+) ([\p{L}\p{N}]+)", "$1_$2")
    asked = benchmark_queries(spark, sf_dir, False).withColumn("text", pairs)
    scores = lexical.bm25(asked, document_index(spark, sf_dir))
    return lexical.ranked(scores, 20).select("query_id", "rank", F.col("id").alias("doc_id"), "score")


@query
def bm25_within_source(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))
    found = blocks.top_within(benchmark_queries(spark, sf_dir, False), stored_words(spark, sf_dir), sources, 3)
    return found.select("query_id", F.col("grp").alias("source"), "rank", F.col("id").alias("doc_id"), "score")


# Hybrid search


@query
def rrf_hybrid_search(spark, sf_dir):
    # Embedding a text costs far more than moving it: the rows are spread out first.
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").repartition("id")
    embedded = HashEmbedder().embed(docs, "text", "vector").select("id", "vector")
    near = stored(spark, sf_dir, "documents", "document-vectors", lambda draft: cells.build(embedded, draft.put))
    return search.search(benchmark_queries(spark, sf_dir), cells_of(near), stored_words(spark, sf_dir))


def stored_passages(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Passages of the documents with cells of their vectors and blocks of their words, cut and embedded once."""

    def fill(draft: Draft) -> None:
        chunks = draft.put("passages", document_chunks(spark, sf_dir).repartition("id"))
        cells.build(HashEmbedder().embed(chunks, "text", "vector").select("id", "vector"), draft.put)
        blocks.build(blocks.listed(chunks, "id", "text"), draft.put)

    return stored(spark, sf_dir, "documents", "passages", fill)


def passages(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    kept = stored_passages(spark, sf_dir)
    # Vectors are made again where the cells' do not serve: those of a source's own passages.
    chunks = HashEmbedder().embed(kept.read("passages"), "text", "vector")
    return search.search_passages(benchmark_queries(spark, sf_dir), chunks, words_of(kept), vectors=cells_of(kept), **how).drop("page")


@query
def passage_best_per_source(spark, sf_dir):
    return passages(spark, sf_dir)


@query
def passage_all_chunks(spark, sf_dir):
    return passages(spark, sf_dir, mode="all_chunks")


@query
def passage_within_document(spark, sf_dir):
    return passages(spark, sf_dir, mode="all_chunks", source=3)


@query
def passage_fetch(spark, sf_dir):
    """Every document's second passage by its key."""
    return search.fetch_passage(document_chunks(spark, sf_dir), F.col("source_file"), 1).select("source_file", "chunk_id", "char_start", "char_end", "text")


# Chunks


@query
def chunk_documents(spark, sf_dir):
    c = document_chunks(spark, sf_dir)
    return c.select("source_file", "chunk_id", F.size(F.split("text", r"\s+")).cast("long").alias("n_words"), T.raw_hash(F.col("text")).alias("text_hash"))


@query
def chunk_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_documents(docs, tokens=50, overlap=0.25).select("doc_id", "chunk_id", "char_start", "char_end")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "text")


@query
def paged_source_spans(spark, sf_dir):
    return chunking.page_spans(conversation_pages(spark, sf_dir), "conv_id", "page", "text")


@query
def chunk_page_asof(spark, sf_dir):
    docs = chunking.paged_documents(conversation_pages(spark, sf_dir), "conv_id", "page", "text")
    return chunking.chunk_documents(docs, tokens=20, overlap=0.15, spans="spans").select("conv_id", "chunk_id", "page", "char_start", "char_end")


# Note views


@query
def canonical_body(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.canonical_body(note_text()).alias("body"))


@query
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_file"), T.content_hash(note_text()).alias("content_hash"))
    return d.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_file"), T.raw_hash(F.col("html")).alias("content_hash")))


@query
def parse_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.parse_tags(note_text()).alias("tags"))
    block = F.concat(F.lit("---\ntype: part\ntags:\n  - "), F.col("p_type"), F.lit('\n  - "'), F.col("p_brand"), F.lit('"\nmore: x\n---\n'), F.col("p_name"))
    p = table(spark, sf_dir, "part").select((-F.col("p_partkey") - 1).alias("id"), T.parse_tags(block).alias("tags"))
    return d.unionByName(p).select("id", F.array_join("tags", "|").alias("tags"), F.size("tags").cast("long").alias("n"))


@query
def slugify_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", "p_name", F.lit("& Co.!"), "p_brand")
    return p.select("p_partkey", T.slugify_title(title).alias("slug"), T.display_title(F.concat(F.lit("x\n# "), title, F.lit(" \n# y")), F.lit("a-b")).alias("display"))


@query
def normalize_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    term = F.concat(F.lit(" What is "), F.col("text"), F.lit("?"))
    return d.select("doc_id", T.normalise_key(term).alias("key"), T.strip_lead_in(T.normalise_key(term)).alias("bare"), T.normalise_tag(F.col("text")).alias("tag"))


@query
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query
def long_documents(spark, sf_dir):
    return audit.long_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=20).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"))


@query
def path_views(spark, sf_dir):
    """Documents under paths: scope, stem, sidecar names both ways, relative path."""
    root = F.element_at(F.array(*map(F.lit, [*T.ROOTS, "glossary"])), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("vault/"), root, F.lit("/"), F.col("source"), F.lit("/n."), F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", ".txt").otherwise(".md"))
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    p = F.col("path")
    return d.select("doc_id", T.is_note_path(p).alias("in_scope"), T.stem(p).alias("stem"), T.sidecar_path(p).alias("sidecar"), T.sidecar_path(p, True).alias("chunk_sidecar"), T.source_of_sidecar(T.sidecar_path(p)).alias("source_file"), T.relative_to(F.concat(F.lit("/brain/"), p), "/brain").alias("relative"))


@query
def managed_blocks(spark, sf_dir):
    """A block spliced into each text, set again, and removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    one = let(T.splice_block(F.col("text"), "<a>", "</a>", F.col("source")), lambda once: let(T.splice_block(once, "<a>", "</a>", F.lit("new")), lambda twice: F.struct(once.alias("once"), twice.alias("twice"))))
    d = d.select("doc_id", one.alias("s")).select("doc_id", "s.once", "s.twice")
    return d.select("doc_id", F.sha2("once", 256).alias("once"), F.sha2("twice", 256).alias("twice"), F.sha2(T.remove_block(F.col("twice"), "<a>", "</a>"), 256).alias("removed"), T.block_state(F.col("once"), "<a>", "</b>").alias("state"))


@query
def frontmatter_splits(spark, sf_dir):
    """Each text under a head: split by the literal fences, split into parts that make it up again, and its aliases."""
    head = "---\naliases: [one, 'two words']\nkind: x\n---\n"
    note = F.concat(F.lit(head), F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", note.alias("t"), T.split_frontmatter_strict(note).alias("s"), T.frontmatter_parts(note).alias("p"))
    whole = F.concat("p.open", "p.inner", "p.close", "p.body") == F.col("t")
    return d.select("doc_id", F.length("s.head").cast("long").alias("head_chars"), F.sha2("s.body", 256).alias("body_sha256"), F.length("p.inner").cast("long").alias("inner_chars"), whole.alias("whole"), F.array_join(T.parse_aliases(F.col("t")), "|").alias("aliases"))


@query
def linked_forms(spark, sf_dir):
    """Parts' names as links to their slugs."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.linked_form(T.slugify_title(F.col("p_name")), F.col("p_name")).alias("link"), T.linked_form(F.col("p_type"), F.col("p_type")).alias("bare"))


@query
def hit_lines(spark, sf_dir):
    """The documents by length, as lines of a listing with the score of their rank."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.hit_line(1 / (60 + F.col("n_chars")), F.concat(F.lit("areas/"), F.col("source"), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("line"))


# Tags


@query
def tag_counts(spark, sf_dir):
    return tags.tag_counts(part_notes(spark, sf_dir))


@query
def tag_carriers(spark, sf_dir):
    return tags.tag_carriers(tags.note_tags(part_notes(spark, sf_dir)))


@query
def tag_listing_capped(spark, sf_dir):
    rows = tags.tag_counts(part_notes(spark, sf_dir)).where(F.lower("tag").contains("b"))
    return tags.capped(rows, 20, F.col("n").desc(), F.col("tag"))


@query
def tag_near_universal(spark, sf_dir):
    n = part_notes(spark, sf_dir)
    return tags.near_universal(tags.note_tags(n), n, 0.12).select("tag", "n", F.round("fraction", 6).alias("fraction"))


def rare_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part notes with one more tag from the price, which is often alone."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("source_file"), F.array("p_type", F.concat(F.lit("price_"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).alias("tags"))


@query
def tag_singletons(spark, sf_dir):
    """Tags of the type, and of price and size together."""
    of = F.concat_ws("_", F.col("p_retailprice").cast("decimal(12,2)").cast("string"), "p_size")
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_file"), F.array("p_type", of).alias("tags"))
    return tags.singletons(tags.note_tags(notes))


@query
def tag_format_lint(spark, sf_dir):
    return tags.format_lint(tags.note_tags(rare_tags(spark, sf_dir)))


@query
def tag_overlap_jaccard(spark, sf_dir):
    found = tags.overlap(tags.note_tags(part_notes(spark, sf_dir)), 0.05)
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def variant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary with near misses: brands, types and name words, and variants."""
    p = table(spark, sf_dir, "part")
    all_ = F.array("p_brand", F.lower(F.translate("p_brand", "#", " ")), "p_type", F.concat(F.lit("my-"), F.lower("p_type")), F.translate("p_name", " ", "_"), F.translate("p_name", " ", "-"), F.split("p_name", " ")[0], F.split("p_name", " ")[1])
    return p.select(F.explode(all_).alias("tag")).distinct()


@query
def tag_near_miss(spark, sf_dir):
    return tags.near_miss_pairs(variant_tags(spark, sf_dir))


@query
def tag_write_hint(spark, sf_dir):
    proposed = table(spark, sf_dir, "part").select(F.concat(F.translate("p_name", " ", "-"), F.lit("s")).alias("tag")).distinct()
    return tags.write_hints(proposed, variant_tags(spark, sf_dir)).select("tag", F.array_join("existing", "|").alias("existing"), "first")


@query
def composed_notes(spark, sf_dir):
    """A new note for each name of a part: its place, whether it is taken, its
    text, and the tags that nearly exist."""
    p = table(spark, sf_dir, "part")
    asked = p.groupBy(F.col("p_name").alias("title")).agg(F.count("*").alias("n"))
    asked = asked.select("title", F.concat(F.lit("Parts of this name: "), F.col("n").cast("string")).alias("body"), F.array(F.concat(F.translate("title", " ", "-"), F.lit("s")), F.lit("part")).alias("tags"))
    there = p.where("p_size = 7").select(F.concat(F.lit("areas/"), F.translate("p_name", " ", "-"), F.lit(".md")).alias("source_file"))
    made = api.compose_notes(asked, there, variant_tags(spark, sf_dir))
    return made.select("title", "slug", F.col("exists").alias("taken"), F.sha2("text", 256).alias("text_sha256"), F.array_join("hints", "|").alias("hints"))


@query
def tag_apply_mapping(spark, sf_dir):
    found = tags.apply_mapping(part_notes(spark, sf_dir), MAPPING)
    return found.select("source_file", F.array_join("old", "|").alias("old"), F.array_join("new", "|").alias("new"))


@query
def tag_rewrite(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select("doc_id", note_text().alias("text")).withColumn("tags", T.parse_tags(F.col("text")))
    changed = tags.rewrite_tags(notes, {"en": "english", "fr": "", "src3": "fr"})
    return changed.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.array_join("tags", "|").alias("tags"))


def tag_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of the brands, types and names' words of all parts, written as
    three files, one of them JSON, and read."""
    p = table(spark, sf_dir, "part")
    lines = lambda rows, line: rows.distinct().agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    brand = lines(p.select(F.translate("p_brand", "#", "_").alias("t")), F.concat("t", F.lit(" -> "), F.lower(F.translate("t", "_", "-")), F.lit("  # a brand")))
    words = lines(p.select(F.explode(F.split("p_name", " ")).alias("t")), F.concat("t", F.when(F.col("t").startswith("r"), " = r").when(F.col("t").contains("a"), ":").otherwise(F.concat(F.lit(" : "), "t"))))
    types = p.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("p_type", F.lower("p_type")))))).alias("content"))
    named = lambda rows, name: rows.select(F.lit(name).alias("path"), "content")
    folder = work_folder(spark, "mapping")
    sidecars.write_files(named(brand, "brand.txt").unionByName(named(words, "words.txt")).unionByName(named(types, "types.json")), folder)
    return tags.read_mapping(spark, folder)


@query
def tag_mapping_files(spark, sf_dir):
    """The tags of all parts renamed, merged and removed as mapping files say."""
    found = tags.map_tags(part_notes(spark, sf_dir), tag_mapping(spark, sf_dir))
    return found.select("source_file", F.array_join("old", "|").alias("old"), F.array_join("new", "|").alias("new"))


@query
def tag_rewrite_by_table(spark, sf_dir):
    """The documents' tags rewritten by a mapping that is a table: each source's name to its first document's language."""
    d = table(spark, sf_dir, "documents")
    mapping = d.groupBy(F.col("source").alias("old")).agg(F.min_by("lang", "doc_id").alias("new"))
    notes = d.select("doc_id", note_text().alias("text")).withColumn("tags", T.parse_tags(F.col("text")))
    return tags.rewrite_tags_by(notes, mapping, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.array_join("tags", "|").alias("tags"))


@query
def tag_hygiene_json(spark, sf_dir):
    return tags.hygiene_json(tags.hygiene_report(rare_tags(spark, sf_dir)))


@query
def tag_hygiene_report(spark, sf_dir):
    return tags.hygiene_report(rare_tags(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query
def tag_hygiene_lines(spark, sf_dir):
    notes = rare_tags(spark, sf_dir)
    return tags.hygiene_lines(tags.hygiene_report(notes), notes)


# Terms


@query
def glossary_listing(spark, sf_dir):
    """The first ten nations and regions with "on 1" in the term or an alias."""
    return glossary.listing(nation_terms(spark, sf_dir), "ON 1", 10).withColumn("aliases", F.array_join("aliases", "|"))


@query
def glossary_keys(spark, sf_dir):
    return glossary.key_index(nation_terms(spark, sf_dir))


@query
def glossary_collisions(spark, sf_dir):
    return glossary.key_collisions(nation_terms(spark, sf_dir)).select("key", F.array_join("slugs", "|").alias("slugs"))


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    ask = F.array(F.concat(F.lit("What is "), F.col("n_name"), F.lit("?")), F.concat(F.lit("define nation no "), F.col("n_nationkey").cast("string")), F.concat(F.col("n_name"), F.lit("x")), F.concat(F.lit("Region_"), F.col("n_regionkey").cast("string")))
    return n.select(F.explode(ask).alias("term")).distinct()


@query
def glossary_lookup(spark, sf_dir):
    return glossary.lookup(asked_terms(spark, sf_dir), glossary.key_index(nation_terms(spark, sf_dir)))


@query
def glossary_suggest(spark, sf_dir):
    return glossary.suggest(asked_terms(spark, sf_dir), glossary.key_index(nation_terms(spark, sf_dir)))


@query
def new_terms(spark, sf_dir):
    """Regions and nations asked for as new terms: the nations are taken."""
    terms = nation_terms(spark, sf_dir)
    r = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(" Zone")).alias("term"), F.lit(" A part of the world. ").alias("definition"), F.array(F.concat(F.lit("zone "), F.col("r_regionkey").cast("string"))).alias("aliases"))
    n = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("!")).alias("term"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("array<string>").alias("aliases"))
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), "text")
    made, _ = api.add_terms(r.unionByName(n), terms, notes)
    return made.select("term", "slug", "refused", F.sha2("text", 256).alias("text_sha256"))


@query
def new_term_links(spark, sf_dir):
    """Phrases of the documents asked for as new terms, and the documents that get links to them."""
    asked = spark.createDataFrame([("MIT License", "A license.", ["GNU General Public License"]), ("De la", "Two words.", None)], "term string, definition string, aliases array<string>")
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), "text")
    _, linked = api.add_terms(asked, nation_terms(spark, sf_dir), notes)
    return linked.select("source_file", F.sha2("new_text", 256).alias("text_sha256"), F.size("linked").alias("n_linked"))


def linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[[re|the of]] "), F.col("text")).alias("body"))


@query
def glossary_unlinked(spark, sf_dir):
    terms = spark.createDataFrame(TERMS, "slug string, surface string")
    return glossary.unlinked_report(linkable(spark, sf_dir), terms, "doc_id")


@query
def glossary_link_first(spark, sf_dir):
    made = glossary.link_terms(linkable(spark, sf_dir), TERMS, "doc_id")
    return made.select("doc_id", F.sha2("new_body", 256).alias("body_sha256"), F.array_join("linked", "|").alias("linked"))


@query
def link_invariance(spark, sf_dir):
    """Every document's content hash after its terms are linked and related
    notes are put in its head: that of the document as it was."""
    d = linkable(spark, sf_dir)
    linked = d.join(glossary.link_terms(d, TERMS, "doc_id").select("doc_id", "new_body"), "doc_id", "left")
    text = graph.apply_links(F.coalesce("new_body", "body"), F.array(F.lit("near"), F.lit("far")))
    return linked.select("doc_id", T.content_hash(text).alias("content_hash"))


@query
def link_lines(spark, sf_dir):
    """The related block that each vector's mutual links put into a note."""
    v = embedding_vectors(spark, sf_dir)
    names = v.select("id", F.concat(F.lit("note-"), F.col("id").cast("string")).alias("name"))
    linked = graph.link_names(graph.select_links(graph.neighbors(v, 5), MAX_DISTANCE), names)
    return linked.select("src", F.sha2(graph.apply_links(F.lit("---\ntags: [x]\n---\nbody\n"), F.col("names")), 256).alias("note_sha256"), F.array_join("names", "|").alias("names"))


# Upkeep


@query
def root_counts(spark, sf_dir):
    return audit.root_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("root")), ["src0", "src1", "src2", "nowhere"])


@query
def notes_under_root(spark, sf_dir):
    """The first 50 documents of a root with 7 in their title."""
    root = F.element_at(F.array(*map(F.lit, T.ROOTS)), (F.col("doc_id") % len(T.ROOTS) + 1).cast("int"))
    path = F.concat(F.lit("vault/"), root, F.lit("/"), F.col("source"), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return audit.notes_under(table(spark, sf_dir, "documents").select(path.alias("source_file")), "areas", "7")


@query
def ingest_summary(spark, sf_dir):
    """Pages and passages of every conversation, a turn being a page."""
    pages = conversation_pages(spark, sf_dir).withColumnRenamed("conv_id", "source_file")
    docs = chunking.paged_documents(pages, "source_file", "page", "text").select("source_file", "text")
    return api.ingest_summary(pages, chunking.chunk_documents(docs, tokens=20, overlap=0.25))


@query
def source_listing_paged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.col("n_chars").desc(), F.col("doc_id").desc()).offset(20).limit(50)


@query
def change_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    now = d.select("doc_id", F.lit("test").alias("backend"), T.raw_hash(F.col("text")).alias("content_hash"))
    edited = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = d.select("doc_id", F.when(F.col("source") == "src5", "other").otherwise("test").alias("backend"), T.raw_hash(edited).alias("content_hash"))
    return audit.change_gate(now, stored, ["doc_id", "backend", "content_hash"])


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes, labels as sidecars, embeddings as index rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), "text", "lang")
    notes = docs.select("source_file", T.raw_hash(F.col("text")).alias("content_hash"))
    # The sidecars of texts that are not English were made of another version.
    stored = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("!")))
    side = table(spark, sf_dir, "labels").withColumn("source_file", F.col("doc_id") * 2).join(docs, "source_file", "left")
    side = side.select("source_file", F.when(F.col("toxic") == 1, "model").otherwise("test").alias("backend"), T.raw_hash(stored).alias("content_hash"), F.when(F.col("quality") == 1, 64).when(F.col("toxic") == 0, 32).alias("dim"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_file"))
    return audit.layer_findings(notes, side.dropDuplicates(["source_file"]), rows, "test", 64)


@query
def layer_audit(spark, sf_dir):
    return layers(spark, sf_dir)


@query
def layer_verdict(spark, sf_dir):
    return audit.verdict(layers(spark, sf_dir))


@query
def repair_plan(spark, sf_dir):
    return audit.repair_plan(layers(spark, sf_dir))


@query
def paged_repair(spark, sf_dir):
    """Pages as paged sources, some unreadable, and sidecars of which some are of another text, backend or dimension."""
    html = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_file"), "html")
    sources = html.select("source_file", F.when(F.col("source_file") % 7 != 0, T.raw_hash(F.col("html"))).alias("content_hash"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_file"), "label").join(html, "source_file", "left")
    stored = T.raw_hash(F.when(F.col("label") == 1, F.concat("html", F.lit("!"))).otherwise(F.coalesce("html", F.lit(""))))
    side = v.select("source_file", F.when(F.col("label") == 3, "other").otherwise("test").alias("backend"), stored.alias("content_hash"), F.array(F.when(F.col("label") == 2, 32).otherwise(64)).alias("dims"))
    return audit.paged_repair_plan(audit.chunked_findings(sources, side, v.where("label <> 4"), "test", 64))


@query
def intake_check(spark, sf_dir):
    """Documents as files that are to come in: their places, and which are refused."""
    name = F.concat(F.lit("/in/"), "source", F.lit("/n"), (F.col("doc_id") % 300).cast("string"), F.when(F.col("lang") == "de", ".txt").otherwise(".PDF"))
    d = table(spark, sf_dir, "documents")
    there = d.where(F.col("lang") == "fr").select(F.concat(F.lit("vault/areas/n"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("source_file"))
    return api.check_intake(d.select(name.alias("path")), there, "areas")


@query
def passage_index_upkeep(spark, sf_dir):
    """A stored passage index after a load, a change of every third source and
    the removal of every fifth: its sources and how many passages each has."""
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    pages = conversation_pages(spark, sf_dir).select("conv_id", path.alias("source_file"), "page", "text")
    settings, small = Settings(chunk_tokens=20, chunk_overlap=0.25), HashEmbedder(8)
    index = api.PassageIndex(spark, work_folder(spark, "passages"))
    index.load(api.ingest_paged_source(pages.drop("conv_id"), settings=settings, embedder=small), dim=8)
    longer = pages.where(F.col("conv_id") % 3 == 0).withColumn("text", F.concat("text", F.lit(" and five more words here"))).drop("conv_id")
    index.update(api.ingest_paged_source(longer, settings=settings, embedder=small), dim=8)
    index.remove(pages.where(F.col("conv_id") % 5 == 0).select("source_file").distinct())
    stats = index.stats().select("n_chunks")
    return index.read().groupBy("source_file").agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("numbers")).join(index.sources(), "source_file").crossJoin(F.broadcast(stats))


@query
def note_index_upkeep(spark, sf_dir):
    """A stored note index of all documents after a feed that deletes the
    French ones, changes the German ones, renames the Spanish ones and modifies
    those of a source whose files are gone: which rows of which layer are left."""
    path = lambda folder: F.concat(F.lit(f"vault/{folder}/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", path("areas").alias("path"), path("archive").alias("new_path"), note_text().alias("text"))
    before = d.select(F.col("path").alias("source_file"), "text")
    small = HashEmbedder(8)
    index = api.NoteIndex(spark, work_folder(spark, "notes"))
    index.build(before, api.embed_notes(before, embedder=small), dim=8)
    gone = (F.col("lang") == "en") & (F.col("source") == "src3")
    status = F.when(F.col("lang") == "fr", "D").when(F.col("lang") == "de", "M").when(F.col("lang") == "es", "R100").when(gone, "M")
    feed = d.select(status.alias("status"), "path", F.when(F.col("lang") == "es", F.col("new_path")).alias("new_path"), F.col("doc_id").alias("seq")).where("status is not null")
    now = d.where(~gone & (F.col("lang") != "fr")).select(F.when(F.col("lang") == "es", F.col("new_path")).otherwise(F.col("path")).alias("source_file"), F.when(F.col("lang") == "de", F.concat("text", F.lit(" geändert"))).otherwise(F.col("text")).alias("text"))
    index.apply(feed, now, small)
    v = index.vectors.read().select("source_file", "content_hash", F.size("vector").alias("dim"))
    b = index.bodies.read().select("source_file", F.sha2("body", 256).alias("body_sha256"), F.array_join("tags", "|").alias("tags"))
    return v.join(b, "source_file", "full")


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: the user is the note, the kind of event its status."""
    kinds = {"signup": "A", "view": "M", "click": "C100", "error": "D", "purchase": "R090"}
    status = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("event_type"))
    path = lambda c: F.concat(F.lit("n"), c.cast("string"))
    moved = F.when(F.col("event_type").isin("purchase", "click"), path(F.col("user_id") + 1000))
    return table(spark, sf_dir, "events").select(status.alias("status"), path(F.col("user_id")).alias("path"), moved.alias("new_path"), F.col("event_id").alias("seq"))


def present_rows(keys: DataFrame) -> DataFrame:
    return keys.select("path", F.length("path").cast("long").alias("size"))


@query
def incremental_apply(spark, sf_dir):
    """The rows after the whole feed, over a base that has one row per user."""
    feed = event_feed(spark, sf_dir)
    base = table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("path")).distinct().withColumn("size", F.lit(0).cast("long"))
    net = changes.net_changes(feed)
    return changes.apply_changes(base, net, present_rows(net.where("op = 'upsert'")))


@query
def stream_apply_equals_batch(spark, sf_dir):
    """The same feed as a stream of small batches, each making a version."""
    work = work_folder(spark, "stream")
    feed = event_feed(spark, sf_dir)
    feed = feed.crossJoin(feed.agg((F.max("seq") + 1).alias("end"))).withColumn("part", F.floor(F.col("seq") * 3 / F.col("end")))
    for part in range(3):  # three commits to the feed, one after another
        feed.where(F.col("part") == part).drop("end", "part").coalesce(1).write.mode("append").parquet(f"{work}/feed")
    rows = VersionedTable(spark, f"{work}/table")
    stream_changes(read_feed(spark, f"{work}/feed", 1), rows, present_rows, f"{work}/progress").awaitTermination()
    rows.vacuum()
    return rows.read()


def vault_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event feed over paths of a vault, a fifth of them outside the notes' folders."""
    feed = event_feed(spark, sf_dir)
    place = lambda c: F.concat(F.lit("vault/"), F.element_at(F.array(*map(F.lit, [*T.ROOTS, "glossary"])), (F.regexp_extract(c, r"(\d+)", 1).cast("int") % 5 + 1)), F.lit("/"), c, F.lit(".md"))
    return feed.select("status", place(F.col("path")).alias("path"), place(F.col("new_path")).alias("new_path"), "seq")


@query
def staged_notes(spark, sf_dir):
    """The notes that a commit of all events stages."""
    return changes.staged_notes(vault_feed(spark, sf_dir))


@query
def stream_scoped_state(spark, sf_dir):
    """The rows of notes in scope after a feed that comes in four parts, out of
    order, the first one twice: as if it had come at once."""
    own = with_state_store(spark)
    work = work_folder(own, "stream")
    feed = vault_feed(own, sf_dir)
    for part in (2, 0, 3, 1, 2):
        feed.where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(f"{work}/feed")
    rows = VersionedTable(own, f"{work}/table")
    follow(read_feed(own, f"{work}/feed", 1), rows, present_rows, f"{work}/progress").awaitTermination()
    rows.vacuum()
    return spark.read.parquet(rows.folder(rows.version))


# Files


@query
def note_sidecar_files(spark, sf_dir):
    """Every document's sidecar written as a file and read again."""
    path = F.concat(F.lit("areas/"), F.col("source"), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    notes = table(spark, sf_dir, "documents").select(path.alias("source_file"), "text")
    work = work_folder(spark, "sidecars")
    sidecars.write_files(sidecars.note_sidecars(api.embed_notes(notes, embedder=HashEmbedder(8))), work)
    found = read_sidecars(spark, work)
    return found.select("sidecar", "doc_kind", "source_file", "type", "content_hash", F.array_join(F.transform("vector", lambda x: F.round(x * 1_000_000).cast("long")), ",").alias("millionths"), F.col("embedded_at").isNull().alias("unstamped"))


@query
def chunk_sidecar_files(spark, sf_dir):
    """Every conversation's passages written as a sidecar, read again, a row each."""
    path = F.concat(F.lit("inbox/c"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    pages = conversation_pages(spark, sf_dir).select(path.alias("source_file"), "page", "text")
    rows = api.ingest_paged_source(pages, settings=Settings(chunk_tokens=20, chunk_overlap=0.15), embedder=HashEmbedder(8))
    work = work_folder(spark, "sidecars")
    sidecars.write_files(sidecars.chunk_sidecars(rows), work)
    found = read_sidecars(spark, work).select("sidecar", "doc_kind", "source_file", "chunking.chunk_tokens", F.explode("chunks").alias("c"))
    return found.select("sidecar", "doc_kind", "source_file", "chunk_tokens", "c.chunk_id", "c.page", "c.char_start", "c.char_end", T.raw_hash(F.col("c.text")).alias("text_hash"), F.size("c.vector").alias("dim"))


def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a note (path, content): below the notes' roots, or of templates."""
    root = F.element_at(F.array(*map(F.lit, [*T.ROOTS, "templates"])), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(root, F.lit("/"), "source", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select(path.alias("path"), note_text().alias("content"))


@query
def vault_seeded_notes(spark, sf_dir):
    """Every document's note in a folder of seeds, seeded to a vault twice, and what a scan of the vault finds."""
    seeds, base = work_folder(spark, "seeds"), work_folder(spark, "vault")
    sidecars.write_files(vault_notes(spark, sf_dir), seeds)
    vault.seed(spark, seeds, base)
    vault.seed(spark, seeds, base)
    found = read_notes(spark, base)
    return found.select("source_file", "root", "stem", F.array_join("tags", "|").alias("tags"), F.sha2("text", 256).alias("text_sha256"), T.content_hash(F.col("text")).alias("content_hash"))


@query
def vault_wiped(spark, sf_dir):
    """What a wipe removes from a vault of notes, sidecars and other files, and what it leaves."""
    base = work_folder(spark, "vault")
    notes = vault_notes(spark, sf_dir)
    beside = notes.select(F.explode(F.array(T.sidecar_path(F.col("path")), F.regexp_replace("path", "[.]md$", ".txt"))).alias("path"), F.lit("{}").alias("content"))
    sidecars.write_files(notes.unionByName(beside), base)
    removed = vault.wipe(spark, base, force=True)
    return removed.withColumn("removed", F.lit(True)).unionByName(vault.list_vault(spark, base).withColumn("removed", F.lit(False)))


@query
def intake_moved(spark, sf_dir):
    """Documents as files of an inbox, moved to their places unless refused: the vault's and the inbox's files after it."""
    inbox, base = work_folder(spark, "inbox"), work_folder(spark, "vault")
    half = F.floor(F.col("doc_id") / 2).cast("string")
    name = F.concat(F.lit("n"), half, F.when(F.col("lang") == "de", ".txt").otherwise(".PDF"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("content"), F.concat((F.col("doc_id") % 2).cast("string"), F.lit("/"), "source", F.lit("/"), name).alias("path"))
    there = d.where("lang = 'fr'").select(F.concat(F.lit("vault/areas/n"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("path"), F.lit("old").alias("content"))
    sidecars.write_files(d.select("path", "content"), inbox)
    sidecars.write_files(there, base)
    asked = vault.list_vault(spark, inbox).select("path")
    checked = api.check_intake(asked, vault.list_vault(spark, base).withColumnRenamed("path", "source_file"), "areas")
    vault.take_in(checked.where("refused is null").select(F.col("source_file").alias("path"), F.col("path").alias("source")), inbox, base, move=True)
    return vault.list_vault(spark, base).withColumn("place", F.lit("vault")).unionByName(vault.list_vault(spark, inbox).withColumn("place", F.lit("inbox")))


@query
def inbox_listing(spark, sf_dir):
    """Documents as files of an inbox: the second page of its names."""
    folder = work_folder(spark, "inbox")
    name = F.concat(F.when(F.col("lang") == "en", "N").otherwise("n"), F.col("doc_id").cast("string"), F.when(F.col("source") == "src1", ".txt").otherwise(".pdf"))
    sidecars.write_files(table(spark, sf_dir, "documents").select(name.alias("path"), F.coalesce("text", F.lit("")).alias("content")), folder)
    return list_files(spark, folder, newest_first=False, offset=50, limit=50).select("name", "size")


@query
def sidecar_states(spark, sf_dir):
    """Every document's sidecar, of a note, of a chunked source, or cut short, as a scan tells them apart."""
    path = F.concat(F.lit("areas/"), "source", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    chunks = F.when(F.col("lang") == "es", F.array(F.struct(F.lit(0).alias("chunk_id"), F.col("text"))))
    said = F.to_json(F.struct(path.alias("source_file"), F.lit("test").alias("type"), chunks.alias("chunks")))
    cut = F.when(F.col("lang") == "fr", F.substring(said, F.lit(1), F.length(said) - 1)).otherwise(said)
    base = work_folder(spark, "sidecars")
    sidecars.write_files(table(spark, sf_dir, "documents").select(T.sidecar_path(path).alias("path"), cut.alias("content")), base)
    found = read_sidecars(spark, base)
    whole = F.col("doc_kind") != "unreadable"
    return found.select("sidecar", "doc_kind", F.when(whole, F.col("source_file")).alias("source_file"), F.when(whole, F.sha2(F.col("chunks")[0]["text"], 256)).alias("text_sha256"))


@query
def term_files(spark, sf_dir):
    """Customers and suppliers as terms' notes in a folder, read again as a glossary; drafts in it are no terms."""
    named = lambda t, c: table(spark, sf_dir, t).select(F.col(f"{c}_name").alias("term"), F.array(F.concat(F.lit(t + " of nation "), F.col(f"{c}_nationkey").cast("string")), F.lit("'party'")).alias("aliases"), F.when(F.col(f"{c}_acctbal") < 0, "  In debt. ").alias("said"))
    both = named("customer", "c").unionByName(named("supplier", "s"))
    draft = F.when(F.col("said").isNotNull() & F.col("term").endswith("7"), "_").otherwise("")
    files = both.select(F.concat(draft, T.slugify_title(F.col("term")), F.lit(".md")).alias("path"), T.term_note(F.col("term"), F.col("said"), F.col("aliases")).alias("content"))
    folder = work_folder(spark, "terms")
    sidecars.write_files(files, folder)
    return read_glossary(spark, folder).select("slug", "display", F.array_join("aliases", "|").alias("aliases"), F.sha2("text", 256).alias("text_sha256"))


# Write passes


@query
def link_pass_patches(spark, sf_dir):
    """What a pass that links each document to its source would change, as
    patches: lines added and removed, hunks, and whether the patch gives the new text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", graph.apply_links(F.col("text"), F.array("source", "lang")).alias("new"))
    made = d.withColumn("patch", patches.diff(F.col("text"), F.col("new"), F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md"))))
    count = lambda mark: patches.count(F.col("patch"), mark)
    return made.select("doc_id", count("+").alias("n_added"), count("-").alias("n_removed"), count("@@").alias("n_hunks"), (patches.apply(F.col("text"), F.col("patch")) == F.col("new")).alias("applies"))


@query
def glossary_pass_patches(spark, sf_dir):
    """The patches of a pass that links each document's first mention of every term."""
    d = linkable(spark, sf_dir)
    made = d.join(glossary.link_terms(d, TERMS, "doc_id"), "doc_id").where("new_body <> body")
    return made.select("doc_id", F.sha2(patches.diff(F.col("body"), F.col("new_body"), F.col("doc_id")), 256).alias("patch_sha256"), F.size("linked").alias("n_linked"))
