"""DuckDB SQL for the queries of :mod:`corpusloom.plans.queries`."""

from __future__ import annotations

# Parts that several queries use.
EMB = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PAIRS = f"{EMB}, pairs AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_distance(a.v, b.v), 6) + 0.0 AS distance FROM e a, e b)"
EDGES = f"""{PAIRS}, edges AS (
  SELECT * FROM (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs WHERE src <> dst) WHERE rank <= 5)"""
LINKS = """links AS (
  SELECT a.* FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.distance < {t} AND b.distance < {t})"""


def hash_vectors(name: str, source: str, digests: int = 96) -> str:
    """A CTE (id, v): the deterministic embedding of ``source`` (id, text), 8 values from each digest."""
    return f"""{name}_raw AS (
  SELECT id, list(('0x' || substr(d, i * 8 + 1, 8))::UBIGINT::DOUBLE / 4294967296.0 * 2.0 - 1.0 ORDER BY c, i) AS v FROM (
    SELECT id, c, sha256(encode(text) || unhex(printf('%08x', c))) AS d FROM {source}, range({digests}) r(c)), range(8) s(i) GROUP BY id),
{name} AS (SELECT id, list_transform(v, lambda x: round(x / n, 6)) AS v FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM {name}_raw))"""


TOKENS = r"unnest(regexp_extract_all(lower(strip_accents({t})), '[\p{{L}}\p{{N}}\p{{Co}}]+'))"
DOC_TOKENS = f"tokens AS (SELECT doc_id AS id, {TOKENS.format(t="text || ' ' || lang")} AS term FROM documents)"
POSTINGS = "postings AS (SELECT term, id, count(*) AS tf FROM tokens GROUP BY ALL), lengths AS (SELECT id, count(*) AS dl FROM tokens GROUP BY id)"
BM25 = r"""asked AS (
  SELECT query_id, strip_accents(word) AS term, count(*) AS times FROM (
    SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark) GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM {all}) AS n, avg(dl) AS avg_len FROM {lengths}),
idf AS (SELECT term, CASE WHEN w > 0 THEN w ELSE 1e-6 END AS idf FROM (
  SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM postings, stats GROUP BY term, n)),
scores AS (
  SELECT query_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN postings USING (term) JOIN lengths USING (id), stats GROUP BY ALL)"""
DOC_BM25 = f"{DOC_TOKENS}, {POSTINGS}, " + BM25.replace("{all}", "documents").replace("{lengths}", "lengths")
LEX = "lex AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS lex_rank FROM scores) WHERE lex_rank <= {pool})"
VEC = """vec AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vec_rank FROM (
  SELECT a.id AS query_id, b.id, round(list_cosine_distance(a.v, b.v), 6) AS distance FROM qv a, {base} b)) WHERE vec_rank <= {pool})"""
FUSED = """fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_rank NULLS LAST, lex_rank NULLS LAST, id) AS fused_rank FROM (
    SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0) AS score, vec_rank, lex_rank
    FROM vec FULL JOIN lex USING (query_id, id)))"""
BENCH = "bench AS (SELECT item_id AS id, text FROM benchmark)"


def chunks(source: str, tokens: int, step: int, name: str = "chunks") -> str:
    """CTEs for windows over ``source`` (src, text): (src, chunk_id, char_start, char_end, n_words, text)."""
    return rf"""words AS (
  SELECT src, i, s - length(w) AS a, s AS b FROM (
    SELECT src, i, w, sum(length(p)) OVER (PARTITION BY src ORDER BY i)::BIGINT AS s FROM (
      SELECT src, unnest(range(len(ws))) AS i, unnest(ws) AS w, unnest(ps) AS p FROM (
        SELECT src, regexp_extract_all(text, '\S+') AS ws, regexp_extract_all(text, '\s*\S+') AS ps FROM {source})))),
counted AS (SELECT src, count(*) AS n FROM words GROUP BY src),
windows AS (SELECT src, unnest(range(CASE WHEN n <= {tokens} THEN 1 ELSE ceil((n - {tokens})::DOUBLE / {step})::BIGINT + 1 END)) AS chunk_id FROM counted),
{name} AS (
  SELECT src, chunk_id, min(a) AS char_start, max(b) AS char_end, count(*) AS n_words, substr(any_value(s.text), min(a) + 1, max(b) - min(a)) AS text
  FROM windows JOIN words USING (src) JOIN {source} s USING (src) WHERE i >= chunk_id * {step} AND i < chunk_id * {step} + {tokens} GROUP BY ALL)""".replace(" GROUP BY ALL)", " GROUP BY src, chunk_id)")


DOC_CHUNKS = "docs AS (SELECT doc_id AS src, text FROM documents), " + chunks("docs", 512, 435)
PASSAGE = (
    f"{BENCH}, {DOC_CHUNKS}, cid AS (SELECT src * 1000000 + chunk_id AS id, src, chunk_id, text FROM chunks), {hash_vectors('qv', 'bench')}, {hash_vectors('cv', 'cid')}, "
    f"tokens AS (SELECT id, {TOKENS.format(t='text')} AS term FROM cid), {POSTINGS}, " + BM25.replace("{all}", "cid").replace("{lengths}", "lengths")
)
SNIPPET = r"CASE WHEN length(f) > 240 THEN rtrim(substr(f, 1, 240)) || '…' ELSE f END"


def passage(pool: int, lex_from: str = "", keep: str = "TRUE", best: str = "TRUE") -> str:
    lex = LEX.format(pool=pool)
    if lex_from:
        lex = lex.replace("FROM scores)", f"FROM scores WHERE {lex_from})")
    return rf"""WITH {PASSAGE}, {lex}, {VEC.format(base='cv', pool=pool)}, {FUSED},
hits AS (SELECT f.*, src, chunk_id, text, row_number() OVER (PARTITION BY query_id, src ORDER BY fused_rank) AS first FROM fused f JOIN cid USING (id) WHERE {keep}),
shaped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM hits WHERE {best})
SELECT query_id, rank, src AS source_file, chunk_id, {SNIPPET} AS snippet, round(score, 6) AS score
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM shaped WHERE rank <= 5)"""


NOTE = r"""concat('---', chr(10), 'tags: [', lang, ', ''', source, ''']', chr(13), chr(10), 'kind: note', chr(10), '---', chr(10), chr(10), '# Doc ', doc_id, chr(13), chr(10), 'See [[', source, '| ', lang, ' notes ]] and ![[', lang, ']].', chr(10), text)"""
BODY = r"""trim(regexp_replace(regexp_replace(regexp_replace({t}, '\A---(?:\r\n|\n|\r)(?:[^\r\n]*(?:\r\n|\n|\r))*?---(?:\r\n|\n|\r|\z)', ''), '\r\n?', chr(10), 'g'),
  '!?\[\[(?:[^\[\]|]+?\|\s*([^\[\]]+?)\s*|\s*([^\[\]|]+?)\s*)\]\]', '\1\2', 'g'), chr(10)) || chr(10)"""
KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({t})), '[^\p{{L}}\p{{M}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"
TAG = r"trim(regexp_replace(lower(trim({t})), '[-_\s]+', '-', 'g'), '-')"
PART_TAGS = "notes AS (SELECT p_partkey AS source_file, list_concat(string_split(p_name, ' '), [p_type, replace(p_brand, '#', '_')]) AS tags FROM part)"
RARE_TAGS = "notes AS (SELECT p_partkey AS source_file, [p_type, 'price_' || p_retailprice::DECIMAL(12,2)::VARCHAR] AS tags FROM part)"
CARRIED = "carried AS (SELECT DISTINCT source_file, unnest(tags) AS tag FROM notes), n AS (SELECT tag, count(*) AS n FROM carried GROUP BY tag)"
VARIANTS = """vocabulary AS (SELECT DISTINCT unnest([p_brand, lower(replace(p_brand, '#', ' ')), p_type, 'my-' || lower(p_type), replace(p_name, ' ', '_'), replace(p_name, ' ', '-'),
  split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS tag FROM part)"""


def near(a: str, b: str) -> str:
    x, y = TAG.format(t=a), TAG.format(t=b)
    tx, ty = f"string_split({x}, '-')", f"string_split({y}, '-')"
    cut = lambda p, q: f"(len({p}) = len({q}) + 1 AND ({p}[:len({q})] = {q} OR {p}[2:] = {q}))"
    return f"({x} = {y} OR ({x} <> '' AND {y} <> '' AND (levenshtein({x}, {y}) <= 1 OR {cut(tx, ty)} OR {cut(ty, tx)})))"


TERMS = f"""terms AS (
  SELECT lower(replace(n_name, '_', '-')) AS slug, n_name AS display, ['Nation No. ' || n_nationkey, 'region ' || n_regionkey] AS aliases FROM nation
  UNION ALL SELECT {KEY.format(t='r_name')}, r_name, ['region ' || r_regionkey] FROM region),
named AS (SELECT slug, display, unnest(list_concat([slug], aliases)) AS name, unnest(range(len(aliases) + 1)) AS ordinal FROM terms),
wanted AS (SELECT slug, display, {KEY.format(t='name')} AS key, ordinal FROM named WHERE {KEY.format(t='name')} <> ''),
keys AS (SELECT key, slug, display FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY slug, ordinal) AS r FROM wanted) WHERE r = 1)"""
ASKED = """asked AS (SELECT DISTINCT unnest(['What is ' || n_name || '?', 'define nation no ' || n_nationkey, n_name || 'x', 'Region_' || n_regionkey]) AS term FROM nation)"""
BARE = r"regexp_replace(regexp_replace({t}, '^(?:what-is|what-are|whats|what-does|define|definition-of|meaning-of)-', ''), '-(?:mean|means|defined)$', '')"

LAYERS = """notes AS (SELECT doc_id AS source_file, 'sha256:' || sha256(text) AS now FROM documents),
side AS (SELECT labels.doc_id * 2 AS source_file, CASE WHEN toxic = 1 THEN 'model' ELSE 'test' END AS backend, 'sha256:' || sha256(CASE WHEN lang = 'en' THEN text ELSE coalesce(text, '') || '!' END) AS stored,
  CASE WHEN quality = 1 THEN 64 WHEN toxic = 0 THEN 32 END AS dim FROM labels LEFT JOIN documents d ON d.doc_id = labels.doc_id * 2),
idx AS (SELECT DISTINCT vec_id AS source_file FROM embeddings),
found AS (
  SELECT 'notes_wo_sidecar' AS kind, source_file FROM notes WHERE source_file NOT IN (SELECT source_file FROM side)
  UNION ALL SELECT 'orphan_sidecars', source_file FROM side WHERE source_file NOT IN (SELECT source_file FROM notes)
  UNION ALL SELECT 'missing_from_db', source_file FROM side WHERE source_file IN (SELECT source_file FROM notes) AND source_file NOT IN (SELECT source_file FROM idx)
  UNION ALL SELECT 'stale_in_db', source_file FROM idx WHERE source_file NOT IN (SELECT source_file FROM side JOIN notes USING (source_file))
  UNION ALL SELECT 'unreadable', source_file FROM side WHERE dim IS NULL
  UNION ALL SELECT 'bad_dim', source_file FROM side WHERE dim <> 64
  UNION ALL SELECT 'mixed', source_file FROM side WHERE dim IS NOT NULL AND backend <> 'test'
  UNION ALL SELECT 'stale_hash', source_file FROM side JOIN notes USING (source_file) WHERE dim IS NOT NULL AND stored <> now)"""

FEED = """feed AS (SELECT event_id AS seq, event_type AS e, 'n' || user_id AS path, 'n' || (user_id + 1000) AS new_path FROM events),
ops AS (
  SELECT path, 'upsert' AS op, seq, 1 AS step FROM feed WHERE e IN ('signup', 'view') UNION ALL SELECT new_path, 'upsert', seq, 1 FROM feed WHERE e IN ('click', 'purchase')
  UNION ALL SELECT path, 'delete', seq, 0 FROM feed WHERE e IN ('error', 'purchase')),
net AS (SELECT path, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC, step DESC) AS r FROM ops) WHERE r = 1)"""

GLOSS = [("nation-one", "the of"), ("re", "re"), ("idiot", "Idiot"), ("de-la", "de la"), ("mit-license", "MIT License")]
LINKED_BODY = "'[[re|the of]] ' || text"


def unlinked() -> str:
    """A word boundary by padding: the phrase between characters that are no word's."""
    rows = ", ".join(f"('{a}', '{b}')" for a, b in GLOSS)
    return rf"""WITH terms(slug, surface) AS (VALUES {rows}), notes AS (SELECT doc_id, {LINKED_BODY} AS body FROM documents)
SELECT doc_id, slug FROM notes, terms
WHERE lower(slug) NOT IN ('re') AND lower(surface) NOT IN ('re')
  AND regexp_matches(regexp_replace(body, '\[\[[^\]]*\]\]', '[[]]', 'g'), '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || surface || '($|[^\p{{L}}\p{{M}}\p{{N}}_])')"""


BLOCK = "CASE WHEN text = '' THEN '' WHEN text LIKE '%' || chr(10) THEN text || chr(10) ELSE text || chr(10) || chr(10) END"
STRIPPED = "rtrim(text, chr(10))"

ORACLES: dict[str, str] = {
    "knn_exact": f"WITH {PAIRS} SELECT src AS query_id, rank, dst AS id, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs) WHERE rank <= 5",
    "knn_label_vote": f"""WITH {EDGES}, votes AS (SELECT src, b.label, count(*) AS votes FROM edges JOIN e b ON b.id = dst GROUP BY ALL)
SELECT src, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY votes DESC, label) AS r FROM votes) WHERE r = 1""",
    "knn_graph_neighbors": f"WITH {EDGES} SELECT src, rank, dst, distance FROM edges",
    "knn_graph_mutual_links": f"WITH {EDGES}, {LINKS.format(t=0.9)} SELECT src, rank, dst, distance FROM links",
    "knn_probed_recall": f"WITH {EDGES} SELECT count(DISTINCT src) AS n_vectors, count(*) AS n_true, true AS recall_reached FROM edges",
    "knn_distance_summary": f"WITH {EDGES} SELECT count(*) AS n, min(distance) AS min_distance, round(quantile_cont(distance, 0.5), 6) AS median_distance, max(distance) AS max_distance FROM edges",
    "knn_calibration": f"WITH {EDGES} SELECT src, 'note-' || src AS src_name, rank, 'note-' || dst AS dst_name, distance, distance < 0.9 AS links FROM edges",
    "rrf_vector_only": f"WITH {PAIRS} SELECT src AS query_id, rank, dst AS id, round(1.0::DOUBLE / (60 + rank), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs) WHERE rank <= 5",
    "hash_embed": f"WITH {BENCH}, {hash_vectors('qv', 'bench')} SELECT id AS query_id, unnest(range(768)) AS place, unnest(v) AS value FROM qv",
    "tokens_postings": f"WITH {DOC_TOKENS}, {POSTINGS} SELECT term, id AS doc_id, tf FROM postings",
    "corpus_stats": f"""WITH {DOC_TOKENS}, {POSTINGS}, df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT round(avg(dl), 6) FROM lengths) AS avg_len, count(*) AS n_terms, max(df) AS max_df FROM df""",
    "query_terms": r"""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT item_id, len(w) AS n_terms, array_to_string(list_transform(w, lambda x: '"' || x || '"'), ' OR ') AS expression FROM q""",
    "bm25_topk": f"WITH {DOC_BM25} SELECT query_id, rank, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 20",
    "bm25_within_source": f"""WITH {DOC_BM25} SELECT query_id, source, rank, id AS doc_id, score FROM (
  SELECT s.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS rank FROM scores s JOIN documents d ON d.doc_id = id) WHERE rank <= 3""",
    "rrf_hybrid_search": f"""WITH {BENCH}, texts AS (SELECT doc_id AS id, text FROM documents), {hash_vectors('qv', 'bench')}, {hash_vectors('dv', 'texts')}, {DOC_BM25}, {LEX.format(pool=20)}, {VEC.format(base='dv', pool=20)}, {FUSED}
SELECT query_id, fused_rank AS rank, id, round(score, 6) AS score FROM fused WHERE fused_rank <= 5""",
    "passage_best_per_source": passage(20, best="first = 1"),
    "passage_all_chunks": passage(20),
    "passage_within_document": passage(1_000_000, lex_from="id // 1000000 = 3", keep="src = 3"),
    "passage_fetch": f"WITH {DOC_CHUNKS} SELECT src AS source_file, chunk_id, char_start, char_end, text FROM chunks WHERE chunk_id = 1",
    "chunk_documents": f"WITH {DOC_CHUNKS} SELECT src AS source_file, chunk_id, n_words, 'sha256:' || sha256(text) AS text_hash FROM chunks",
    "chunk_offsets": f"WITH docs AS (SELECT doc_id AS src, text FROM documents), {chunks('docs', 50, 38)} SELECT src AS doc_id, chunk_id, char_start, char_end FROM chunks",
    "paged_source_spans": """WITH p AS (SELECT conv_id, turn + 1 AS page, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM conversations)
SELECT conv_id, page, a AS char_start, a + n AS char_end FROM p""",
    "chunk_page_asof": f"""WITH docs AS (SELECT conv_id AS src, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {chunks('docs', 20, 17)},
pages AS (SELECT conv_id AS src, turn + 1 AS page, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)
SELECT c.src AS conv_id, chunk_id, page, char_start, char_end FROM chunks c ASOF LEFT JOIN pages p ON c.src = p.src AND c.char_start >= p.start""",
    "canonical_body": f"SELECT doc_id, {BODY.format(t=NOTE)} AS body FROM documents",
    "content_hash": f"SELECT 'd' || doc_id AS source_file, 'sha256:' || sha256({BODY.format(t=NOTE)}) AS content_hash FROM documents UNION ALL SELECT 'p' || page_id, 'sha256:' || sha256(html) FROM pages",
    "parse_tags": "SELECT doc_id AS id, lang || '|' || source AS tags, 2 AS n FROM documents UNION ALL SELECT -p_partkey - 1, p_type || '|' || p_brand, 2 FROM part",
    "slugify_titles": r"SELECT p_partkey, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug, t AS display FROM (SELECT p_partkey, p_name || ' & Co.! ' || p_brand AS t FROM part)",
    "normalize_keys": f"""WITH d AS (SELECT doc_id, {KEY.format(t="' What is ' || text || '?'")} AS key, {TAG.format(t='text')} AS tag FROM documents)
SELECT doc_id, key, {BARE.format(t='key')} AS bare, tag FROM d""",
    "snippets": rf"SELECT doc_id, {SNIPPET} AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)",
    "long_documents": r"SELECT doc_id, n_lines FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS n_lines FROM documents) WHERE n_lines > 20",
    "path_views": """WITH d AS (SELECT doc_id, ['projects', 'areas', 'resources', 'archive', 'glossary'][doc_id % 5 + 1] AS root, source, lang FROM documents),
p AS (SELECT *, CASE WHEN lang = 'de' THEN '.txt' ELSE '.md' END AS ext, 'vault/' || root || '/' || source || '/' AS dir, 'n.' || doc_id AS name FROM d)
SELECT doc_id, root <> 'glossary' AND ext = '.md' AS in_scope, name AS stem, dir || '.' || name || '.embed.json' AS sidecar, dir || '.' || name || ext || '.embed.json' AS chunk_sidecar, dir || name || '.md' AS source_file, dir || name || ext AS relative FROM p""",
    "managed_blocks": f"""SELECT doc_id, sha256({BLOCK} || '<a>' || chr(10) || source || chr(10) || '</a>' || chr(10)) AS once, sha256({BLOCK} || '<a>' || chr(10) || 'new' || chr(10) || '</a>' || chr(10)) AS twice,
sha256(CASE WHEN {STRIPPED} = '' THEN '' ELSE {STRIPPED} || chr(10) END) AS removed, 'broken' AS state FROM documents""",
    "tag_counts": f"WITH {PART_TAGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY tag",
    "tag_carriers": f"WITH {PART_TAGS}, {CARRIED} SELECT tag, n FROM n",
    "tag_listing_capped": f"""WITH {PART_TAGS}, c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) WHERE lower(tag) LIKE '%b%' GROUP BY tag)
SELECT tag, n, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 20 AS truncated FROM c ORDER BY n DESC, tag LIMIT 20""",
    "tag_near_universal": f"WITH {PART_TAGS}, {CARRIED} SELECT tag, n, round(n / (SELECT count(*) FROM notes), 6) AS fraction FROM n WHERE n / (SELECT count(*) FROM notes) >= 0.12",
    "tag_singletons": f"""WITH notes AS (SELECT p_partkey AS source_file, [p_type, p_retailprice::DECIMAL(12,2)::VARCHAR || '_' || p_size] AS tags FROM part), {CARRIED}
SELECT tag, min(source_file) AS source_file FROM carried GROUP BY tag HAVING count(*) = 1""",
    "tag_format_lint": f"WITH {RARE_TAGS}, {CARRIED} SELECT tag, 'underscore' AS reason FROM n WHERE contains(tag, '_')",
    "tag_overlap_jaccard": f"""WITH {PART_TAGS}, {CARRIED}, both_ AS (SELECT a.tag AS a, b.tag AS b, count(*) AS k FROM carried a JOIN carried b USING (source_file) WHERE a.tag < b.tag GROUP BY ALL)
SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM both_ JOIN n x ON x.tag = a JOIN n y ON y.tag = b WHERE k / (x.n + y.n - k) >= 0.05 AND x.n + y.n - k >= 2""",
    "tag_near_miss": f"WITH {VARIANTS} SELECT x.tag AS a, y.tag AS b FROM vocabulary x JOIN vocabulary y ON x.tag < y.tag WHERE {near('x.tag', 'y.tag')}",
    "tag_write_hint": f"""WITH {VARIANTS}, proposed AS (SELECT DISTINCT replace(p_name, ' ', '-') || 's' AS tag FROM part)
SELECT p.tag, string_agg(v.tag, '|' ORDER BY v.tag) AS existing, min(v.tag) AS first FROM proposed p JOIN vocabulary v ON p.tag <> v.tag AND {near('p.tag', 'v.tag')} GROUP BY p.tag""",
    "tag_apply_mapping": f"""WITH {PART_TAGS}, m AS (SELECT source_file, array_to_string(tags, '|') AS old, unnest(range(len(tags))) AS i, unnest(list_transform(tags, lambda t:
  CASE t WHEN 'PROMO' THEN 'promo' WHEN 'ECONOMY' THEN 'budget' WHEN 'SMALL' THEN 'budget' WHEN 'small' THEN '' WHEN 'red' THEN 'crimson' WHEN 'blue' THEN 'navy' ELSE t END)) AS t FROM notes),
f AS (SELECT source_file, old, t, min(i) AS i FROM m WHERE t <> '' GROUP BY ALL), g AS (SELECT source_file, old, string_agg(t, '|' ORDER BY i) AS new FROM f GROUP BY ALL)
SELECT source_file, old, new FROM g WHERE old <> new""",
    "tag_hygiene_report": f"""WITH {RARE_TAGS}, {CARRIED}, v AS (SELECT tag FROM n WHERE n / (SELECT count(*) FROM notes) < 0.8),
both_ AS (SELECT a.tag AS a, b.tag AS b, count(*) AS k FROM carried a JOIN carried b USING (source_file) WHERE a.tag < b.tag GROUP BY ALL)
SELECT 'near_universal' AS kind, tag, NULL AS other, round(n / (SELECT count(*) FROM notes), 6) AS value FROM n WHERE n / (SELECT count(*) FROM notes) >= 0.8
UNION ALL SELECT 'singleton', tag, min(source_file)::VARCHAR, 1.0 FROM carried GROUP BY tag HAVING count(*) = 1
UNION ALL SELECT 'near_miss', x.tag, y.tag, NULL FROM v x JOIN v y ON x.tag < y.tag WHERE {near('x.tag', 'y.tag')}
UNION ALL SELECT 'format_lint', tag, 'underscore', NULL FROM n WHERE contains(tag, '_')
UNION ALL SELECT 'overlap', a, b, round(k / (x.n + y.n - k), 6) FROM both_ JOIN n x ON x.tag = a JOIN n y ON y.tag = b WHERE k / (x.n + y.n - k) >= 0.6 AND x.n + y.n - k >= 2""",
    "tag_hygiene_lines": f"""WITH {RARE_TAGS}, {CARRIED}, t AS (SELECT count(*) AS total FROM notes), v AS (SELECT tag FROM n WHERE n / (SELECT total FROM t) < 0.8),
both_ AS (SELECT a.tag AS a, b.tag AS b, count(*) AS k FROM carried a JOIN carried b USING (source_file) WHERE a.tag < b.tag GROUP BY ALL)
SELECT 'near_universal' AS kind, tag, tag || '  (' || n || '/' || total || ', ' || round_even(100 * n / total, 0)::INT || '%)' AS line FROM n, t WHERE n / total >= 0.8
UNION ALL SELECT 'singleton', tag, tag || '  (' || min(source_file) || ')' FROM carried GROUP BY tag HAVING count(*) = 1
UNION ALL SELECT 'near_miss', x.tag, x.tag || '  ~  ' || y.tag FROM v x JOIN v y ON x.tag < y.tag WHERE {near('x.tag', 'y.tag')}
UNION ALL SELECT 'format_lint', tag, tag || '  — underscore' FROM n WHERE contains(tag, '_')
UNION ALL SELECT 'overlap', a, a || ' + ' || b || '  (Jaccard ' || round_even(100 * (k / (x.n + y.n - k)), 0)::INT || '%)' FROM both_ JOIN n x ON x.tag = a JOIN n y ON y.tag = b WHERE k / (x.n + y.n - k) >= 0.6 AND x.n + y.n - k >= 2""",
    "glossary_listing": f"""WITH {TERMS}, f AS (SELECT slug, display, array_to_string(aliases, '|') AS aliases FROM terms WHERE contains(lower(display), 'on 1') OR len(list_filter(aliases, lambda a: contains(lower(a), 'on 1'))) > 0)
SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 10 AS truncated FROM f ORDER BY slug LIMIT 10""",
    "glossary_keys": f"WITH {TERMS} SELECT key, slug, display FROM keys",
    "glossary_collisions": f"WITH {TERMS} SELECT key, string_agg(DISTINCT slug, '|' ORDER BY slug) AS slugs FROM wanted GROUP BY key HAVING count(DISTINCT slug) > 1",
    "glossary_lookup": f"""WITH {TERMS}, {ASKED}, q AS (SELECT term, {KEY.format(t='term')} AS k1 FROM asked)
SELECT term, coalesce(a.slug, b.slug) AS slug, coalesce(a.display, b.display) AS display FROM q LEFT JOIN keys a ON a.key = k1 LEFT JOIN keys b ON b.key = {BARE.format(t='k1')}""",
    "glossary_unlinked": unlinked(),
    "link_lines": f"""WITH {EDGES}, {LINKS.format(t=0.9)}, named AS (SELECT src, list_sort(list('note-' || dst)) AS names FROM links GROUP BY src)
SELECT src, sha256(concat('---', chr(10), 'tags: [x]', chr(10), chr(10), '# >>> related (managed) >>>', chr(10), 'related_auto:', chr(10), array_to_string(list_transform(names, lambda x: '  - "[[' || x || ']]"'), chr(10)), chr(10), '# <<< related (managed) <<<', chr(10), '---', chr(10), 'body', chr(10))) AS note_sha256, array_to_string(names, '|') AS names FROM named""",
    "notes_under_root": """WITH f AS (SELECT 'n' || doc_id AS title, 'vault/areas/' || source || '/n' || doc_id || '.md' AS source_file FROM documents WHERE doc_id % 4 = 1 AND contains(doc_id::VARCHAR, '7'))
SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 50 AS truncated FROM f ORDER BY source_file LIMIT 50""",
    "ingest_summary": f"""WITH docs AS (SELECT conv_id AS src, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {chunks('docs', 20, 15)},
c AS (SELECT src, count(*) AS chunks FROM chunks GROUP BY src)
SELECT conv_id AS source_file, count(*) AS pages, coalesce(any_value(chunks), 0) AS chunks FROM conversations LEFT JOIN c ON src = conv_id GROUP BY conv_id""",
    "root_counts": "SELECT r AS root, count(source) AS n FROM (VALUES ('src0'), ('src1'), ('src2'), ('nowhere')) t(r) LEFT JOIN documents ON source = r GROUP BY r",
    "source_listing_paged": "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 50 OFFSET 20",
    "change_gate": "SELECT doc_id, 'test' AS backend, 'sha256:' || sha256(text) AS content_hash FROM documents WHERE lang = 'fr' OR source = 'src5'",
    "layer_audit": f"WITH {LAYERS} SELECT kind, source_file FROM found",
    "layer_verdict": f"WITH {LAYERS} SELECT kind, count(*) AS n FROM found GROUP BY kind",
    "repair_plan": f"""WITH {LAYERS}, acts AS (SELECT DISTINCT CASE WHEN kind = 'orphan_sidecars' THEN 'drop_sidecar' WHEN kind IN ('missing_from_db', 'stale_in_db') THEN 'rebuild' ELSE 'embed' END AS action, source_file FROM found)
SELECT action, source_file FROM acts WHERE action <> 'embed' OR source_file NOT IN (SELECT source_file FROM found WHERE kind = 'orphan_sidecars')""",
    "incremental_apply": f"""WITH {FEED} SELECT DISTINCT 'n' || user_id AS path, 0 AS size FROM events WHERE 'n' || user_id NOT IN (SELECT path FROM net)
UNION ALL SELECT path, length(path) FROM net WHERE op = 'upsert'""",
    "stream_apply_equals_batch": f"WITH {FEED} SELECT path, length(path) AS size FROM net WHERE op = 'upsert'",
}
# The same rows by another way.
ORACLES["knn_indexed"] = ORACLES["knn_exact"]
ORACLES["knn_graph_indexed"] = ORACLES["knn_graph_mutual_links"]
ORACLES["bm25_unindexed"] = ORACLES["bm25_topk"]

VAULT = """place AS (SELECT event_id AS seq, event_type AS e, user_id, user_id + 1000 AS new_id, ['projects', 'areas', 'resources', 'archive', 'glossary'] AS roots FROM events),
feed AS (SELECT seq, e, user_id % 5 < 4 AS own_in, new_id % 5 < 4 AS new_in, 'vault/' || roots[user_id % 5 + 1] || '/n' || user_id || '.md' AS path, 'vault/' || roots[new_id % 5 + 1] || '/n' || new_id || '.md' AS new_path FROM place),
ops AS (
  SELECT path, 'upsert' AS op, seq, 1 AS step FROM feed WHERE e IN ('signup', 'view') AND own_in UNION ALL SELECT new_path, 'upsert', seq, 1 FROM feed WHERE e IN ('click', 'purchase') AND new_in
  UNION ALL SELECT path, 'delete', seq, 0 FROM feed WHERE e IN ('error', 'purchase') AND own_in),
net AS (SELECT path, op FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC, step DESC) AS r FROM ops) WHERE r = 1)"""
ORACLES["staged_notes"] = f"WITH {VAULT} SELECT DISTINCT CASE WHEN e = 'click' THEN new_path ELSE path END AS path FROM feed WHERE (e IN ('signup', 'view') AND own_in) OR (e = 'click' AND new_in)"
ORACLES["stream_scoped_state"] = f"WITH {VAULT} SELECT path, length(path) AS size FROM net WHERE op = 'upsert'"
ORACLES["note_sidecar_files"] = f"""WITH notes AS (SELECT doc_id AS id, source, trim(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) || chr(10) AS text FROM documents), {hash_vectors("nv", "notes", 1)}
SELECT 'areas/' || source || '/.n' || id || '.embed.json' AS sidecar, 'note' AS doc_kind, 'areas/' || source || '/n' || id || '.md' AS source_file, 'test' AS type, 'sha256:' || sha256(text) AS content_hash,
  array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT), ',') AS millionths, true AS unstamped FROM notes JOIN nv USING (id)"""
ORACLES["chunk_sidecar_files"] = ORACLES["chunk_page_asof"].replace(
    "SELECT c.src AS conv_id, chunk_id, page, char_start, char_end FROM chunks",
    "SELECT 'inbox/.c' || c.src || '.pdf.embed.json' AS sidecar, 'chunked' AS doc_kind, 'inbox/c' || c.src || '.pdf' AS source_file, 20 AS chunk_tokens, chunk_id, page, char_start, char_end, 'sha256:' || sha256(text) AS text_hash, 8 AS dim FROM chunks",
)
# Before a text go eight lines, or with an empty text those alone.
ORACLES["link_pass_patches"] = "SELECT doc_id, 7 AS n_added, 0 AS n_removed, 1 AS n_hunks, true AS applies FROM documents"
ORACLES["frontmatter_splits"] = "SELECT doc_id, 44 AS head_chars, sha256(text) AS body_sha256, 36 AS inner_chars, true AS whole, 'one|two words' AS aliases FROM documents"
ORACLES["linked_forms"] = r"""SELECT p_partkey, '[[' || s || CASE WHEN s = p_name THEN '' ELSE '|' || p_name END || ']]' AS link, '[[' || p_type || ']]' AS bare
FROM (SELECT *, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)"""
ORACLES["hit_lines"] = "SELECT doc_id, printf('%.4f', 1::DOUBLE / (60 + n_chars)) || '  areas/' || source || '/n' || doc_id || '.md' AS line FROM documents"
ORACLES["paged_repair"] = """WITH s AS (
  SELECT vec_id AS source_file, label, page_id IS NULL AS gone, page_id % 7 = 0 AS unread FROM embeddings LEFT JOIN pages ON page_id = vec_id)
SELECT * FROM (SELECT CASE WHEN gone THEN 'drop_sidecar' WHEN label IN (2, 3) OR (label = 1 AND NOT unread) THEN 'ingest' WHEN label = 4 THEN 'load' END AS action, source_file FROM s) WHERE action IS NOT NULL"""
ORACLES["intake_check"] = """WITH f AS (SELECT '/in/' || source || '/n' || doc_id % 300 || CASE WHEN lang = 'de' THEN '.txt' ELSE '.PDF' END AS path FROM documents),
p AS (SELECT path, 'vault/areas/' || split_part(path, '/', 4) AS source_file FROM f),
t AS (SELECT 'vault/areas/n' || doc_id || '.PDF' AS source_file FROM documents WHERE lang = 'fr')
SELECT path, source_file, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'not a .pdf' WHEN source_file IN (SELECT source_file FROM t) THEN 'destination exists' WHEN path <> min(path) OVER (PARTITION BY source_file) THEN 'another file takes this name' END AS refused FROM p"""
ORACLES["passage_index_upkeep"] = f"""WITH docs AS (SELECT conv_id AS src, string_agg(CASE WHEN conv_id % 3 = 0 THEN text || ' and five more words here' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id), {chunks('docs', 20, 15)}
SELECT 'c' || src AS source_file, count(*) AS chunks, count(*) AS numbers, (SELECT count(*) FROM chunks) AS n_chunks FROM chunks GROUP BY src"""
TERM_NOTE = "concat('---', chr(10), 'type: glossary', chr(10), 'aliases: [', {a}, ']', chr(10), 'tags: [glossary]', chr(10), '---', chr(10), chr(10), '# ', {t}, chr(10), chr(10), {t}, ' ? ', {d}, chr(10), chr(10), '#flashcards/glossary', chr(10))"
ORACLES["new_terms"] = f"""WITH q AS (
  SELECT r_name || ' Zone' AS term, {KEY.format(t="r_name || ' Zone'")} AS slug, NULL AS refused, 'zone ' || r_regionkey AS a, 'A part of the world.' AS d FROM region
  UNION ALL SELECT n_name || '!', k, k || ' is taken by ' || k, '', 'A one-line definition — state the meaning atomically, one term, one idea.' FROM (SELECT n_name, {KEY.format(t='n_name')} AS k FROM nation))
SELECT term, slug, refused, sha256({TERM_NOTE.format(a='a', t='term', d='d')}) AS text_sha256 FROM q"""

# Vaults.
VAULT_NOTES = f"""d AS (SELECT *, ['projects', 'areas', 'resources', 'archive', 'templates'][doc_id % 5 + 1] AS root FROM documents),
notes AS (SELECT root || '/' || source || '/n' || doc_id AS p, root, doc_id, lang || '|' || source AS tags, {NOTE} AS note FROM d)"""
ORACLES["vault_seeded_notes"] = f"""WITH {VAULT_NOTES} SELECT p || '.md' AS source_file, root, 'n' || doc_id AS stem, tags, sha256(note) AS text_sha256, 'sha256:' || sha256({BODY.format(t='note')}) AS content_hash FROM notes WHERE root <> 'templates'"""
ORACLES["vault_wiped"] = f"""WITH {VAULT_NOTES}, files AS (
  SELECT p || '.md' AS path, strlen(note) AS size, root <> 'templates' AS removed FROM notes
  UNION ALL SELECT replace(p, '/n', '/.n') || '.embed.json', 2, root <> 'templates' FROM notes UNION ALL SELECT p || '.txt', 2, false FROM notes)
SELECT * FROM files"""
ORACLES["intake_moved"] = """WITH f AS (SELECT doc_id % 2 || '/' || source || '/n' || doc_id // 2 || CASE WHEN lang = 'de' THEN '.txt' ELSE '.PDF' END AS path, 'areas/n' || doc_id // 2 || CASE WHEN lang = 'de' THEN '.txt' ELSE '.PDF' END AS place, strlen(coalesce(text, '')) AS size FROM documents),
t AS (SELECT DISTINCT 'areas/n' || doc_id || '.PDF' AS place FROM documents WHERE lang = 'fr'),
c AS (SELECT *, place LIKE '%.PDF' AND place NOT IN (SELECT place FROM t) AND path = min(path) OVER (PARTITION BY place) AS moves FROM f)
SELECT 'vault/' || place AS path, 3 AS size, 'vault' AS place FROM t UNION ALL SELECT 'vault/' || place, size, 'vault' FROM c WHERE moves UNION ALL SELECT path, size, 'inbox' FROM c WHERE NOT moves"""
ORACLES["term_files"] = f"""WITH b AS (SELECT c_name AS t, 'customer of nation ' || c_nationkey AS a, c_acctbal < 0 AS debt FROM customer UNION ALL SELECT s_name, 'supplier of nation ' || s_nationkey, s_acctbal < 0 FROM supplier),
x AS (SELECT *, CASE WHEN debt THEN 'In debt.' ELSE 'A one-line definition — state the meaning atomically, one term, one idea.' END AS said FROM b WHERE NOT (debt AND t LIKE '%7'))
SELECT trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug, t AS display, a || '|party' AS aliases, sha256({TERM_NOTE.format(a="a, ', ', chr(39), 'party', chr(39)", t='t', d='said')}) AS text_sha256 FROM x"""
ORACLES["note_index_upkeep"] = f"""WITH n AS (SELECT *, lang = 'en' AND source = 'src3' AS gone, {NOTE} AS t FROM documents WHERE lang <> 'fr'),
m AS (SELECT doc_id, lang, source, gone, {BODY.format(t="(CASE WHEN lang = 'de' THEN t || ' geändert' ELSE t END)")} AS body FROM n)
SELECT 'vault/' || CASE WHEN lang = 'es' THEN 'archive' ELSE 'areas' END || '/n' || doc_id || '.md' AS source_file, 'sha256:' || sha256(body) AS content_hash, 8 AS dim,
  CASE WHEN NOT gone THEN sha256(body) END AS body_sha256, CASE WHEN NOT gone THEN lang || '|' || source END AS tags FROM m"""
REWRITTEN = NOTE.replace("'tags: [', lang, ', ''', source, ''']'", "'tags: [', tags, ']'")
ORACLES["tag_rewrite"] = f"""WITH n AS (SELECT *, [x FOR x IN [CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN '' ELSE lang END, CASE source WHEN 'src3' THEN 'fr' ELSE source END] IF x <> ''] AS new FROM documents WHERE lang IN ('en', 'fr') OR source = 'src3'),
m AS (SELECT doc_id, lang, source, text, new, array_to_string(new, ', ') AS tags FROM n)
SELECT doc_id, sha256({REWRITTEN}) AS text_sha256, array_to_string(new, '|') AS tags FROM m"""
ORACLES["composed_notes"] = f"""WITH {VARIANTS}, titles AS (SELECT p_name AS title, count(*) AS n, bool_or(p_size = 7) AS taken, replace(p_name, ' ', '-') AS slug FROM part GROUP BY p_name),
tags AS (SELECT title, unnest([slug || 's', 'part']) AS tag FROM titles),
hints AS (SELECT title, string_agg(DISTINCT tag || ' ~ ' || first, '|' ORDER BY tag || ' ~ ' || first) AS hints FROM (
  SELECT title, t.tag, min(v.tag) AS first FROM tags t JOIN vocabulary v ON t.tag <> v.tag AND {near('t.tag', 'v.tag')} GROUP BY ALL) GROUP BY title)
SELECT title, slug, taken, sha256(concat('---', chr(10), 'tags: [', slug, 's, part]', chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), 'Parts of this name: ', n, chr(10))) AS text_sha256, coalesce(hints, '') AS hints
FROM titles LEFT JOIN hints USING (title)"""
# A phrase of two words is a term that stands where its words do; lengths are of words.
PHRASES = (
    f"words AS (SELECT doc_id AS id, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS ws, lang FROM documents), "
    "tokens AS (SELECT id, unnest(ws) AS term FROM words UNION ALL SELECT id, lang FROM words UNION ALL SELECT id, unnest(list_transform(list_zip(ws[:-2], ws[2:]), lambda x: x[1] || ' ' || x[2])) FROM words UNION ALL SELECT id, ws[-1] || ' ' || lang FROM words WHERE len(ws) > 0), "
    "postings AS (SELECT term, id, count(*) AS tf FROM tokens GROUP BY ALL), lengths AS (SELECT id, len(ws) + 1 AS dl FROM words), "
)
ORACLES["bm25_phrases"] = (
    f"WITH {PHRASES}" + BM25.replace("{all}", "documents").replace("{lengths}", "lengths").replace("strip_accents(word) AS term", "replace(strip_accents(word), '_', ' ') AS term").replace("regexp_extract_all(lower(text),", "regexp_extract_all(lower(regexp_replace(text, '([\\p{L}\\p{N}]+) ([\\p{L}\\p{N}]+)', '\\1_\\2', 'g')),")
    + " SELECT query_id, rank, id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 20"
)

# Mappings and scans of files.
ORACLES["tag_mapping_files"] = f"""WITH {PART_TAGS}, m AS (SELECT source_file, array_to_string(tags, '|') AS old, unnest(range(len(tags))) AS i, unnest(tags) AS t FROM notes),
w AS (SELECT source_file, old, i, CASE WHEN i < 2 THEN CASE WHEN t LIKE 'r%' THEN 'r' WHEN contains(t, 'a') THEN '' ELSE t END WHEN i = 2 THEN lower(t) ELSE lower(replace(t, '_', '-')) END AS t FROM m),
f AS (SELECT source_file, old, t, min(i) AS i FROM w WHERE t <> '' GROUP BY ALL)
SELECT source_file, old, string_agg(t, '|' ORDER BY i) AS new FROM f GROUP BY source_file, old HAVING old <> new"""
ORACLES["tag_rewrite_by_table"] = f"""WITH f AS (SELECT source, arg_min(lang, doc_id) AS first FROM documents GROUP BY source),
m AS (SELECT doc_id, lang, source, text, CASE WHEN lang = first THEN [lang] ELSE [lang, first] END AS new, array_to_string(new, ', ') AS tags FROM documents JOIN f USING (source))
SELECT doc_id, sha256({REWRITTEN}) AS text_sha256, array_to_string(new, '|') AS tags FROM m"""
ORACLES["tag_hygiene_json"] = f"""WITH {RARE_TAGS}, {CARRIED}, t AS (SELECT count(*) AS total FROM notes), v AS (SELECT tag FROM n WHERE n / (SELECT total FROM t) < 0.8),
both_ AS (SELECT a.tag AS a, b.tag AS b, count(*) AS k FROM carried a JOIN carried b USING (source_file) WHERE a.tag < b.tag GROUP BY ALL)
SELECT 'near_universal' AS kind, to_json({{'tag': tag, 'fraction': n / total}})::VARCHAR AS json FROM n, t WHERE n / total >= 0.8
UNION ALL SELECT 'singleton', to_json({{'tag': tag, 'note': min(source_file)::VARCHAR}})::VARCHAR FROM carried GROUP BY tag HAVING count(*) = 1
UNION ALL SELECT 'near_miss', to_json([x.tag, y.tag])::VARCHAR FROM v x JOIN v y ON x.tag < y.tag WHERE {near('x.tag', 'y.tag')}
UNION ALL SELECT 'format_lint', to_json({{'tag': tag, 'reason': 'underscore'}})::VARCHAR FROM n WHERE contains(tag, '_')
UNION ALL SELECT 'overlap', to_json({{'tags': [a, b], 'jaccard': k / (x.n + y.n - k)}})::VARCHAR FROM both_ JOIN n x ON x.tag = a JOIN n y ON y.tag = b WHERE k / (x.n + y.n - k) >= 0.6 AND x.n + y.n - k >= 2"""
ORACLES["link_invariance"] = f"""WITH d AS (SELECT doc_id, '[[re|the of]] ' || text AS t FROM documents) SELECT doc_id, 'sha256:' || sha256({BODY.format(t='t')}) AS content_hash FROM d"""
ORACLES["inbox_listing"] = """SELECT name, size FROM (SELECT CASE WHEN lang = 'en' THEN 'N' ELSE 'n' END || doc_id || '.pdf' AS name, strlen(coalesce(text, '')) AS size FROM documents WHERE source <> 'src1') ORDER BY lower(name), name LIMIT 50 OFFSET 50"""
ORACLES["sidecar_states"] = """SELECT 'areas/' || source || '/.n' || doc_id || '.embed.json' AS sidecar, CASE lang WHEN 'fr' THEN 'unreadable' WHEN 'es' THEN 'chunked' ELSE 'note' END AS doc_kind,
  CASE WHEN lang <> 'fr' THEN 'areas/' || source || '/n' || doc_id || '.md' END AS source_file, CASE WHEN lang = 'es' THEN sha256(text) END AS text_sha256 FROM documents"""
