"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, n.n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""


def quality_rules() -> str:
    """The base rules and, from the same sketches, the fences."""
    from .quality import LEAST_APART, METRICS, PRECISION, PRIOR

    ratio = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "stutter": ("n_stutter", "n_words"), "upper": ("n_upper", "word_chars")}
    values = ", ".join(f"(1000 * {a}) // greatest({b}, 1) AS {m}" for m, (a, b) in ratio.items())
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, {m} AS v FROM r" for m in METRICS)
    order = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(METRICS))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, {WORDS}) AS ws FROM d),
word AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS t FROM w),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (
  SELECT doc_id, unnest(range(len(ws) - 7)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda j: array_to_string(ws[j:j + 7], ' '))) AS g FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM windows, range(8) x(o) WHERE k > 1 GROUP BY doc_id),
line AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM d) WHERE regexp_matches(t, '[^\x20\x09-\x0D]') GROUP BY ALL),
lines AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM line GROUP BY doc_id),
stutter AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, t, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM word) WHERE t = b GROUP BY doc_id),
f AS (
  SELECT doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(stutter.n, 0) AS n_stutter, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN stutter USING (doc_id)),
r AS (SELECT *, {values}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
m AS (SELECT *, v - v % (1 << greatest(length(bin(v)) - {PRECISION}, 0)) AS b FROM ({long})),
own AS (SELECT lang, source, metric, b, count(*) AS n FROM m GROUP BY ALL),
merged AS (SELECT lang, metric, b, n * {PRIOR}::DOUBLE / sum(n) OVER (PARTITION BY lang, metric) AS share FROM (SELECT lang, metric, b, sum(n) AS n FROM own GROUP BY ALL)),
pooled AS (
  SELECT g.lang, g.source, p.metric, p.b, p.share + coalesce(own.n, 0) AS w FROM (SELECT DISTINCT lang, source FROM own) g
  JOIN merged p ON p.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN own ON own.lang IS NOT DISTINCT FROM g.lang AND own.source IS NOT DISTINCT FROM g.source AND own.metric = p.metric AND own.b = p.b),
moments AS (
  SELECT lang, source, metric, b, sum(w) OVER u AS c, sum(w * sqrt(b)) OVER u AS s, sum(w) OVER g AS wt, sum(w * sqrt(b)) OVER g AS st, sum(w * b) OVER g AS qt, max(b) OVER g AS last
  FROM pooled WINDOW g AS (PARTITION BY lang, source, metric), u AS (PARTITION BY lang, source, metric ORDER BY b)),
split AS (
  SELECT *, round(pow(s / c - (st - s) / (wt - c), 2) * c * (wt - c) / wt / (qt - st * st / wt), 9) AS apart FROM moments WHERE b < last
  QUALIFY row_number() OVER (PARTITION BY lang, source, metric ORDER BY apart DESC, b) = 1),
failed AS (
  SELECT m.doc_id, string_agg(m.metric, ',' ORDER BY CASE m.metric {order} END) AS names
  FROM m JOIN split f ON f.metric = m.metric AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
  WHERE f.apart >= {LEAST_APART} AND m.b > f.b GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND names IS NULL AS kept, coalesce(names, '') AS failed_fences
FROM r LEFT JOIN failed USING (doc_id)
"""


RANKED = rf"""
WITH terms AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, ts, len(ts) AS n FROM terms WHERE len(ts) > 0),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term),
gains AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS gain FROM postings JOIN weights USING (term), stats),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""


def vector_codes() -> str:
    """The rounds one after another, each by comparing every part with every entry."""
    from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

    assign = """a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, x, min(d * {entries} + entry) AS found FROM (
    SELECT p.*, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{i} USING (part)) GROUP BY ALL)"""
    update = """s{i} AS (SELECT part, entry, place, sum(v)::BIGINT AS s, count(*) AS n FROM (
    SELECT part, found % {entries} AS entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS y FROM s{i} GROUP BY ALL),
c{j} AS MATERIALIZED (SELECT part, entry, coalesce(y, c) AS c FROM c{i} LEFT JOIN m{i} USING (part, entry))"""
    rounds = ",\n".join(assign.format(i=i, entries=ENTRIES) + ",\n" + update.format(i=i, j=i + 1, entries=ENTRIES) for i in range(ROUNDS))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS x FROM v, range({PARTS}) r(part)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN seeds USING (vec_id)),
{rounds},
{assign.format(i=ROUNDS, entries=ENTRIES)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', found % {ENTRIES}), '' ORDER BY part) AS code, sum(found // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""


ORACLES = {"op2_quality_rules": quality_rules(), "op4_exact_dedup": EXACT_DEDUP, "op7_ngram_jaccard_join": NGRAM_JOIN, "op11_ranked_search": RANKED, "op13_vector_codes": vector_codes()}
