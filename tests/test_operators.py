"""Operators on small fixtures with known results."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import settings
from corpusloom.functions import text as T
from corpusloom.functions.embedding import BatchEmbedder, HashEmbedder, embedder, normalised
from corpusloom.operators import audit, changes, chunking, glossary, graph, lexical, search, tags, vectors

GRID = " ".join(f"w{i}" for i in range(10))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("tokens", "overlap", "spans"), [(4, 0.25, [(0, 11), (9, 20), (18, 29)]), (5, 0, [(0, 14), (15, 29)]), (100, 0.15, [(0, 29)])])
def test_chunk_spans(tokens, overlap, spans):
    assert chunking.chunk_spans(GRID, tokens, overlap) == spans


@pytest.mark.parametrize("bad", [(0, 0.1), (5, 1.0), (5, -0.1)])
def test_chunk_parameters(bad):
    with pytest.raises(ValueError):
        chunking.chunk_spans("a", *bad)


def test_chunks_of_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, " \n "), (3, None), (4, "a b")], "id long, text string")
    assert [(r.id, r.text) for r in chunking.chunk_documents(df).collect()] == [(4, "a b")]


@pytest.mark.parametrize(("pages", "want"), [([(1, 0, 12), (2, 12, 29)], [1, 1, 2]), ([(1, 0, 5), (2, 20, 29)], [1, 1, 1])])
def test_pages_as_of(spark, pages, want):
    df = spark.createDataFrame([(GRID, pages)], "text string, spans array<struct<page:int,char_start:int,char_end:int>>")
    rows = chunking.chunk_documents(df, tokens=4, overlap=0.25, spans="spans").orderBy("chunk_id").collect()
    assert [r.page for r in rows] == want
    assert all(GRID[r.char_start : r.char_end] == r.text for r in rows)


def test_paged_documents(spark):
    df = spark.createDataFrame([(1, 1, "ab"), (1, 2, ""), (1, 3, "cde")], "s long, page int, text string")
    doc = chunking.paged_documents(df, "s", "page", "text").first()
    assert doc.text == "ab\n\n\n\ncde"
    assert [tuple(x) for x in doc.spans] == [(1, 0, 2), (2, 4, 4), (3, 6, 9)]
    assert [(r.char_start, r.char_end) for r in chunking.page_spans(df, "s", "page", "text").orderBy("page").collect()] == [(0, 2), (4, 4), (6, 9)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("---\ntags: [a]\n---\n\n# T\nsee [[x]] and [[y|z ]]\n\n", "# T\nsee x and z\n"),
        ("---\r\na: b\r\n---\r\nbody\r\nmore", "body\nmore\n"),
        ("---\nopen", "---\nopen\n"),
        ("---\na\n---", ""),
        ("", ""),
        ("![[e]] [[[[a|b]]]]", "e [[b]]\n"),
    ],
)
def test_canonical_body(spark, text, want):
    assert one(spark, T.canonical_body(F.col("t")), t=text) == want


def test_links_do_not_change_the_hash(spark):
    said = [one(spark, T.content_hash(F.col("t")), t=f"a {x} b") for x in ("term", "[[term]]", "[[slug|term]]", "![[term]]", "other")]
    assert len(set(said[:4])) == 1 and said[4] != said[0]


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ("tags: [a, 'b c', \"d\"]", ["a", "b c", "d"]),
        ("x: 1\ntags:\n  - a\n  - 'b'\ny: 2", ["a", "b"]),
        ("tags: one", ["one"]),
        ("tags: []", []),
        ("other: 1", []),
    ],
)
def test_parse_tags(spark, head, want):
    assert one(spark, T.parse_tags(F.col("t")), t=f"---\n{head}\n---\nbody") == want


def test_aliases_titles_and_slugs(spark):
    assert one(spark, T.parse_aliases(F.col("t")), t="---\naliases: [A b, 'C']\n---\n# T\n") == ["A b", "C"]
    assert one(spark, T.parse_aliases(F.col("t")), t="---\naliases:\n  - A\n  - B c\n---\nx") == ["A", "B c"]
    assert one(spark, T.display_title(F.col("t"), F.lit("my-term")), t="no title") == "my term"
    assert one(spark, T.normalise_key(F.col("t")), t="What is Ablation Study?") == "what-is-ablation-study"
    assert one(spark, T.strip_lead_in(T.normalise_key(F.col("t"))), t="What does RRF mean") == "rrf"
    assert one(spark, T.slugify_title(F.col("t")), t=" Été: 2 Tests! ") == "t-2-tests"
    assert one(spark, T.snippet(F.col("t"), 5), t="ab  cd\nef") == "ab cd…"
    assert one(spark, T.match_expression(F.col("t")), t="A_b c, A_b") == '"a_b" OR "c" OR "a_b"'
    assert one(spark, T.index_tokens(F.col("t")), t="Café straße foo_bar x² 3.14 it's") == ["cafe", "straße", "foo", "bar", "x²", "3", "14", "it", "s"]


def test_paths(spark):
    assert one(spark, T.is_note_path(F.col("p")), p="vault/areas/x.md")
    assert not one(spark, T.is_note_path(F.col("p")), p="vault/glossary/x.md")
    assert one(spark, T.sidecar_path(F.col("p")), p="vault/areas/x.md") == "vault/areas/.x.embed.json"
    assert one(spark, T.source_of_sidecar(T.sidecar_path(F.col("p"), True), ""), p="a/b.pdf") == "a/b.pdf"


def test_managed_block(spark):
    set_ = lambda t, b: one(spark, T.splice_block(F.col("t"), "<a>", "</a>", F.lit(b)), t=t)
    once = set_("x", "new")
    assert once == "x\n\n<a>\nnew\n</a>\n" and set_(once, "new") == once
    assert one(spark, T.remove_block(F.col("t"), "<a>", "</a>"), t=once) == "x\n"
    assert set_("only <a>", "b") is None


def test_embedders(spark):
    v = HashEmbedder().embed(spark.createDataFrame([("alpha",)], "t string"), "t", "v").first().v
    assert len(v) == 768 and abs(sum(x * x for x in v) - 1) < 1e-3
    model = BatchEmbedder("m", lambda ts: [[float(len(t)), 0.0] for t in ts], dim=2)
    assert model.embed(spark.createDataFrame([("a",)], "t string"), "t", "v").first().v == [1.0, 0.0]
    assert one(spark, normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert embedder().name == "test"
    with pytest.raises(KeyError):
        embedder("none")


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(y * y for y in b) ** 0.5
    got = {(r.query_id, r.rank): r.id for r in vectors.nearest(df.withColumnRenamed("id", "query_id"), df, 3).collect()}
    for i, v in rows:
        want = sorted((round(cos(v, w), 6), j) for j, w in rows)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in want]
    lsh = vectors.nearest_lsh(df.withColumnRenamed("id", "query_id"), df, 3, dim=8, bits=3)
    assert sum(got[r.query_id, r["rank"]] == r.id for r in lsh.collect()) > 0.9 * len(got)


def test_lsh_recall(spark):
    import duckdb

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vectors.nearest(q, v, 5).collect()}
    near = {(r.query_id, r.id) for r in vectors.nearest_lsh(q, v, 5, bits=4, tables=24).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert duckdb


def test_bm25_phrases_and_repeats(spark):
    docs = spark.createDataFrame([(1, "foo bar baz"), (2, "bar foo"), (3, "foo_bar qux"), (4, "none here"), (5, "x y z")], "id long, text string")
    index = lexical.build_index(docs, "id", "text")
    ask = lambda t: {r.id: r.score for r in lexical.bm25(spark.createDataFrame([(0, t)], "query_id long, text string"), index).collect()}
    assert set(ask("foo_bar")) == {1, 3}
    assert ask("qux qux")[3] == pytest.approx(2 * ask("qux")[3], abs=1e-5)
    assert ask("__") == {}


def most_rows(plan):
    """The most rows that a step of an executed plan gave out."""
    made = plan.metrics().get("numOutputRows")
    below = plan.children()
    return max([made.get().value() if made.isDefined() else 0, *(most_rows(below.apply(i)) for i in range(below.size()))])


def test_phrases_that_share_a_word_meet_only_where_they_stand(spark):
    """A frequent word of many phrases is no pair of each place and each phrase."""
    docs = spark.createDataFrame([(1, "the a " * 200), (2, "b the c the b the"), (3, "the"), (4, None)], "id long, text string")
    rows = [(f"the {w}", ["the", w]) for w in "abcdefghijklmnopqrstuvwxyz"] + [("the b the", ["the", "b", "the"]), ("the the", ["the", "the"])]
    phrases = spark.createDataFrame(rows, "phrase string, words array<string>")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = lexical.phrase_hits(phrases, lexical.build_index(docs, "id", "text")).select("phrase", "id", "tf")
        found = {tuple(r) for r in hits.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found == {("the a", 1, 200), ("the b", 2, 1), ("the c", 2, 1), ("the b the", 2, 1)}
    assert most_rows(hits._jdf.queryExecution().executedPlan()) < 2000


def test_passages(spark):
    texts = {("A", 0): "zephyr wind blows", ("A", 1): "second piece of a", ("A", 2): "third piece", ("B", 0): "other words", ("B", 1): "zephyr again here"}
    rows = [(i, s, c, i + 1, t) for i, ((s, c), t) in enumerate(texts.items())]
    chunks = HashEmbedder(64).embed(spark.createDataFrame(rows, "id long, source_file string, chunk_id int, page int, text string"), "text", "vector")
    index = lexical.build_index(chunks, "id", "text")
    ask = HashEmbedder(64).embed(spark.createDataFrame([(0, "second piece of a")], "query_id long, text string"), "text", "vector")
    hits = search.search_passages(ask, chunks, index).orderBy("rank").collect()
    assert (hits[0].source_file, hits[0].chunk_id, hits[0].page) == ("A", 1, 2)
    assert sorted(h.source_file for h in hits) == ["A", "B"]
    assert search.search_passages(ask, chunks, index, mode="all_chunks").count() == 5
    within = search.search_passages(ask, chunks, index, mode="all_chunks", source="B").collect()
    assert {h.source_file for h in within} == {"B"}
    assert search.search_passages(ask, chunks.limit(0), None).count() == 0
    with pytest.raises(ValueError):
        search.search_passages(ask, chunks, index, mode="odd")


def test_passages_within_a_source_have_no_pool(spark):
    rows = [(i, "B" if i % 20 == 7 else "A", i, 1, f"piece {i} of text") for i in range(60)] + [(60, None, 0, 1, "no source")]
    chunks = HashEmbedder(64).embed(spark.createDataFrame(rows, "id long, source_file string, chunk_id int, page int, text string").repartition(3), "text", "vector")
    ask = HashEmbedder(64).embed(spark.createDataFrame([(0, "piece"), (1, "text")], "query_id long, text string"), "text", "vector")
    all_ = {(r.query_id, r.id): (r["rank"], r.distance) for r in vectors.nearest(ask, chunks, 100).collect()}
    mine, theirs = chunks.where("source_file = 'B'"), chunks.where("source_file is distinct from 'B'")
    among = {(r.query_id, r.id): (r["rank"], r.distance) for r in vectors.ranks_among(ask, mine, theirs).collect()}
    assert among == {k: v for k, v in all_.items() if k[1] in (7, 27, 47)} and max(r for r, _ in among.values()) > 20
    within = search.search_passages(ask, chunks, None, mode="all_chunks", source="B").collect()
    want = {(q, i): round(1 / (60 + r), 6) for (q, i), (r, _) in among.items()}
    assert {(h.query_id, h.chunk_id): h.score for h in within} == want
    # Every passage is the base's only one, or the source's only one.
    assert vectors.ranks_among(ask, chunks, chunks.limit(0)).count() == 122 and vectors.ranks_among(ask, chunks.limit(0), chunks).count() == 0


PLANTED = [
    ("projects/p1", ["ai", "agents", "retrieval"]), ("areas/a1", ["ai", "agents", "memory"]), ("resources/r1", ["ai", "ai-agents", "retrieval"]),
    ("resources/r2", ["ai", "ai-agents", "memory"]), ("archive/arc1", ["ai", "leaked_note_title"]),
]


def test_planted_tags(spark):
    notes = spark.createDataFrame(PLANTED, "source_file string, tags array<string>")
    found = sorted((r.kind, r.tag, r.other) for r in tags.hygiene_report(notes).collect())
    assert found == [
        ("format_lint", "leaked_note_title", "underscore"), ("near_miss", "agents", "ai-agents"),
        ("near_universal", "ai", None), ("singleton", "leaked_note_title", "archive/arc1"),
    ]
    changed = tags.apply_mapping(notes, {"ai-agents": "agents"}).collect()
    assert sorted(r.source_file for r in changed) == ["resources/r1", "resources/r2"]
    after = spark.createDataFrame([(r.source_file, r.new) for r in changed], "source_file string, tags array<string>")
    assert tags.apply_mapping(after, {"ai-agents": "agents"}).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("ai-agents", "AI_Agents", True), ("agents", "agent", True), ("memory", "memori", True), ("agents", "ai-agents", True), ("agents", "agents-framework", True), ("retrieval", "retreival", False), ("search", "retrieval", False), ("agents", "ai-agent-tools", False), ("-", "_", True), ("-", "a", False)],
)
def test_near_miss(spark, a, b, want):
    assert one(spark, tags.is_near_miss(F.col("a"), F.col("b")), a=a, b=b) is want
    pairs = tags.near_miss_pairs(spark.createDataFrame([(a,), (b,)], "tag string")).count()
    assert (pairs == 1) is want  # the blocking keys lose nothing


def test_rewrite_tags(spark):
    texts = ["---\ntags: [a, b]\nk: v\n---\nbody", "---\r\ntags:\r\n  - a\r\n  - c\r\n---\r\nx", "---\ntags: a\n---\n", "no tags"]
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").withColumn("tags", T.parse_tags(F.col("text")))
    made = {r.id: r.text for r in tags.rewrite_tags(notes, {"a": "b"}).collect()}
    assert made == {0: "---\ntags: [b]\nk: v\n---\nbody", 1: "---\r\ntags: [b, c]\r\n---\r\nx", 2: "---\ntags: [b]\n---\n"}
    gone = tags.rewrite_tags(notes, {"a": ""}).orderBy("id").collect()
    assert gone[2].text == "---\ntags: []\n---\n"


def test_mapping_files():
    assert tags.parse_mapping("a -> b # why\n\nc: d\ne = f\ng ->") == {"a": "b", "c": "d", "e": "f", "g": ""}
    assert tags.parse_mapping('{"a": "b"}') == {"a": "b"}
    for bad in ("word", "-> b"):
        with pytest.raises(ValueError):
            tags.parse_mapping(bad)


def test_links_in_bodies():
    terms = [("rrf", "RRF"), ("rank", "rank")]
    body, done = glossary.link_terms_in("rrf and Rank, [[x|rank]] rank", terms)
    assert body == "[[rrf]] and [[rank|Rank]], [[x|rank]] rank" and done == ["rrf", "rank"]
    assert glossary.link_terms_in(body, terms) == (body, [])
    assert glossary.link_terms_in("ranking [[x|rank]] rankings", terms) == ("ranking [[x|rank]] rankings", [])
    assert glossary.link_terms_in("a the of b", [("o", "of"), ("t", "the of"), ("u", "the")]) == ("a [[u|the]] [[o|of]] b", ["o", "u"])


def test_long_frontmatter(spark):
    """Heads of many lines, closed or not, do not exhaust the engine's stack."""
    n = 200_000
    lines = "k: v\n" * n
    block = "---\ntags:\n" + "  - a\n" * n + "---\nbody"
    texts = [f"---\n{lines}---\nbody\n", f"---\n{lines}body", block, f"---\n{lines}tags: [x]\r\n---\r\nbody", "---\n---\nbody", "---\nk\n---"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in df.select("id", T.strip_frontmatter(F.col("text")).alias("s"), T.canonical_body(F.col("text")).alias("c"), T.parse_tags(F.col("text")).alias("t"), T.frontmatter_parts(F.col("text")).alias("p"), graph.apply_links(F.col("text"), F.array(F.lit("n"))).alias("l")).collect()}
    assert [got[i].s for i in range(6)] == ["body\n", texts[1], "body", "body", "body", ""] and got[1].c == texts[1] + "\n"
    assert len(got[2].t) == n and got[3].t == ["x"] and got[1].t == []
    for i, t in enumerate(texts):
        p = got[i].p
        assert "".join(x or "" for x in p) == t and (p.open is None) == (i == 1)
    assert got[0].l.endswith("---\nbody\n") and got[0].l.count("related_auto:") == 1 and got[1].l.startswith("---\n") and got[4].l.endswith("---\nbody")


def test_glossary(spark):
    terms = spark.createDataFrame([("ablation-study", "Ablation Study", ["abl"]), ("b", "B", ["Abl"]), ("rrf", "Reciprocal Rank Fusion", None)], "slug string, display string, aliases array<string>")
    keys = glossary.key_index(terms)
    assert {(r.key, r.slug) for r in keys.collect()} == {("ablation-study", "ablation-study"), ("abl", "ablation-study"), ("b", "b"), ("rrf", "rrf")}
    asked = spark.createDataFrame([("What is RRF?",), ("ablation",), ("zzz",)], "term string")
    assert {r.term: r.slug for r in glossary.lookup(asked, keys).collect()} == {"What is RRF?": "rrf", "ablation": None, "zzz": None}
    near = glossary.suggest(spark.createDataFrame([("ablation studi",)], "term string"), keys).orderBy("rank").collect()
    assert near[0].display == "Ablation Study"


def test_graph(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<double>")
    edges = graph.neighbors(v, 1)
    assert {(r.src, r.dst) for r in graph.select_links(edges).collect()} == {(1, 2), (2, 1)}
    assert {(r.src, r.dst) for r in graph.select_links(edges, 2.0, mutual=False).collect()} == {(1, 2), (2, 1), (3, 2)}
    names = F.array(F.lit("a"), F.lit("b"))
    for text in ("---\ntags: [x]\n---\nbody", "plain\n"):
        once = one(spark, graph.apply_links(F.col("t"), names), t=text)
        assert one(spark, graph.apply_links(F.col("t"), names), t=once) == once and '"[[a]]"' in once
    assert one(spark, graph.apply_links(F.col("t"), F.array().cast("array<string>")), t="plain") == "plain"


def test_changes(spark):
    feed = spark.createDataFrame([("A", "a", None, 1), ("M", "a", None, 2), ("R100", "a", "b", 3), ("D", "c", None, 4), ("A", "c", None, 5)], "status string, path string, new_path string, seq long")
    assert {(r.path, r.op) for r in changes.net_changes(feed).collect()} == {("a", "delete"), ("b", "upsert"), ("c", "upsert")}


def test_audit_without_an_index(spark):
    notes = spark.createDataFrame([("n1", "h"), ("n2", "h")], "source_file string, content_hash string")
    side = spark.createDataFrame([("n1", "test", "h", 4), ("gone", "test", "h", 4)], "source_file string, backend string, content_hash string, dim int")
    found = audit.layer_findings(notes, side, None, "test", 4)
    assert {(r.kind, r.source_file) for r in found.collect()} == {("notes_wo_sidecar", "n2"), ("orphan_sidecars", "gone"), ("missing_from_db", "n1"), ("db_missing", None)}
    assert {r.kind: r.n for r in audit.verdict(found).collect()} == {"notes_wo_sidecar": 1, "orphan_sidecars": 1, "db_missing": 1}
    chunked = spark.createDataFrame([("a.pdf", "test", "h", [4, 3]), ("b.pdf", "old", "x", [4])], "source_file string, backend string, content_hash string, dims array<int>")
    sources = spark.createDataFrame([("a.pdf", None), ("b.pdf", "y")], "source_file string, content_hash string")
    got = {(r.kind, r.source_file) for r in audit.chunked_findings(sources, chunked, None, "test", 4).collect()}
    assert got == {("bad_dim", "a.pdf"), ("unverifiable", "a.pdf"), ("mixed", "b.pdf"), ("stale", "b.pdf")}


def test_change_gate(spark):
    now = spark.createDataFrame([("a", "h1"), ("b", "h2")], "s string, h string")
    stored = spark.createDataFrame([("a", "h1"), ("b", "h0")], "s string, h string")
    assert [r.s for r in audit.change_gate(now, stored, ["s", "h"]).collect()] == ["b"]
    assert audit.change_gate(now, stored, ["s", "h"], force=True).count() == 2


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("rrf_k = 10\nhybrid = false\nchunk_tokens = true\n")
    s = settings.load(str(tmp_path / "c.toml"), {"CORPUSLOOM_RRF_K": "7", "CORPUSLOOM_POOL": "x"})
    assert (s.rrf_k, s.hybrid, s.pool, s.chunk_tokens) == (7, False, 20, 512)
    assert settings.load("/nowhere", {}) == settings.Settings()


def test_unlinked_terms_meet_on_words(spark):
    notes = spark.createDataFrame([(1, "C++ and İstanbul; a straße (STRASSE), ++ x"), (2, "no [[c++]] links, c++"), (3, None)], "source_file long, body string")
    terms = spark.createDataFrame([("cpp", "c++"), ("plus", "++"), ("ist", "istanbul"), ("str", "STRAẞE"), ("none", ""), ("x", "++ X"), ("part", "strass")], "slug string, surface string")
    got = sorted(map(tuple, glossary.unlinked_report(notes, terms).collect()))
    # Each phrase on its own, as a whole word, in any case; a linked surface is none.
    assert got == [(1, "cpp"), (1, "ist"), (1, "plus"), (1, "str"), (1, "x")]


def test_line_guard_skips(spark):
    rows = spark.createDataFrame([("a/b.md", "x\n\ny"), ("README.md", "x\ny"), ("a/tasks/c.md", "x\ny"), ("d.txt", "x\ny")], "source_file string, text string")
    assert [r.source_file for r in audit.long_documents(rows, limit=1, path="source_file").collect()] == ["a/b.md"]


def test_hygiene_as_json(spark):
    import json

    notes = spark.createDataFrame([("a", ["x", "y_z"]), ("b", ["x", "w"]), ("c", ["x", "w2"])], "source_file string, tags array<string>")
    got = {(r.kind, r.json) for r in tags.hygiene_json(tags.hygiene_report(notes)).collect()}
    assert ("near_universal", json.dumps({"tag": "x", "fraction": 1.0}, separators=(",", ":"))) in got
    assert ("singleton", '{"tag":"y_z","note":"a"}') in got and ("near_miss", '["w","w2"]') in got and ("format_lint", '{"tag":"y_z","reason":"underscore"}') in got


def test_tokens_of_other_alphabets(spark):
    """Letters fold to their base as accents are stripped; marks that stand by themselves go."""
    import duckdb

    texts = ["Příliš žluťoučký kůň úpěl ďábelské ódy", "Zażółć gęślą jaźń ŁÓDŹ", "İstanbul ığdır ŞİŞLİ çağ", "Őrült űr ŐŰ", "e\u0301te\u0301 na\u0308iv", "straße œuvre Æsir", "Ελλάδα ΐ", "й Ёлка", "한국어 学習", "plain ASCII_text 42"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.t for r in df.select("id", T.index_tokens(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(texts):
        want = duckdb.execute(r"SELECT regexp_extract_all(lower(strip_accents(?)), '[\p{L}\p{N}\p{Co}]+')", [t]).fetchone()[0]
        assert got[i] == want, t


def test_mapping_files(spark, tmp_path):
    texts = {"a.txt": "a -> b # why\n\nc: d\r\ne = f\ng ->\n  h\t:\ti = j  \n# all said\nx -> y:z\né= è", "b.json": ' {"k": "l", "m": ""}', "c.txt": "a : twice\na = last", "d.txt": ""}
    want = {}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
        want |= tags.parse_mapping(text)
    rows = tags.read_mapping(spark, str(tmp_path)).collect()
    assert {r.old: r.new for r in rows} == want and len(rows) == len(want) == 9
    for i, bad in enumerate(("no arrow", "fine -> x\n -> y", ": z")):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}/m.txt").write_text(bad)
        with pytest.raises(Exception, match="has no"):
            tags.read_mapping(spark, str(tmp_path / f"bad{i}")).collect()


def test_mapping_as_a_table(spark):
    """As the mapping in the plan, for a tag that most notes have, for repeated
    and clashing columns, empty and null tags."""
    notes = [(i, ["hot", f"t{i % 7}", "x"], "old") for i in range(60)]
    notes += [(100, [], "n"), (101, None, "n"), (102, ["gone"], "n"), (103, ["a", "b", "a"], "n"), (104, ["a", ""], "n"), (104, ["a", ""], "n"), (None, ["a"], "n"), (104, ["b"], "n")]
    df = spark.createDataFrame(notes, "source_file long, tags array<string>, old string").repartition(3)
    said = {"hot": "cold", "t1": "t2", "gone": "", "a": "b", "x": "x", "unused": "u"}
    mapping = spark.createDataFrame(list(said.items()), "old string, new string")
    rows = lambda made: sorted((repr((r.source_file, r.old, r.new)) for r in made.distinct().collect()))
    assert rows(tags.map_tags(df, mapping)) == rows(tags.apply_mapping(df, said)) != []
    assert rows(tags.map_tags(df, mapping.limit(0))) == rows(tags.apply_mapping(df, {}))
    assert tags.map_tags(df.limit(0), mapping).count() == 0
    texts = df.withColumn("text", F.concat(F.lit("---\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\nbody")))
    got = {(r.source_file, r.text) for r in tags.rewrite_tags_by(texts, mapping).collect()}
    assert got == {(r.source_file, r.text) for r in tags.rewrite_tags(texts, said).collect()}
