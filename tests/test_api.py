"""The composed entry points, from notes to hits."""

import pytest
from pyspark.sql import functions as F

from corpusloom import api
from corpusloom.functions.embedding import HashEmbedder
from corpusloom.settings import Settings

SMALL = HashEmbedder(32)
NOTES = [("areas/a.md", "---\ntags: [zephyr]\n---\n# A\nwind"), ("areas/b.md", "# B\nother words"), ("projects/c.md", "# C\nzephyr again")]


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, "source_file string, text string")


def test_gate(spark, notes):
    first = api.embed_notes(notes, embedder=SMALL)
    assert first.count() == 3 and api.embed_notes(notes, first, SMALL).count() == 0
    linked = notes.withColumn("text", F.replace("text", F.lit("wind"), F.lit("[[wind]]")))
    assert api.embed_notes(linked, first, SMALL).count() == 0  # links are no change
    edited = notes.withColumn("text", F.concat("text", F.lit("!")))
    assert api.embed_notes(edited, first, SMALL).count() == 3
    assert api.embed_notes(notes, first, SMALL, force=True).count() == 3


def test_index(spark, notes, tmp_path):
    index = api.NoteIndex(spark, f"file://{tmp_path}/i")
    index.build(notes, api.embed_notes(notes, embedder=SMALL), dim=32)
    with pytest.raises(ValueError):
        index.build(notes, api.embed_notes(notes, embedder=SMALL), dim=768)
    ask = spark.createDataFrame([(1, "zephyr")], "query_id long, text string")
    hits = index.search(ask, Settings(k=3), SMALL).orderBy("rank").collect()
    assert {h.source_file for h in hits[:2]} == {"areas/a.md", "projects/c.md"} and len(hits) == 3
    feed = spark.createDataFrame([("D", "areas/a.md", None, 1), ("R", "areas/b.md", "areas/d.md", 2)], "status string, path string, new_path string, seq long")
    index.apply(feed, notes.where("source_file = 'areas/b.md'").withColumn("source_file", F.lit("areas/d.md")), SMALL)
    assert sorted(r.source_file for r in index.vectors.read().collect()) == ["areas/d.md", "projects/c.md"]
    assert [h.source_file for h in index.search(ask, Settings(k=1), SMALL).collect()] == ["projects/c.md"]


def test_a_changed_note_without_text_keeps_its_vector(spark, tmp_path):
    notes = spark.createDataFrame([("areas/a.md", "zephyr wind"), ("areas/b.md", "other words"), ("areas/c.md", "third note")], "source_file string, text string")
    index = api.NoteIndex(spark, f"file://{tmp_path}/i")
    index.build(notes, api.embed_notes(notes, embedder=SMALL), dim=32)
    feed = spark.createDataFrame([("M", "areas/a.md", None, 1), ("M", "areas/b.md", None, 2), ("D", "areas/c.md", None, 3)], "status string, path string, new_path string, seq long")
    index.apply(feed, notes.where("source_file = 'areas/b.md'").withColumn("text", F.lit("changed")), SMALL)
    names = lambda table: sorted(r.source_file for r in table.read().collect())
    assert names(index.vectors) == ["areas/a.md", "areas/b.md"] and names(index.bodies) == ["areas/b.md"]


def test_paged_sources(spark):
    pages = spark.createDataFrame([("x.pdf", 1, "alpha beta gamma delta"), ("x.pdf", 2, "epsilon zeta eta theta")], "source_file string, page int, text string")
    s = Settings(chunk_tokens=4, chunk_overlap=0.0)
    rows = api.ingest_paged_source(pages, settings=s, embedder=SMALL)
    assert [(r.chunk_id, r.page) for r in rows.orderBy("chunk_id").collect()] == [(0, 1), (1, 2)]
    assert api.ingest_paged_source(pages, rows, s, SMALL).count() == 0
    assert api.ingest_paged_source(pages, rows, Settings(chunk_tokens=2, chunk_overlap=0.0), SMALL).count() == 4


def hits_of(index, ask, **how):
    return [(h.source_file, h.chunk_id, h.page) for h in index.search(ask, Settings(k=5), SMALL, **how).orderBy("rank").collect()]


def test_passage_index(spark, tmp_path):
    index = api.PassageIndex(spark, f"file://{tmp_path}/p")
    ask = spark.createDataFrame([(1, "zeta")], "query_id long, text string")
    assert hits_of(index, ask) == [] and tuple(index.stats().first()) == (0, 0)
    frame = lambda *rows: spark.createDataFrame(list(rows), "source_file string, page int, text string")
    s = Settings(chunk_tokens=4, chunk_overlap=0.0)
    pages = frame(("x.pdf", 1, "alpha beta gamma delta"), ("x.pdf", 2, "epsilon zeta eta theta"), ("y.pdf", 1, "iota kappa"), ("z.pdf", 1, ""))
    rows = api.ingest_paged_source(pages, settings=s, embedder=SMALL)
    with pytest.raises(ValueError):
        index.load(rows)
    index.load(rows, dim=32)
    assert sorted(map(tuple, api.ingest_summary(pages, rows).collect())) == [("x.pdf", 2, 2), ("y.pdf", 1, 1), ("z.pdf", 1, 0)]
    assert sorted(r[0] for r in index.sources().collect()) == ["x.pdf", "y.pdf"] and index.stats().first().n_chunks == 3
    assert hits_of(index, ask)[0] == ("x.pdf", 1, 2) and {h[0] for h in hits_of(index, ask)} == {"x.pdf", "y.pdf"}
    assert hits_of(index, ask, source="y.pdf") == [("y.pdf", 0, 1)]
    assert [r.text for r in index.fetch("x.pdf", 0).collect()] == ["alpha beta gamma delta"]
    top = index.stats().first().max_id
    index.update(api.ingest_paged_source(frame(("y.pdf", 1, "zeta zeta zeta")), settings=s, embedder=SMALL), dim=32)
    assert index.stats().first().n_chunks == 3 and index.stats().first().max_id > top
    whole = api.PassageIndex(spark, f"file://{tmp_path}/w")
    whole.load(index.read().drop("id"), dim=32)
    assert hits_of(index, ask) == hits_of(whole, ask) and ("y.pdf", 0, 1) in hits_of(index, ask, mode="all_chunks")
    index.remove(spark.createDataFrame([("x.pdf",)], "source_file string"))
    assert hits_of(index, ask) == [("y.pdf", 0, 1)]
    index.clear()
    assert hits_of(index, ask) == [] and index.stats().first().n_chunks == 0


def test_applied_index_equals_a_new_one(spark, tmp_path):
    notes = spark.createDataFrame([*NOTES, ("areas/e.md", "zephyr zephyr e")], "source_file string, text string")
    index, again = (api.NoteIndex(spark, f"file://{tmp_path}/{n}") for n in "iw")
    index.build(notes, api.embed_notes(notes, embedder=SMALL), dim=32)
    feed = spark.createDataFrame([("D", "areas/e.md", None, 1), ("M", "areas/b.md", None, 2), ("A", "areas/n.md", None, 3)], "status string, path string, new_path string, seq long")
    now = spark.createDataFrame([NOTES[0], ("areas/b.md", "zephyr_again zephyr"), NOTES[2], ("areas/n.md", "new zephyr note")], "source_file string, text string")
    index.apply(feed, now, SMALL)
    again.build(now, api.embed_notes(now, embedder=SMALL), dim=32)
    parts_of = lambda i: api.stored_postings(i.table).plain
    rows = lambda i, part, *c: sorted(map(tuple, getattr(parts_of(i), part).join(i.table.read("keys"), "id").select("source_file", *c).collect()))
    key = lambda i: i.table.read("keys").withColumnRenamed("source_file", "s")
    for part, columns in (("postings", ("term", "tf")), ("lengths", ("dl",)), ("tokens", ("term", "pos"))):
        assert rows(index, part, *columns) == rows(again, part, *columns)
    assert key(index).select("id").distinct().count() == key(index).count()
    # The stored blocks and cells hold what the terms and vectors do.
    held = lambda i: i.table.read("postings").where("term is not null").groupBy("term").agg(F.sum(F.size("places"))).orderBy("term").collect()
    assert held(index) == held(again)
    assert api.stored_cells(index.table).cells.select(F.explode("ids").alias("id")).orderBy("id").collect() == index.vectors.read().select("id").orderBy("id").collect()
    ask = spark.createDataFrame([(1, "zephyr"), (2, "again")], "query_id long, text string")
    hits = lambda i: {(h.query_id, h.source_file, h.score) for h in i.search(ask, Settings(k=5), SMALL).collect()}
    assert {h[:2] for h in hits(index)} == {h[:2] for h in hits(again)}
    assert all(h[2] == round(h[2], 4) for h in hits(index))


def test_a_version_of_a_slower_writer_is_refused(spark, tmp_path):
    from corpusloom.sources.index import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/t")
    slow = table.draft()
    slow.put("a", spark.range(1))
    table.replace(spark.range(2))
    with pytest.raises(RuntimeError):
        slow.commit()
    assert table.read().count() == 2


def test_sidecar_files(spark, tmp_path):
    import json

    from corpusloom.sources import sidecars

    notes = spark.createDataFrame([("areas/a.md", "é wind")], "source_file string, text string")
    rows = api.embed_notes(notes, embedder=SMALL)
    made = sidecars.write_files(sidecars.note_sidecars(rows), f"file://{tmp_path}").collect()
    (kept,) = rows.collect()
    text = (tmp_path / "areas/.a.embed.json").read_text()
    assert [m.path for m in made] == ["areas/.a.embed.json"] and made[0].n_bytes == len(text)
    assert text == json.dumps({"source_file": "areas/a.md", "type": kept.backend, "content_hash": kept.content_hash, "vector": kept.vector}, indent=2) + "\n"
    pages = spark.createDataFrame([("in/x.pdf", 1, "alpha beta gamma"), ("in/x.pdf", 2, "delta")], "source_file string, page int, text string")
    chunks = api.ingest_paged_source(pages, settings=Settings(chunk_tokens=2, chunk_overlap=0.0), embedder=SMALL)
    (file,) = sidecars.chunk_sidecars(chunks).collect()
    payload = json.loads(file.content)
    assert file.path == "in/.x.pdf.embed.json" and list(payload) == ["source_file", "type", "content_hash", "chunking", "chunks"]
    assert payload["chunking"] == {"chunk_tokens": 2, "chunk_overlap": 0.0}
    assert [(c["chunk_id"], c["page"], c["text"], len(c["vector"])) for c in payload["chunks"]] == [(0, 1, "alpha beta", 32), (1, 1, "gamma\n\ndelta", 32)]


def test_links(spark):
    notes = spark.createDataFrame([("a.md", "---\ntags: [x]\n---\nbody"), ("b.md", "plain"), ("c.md", "far")], "source_file string, text string")
    vectors = spark.createDataFrame([("a.md", [1.0, 0.0]), ("b.md", [0.9, 0.1]), ("c.md", [-1.0, 0.2])], "source_file string, vector array<double>")
    made = {r.source_file: r.new_text for r in api.link_notes(notes, vectors).collect()}
    assert set(made) == {"a.md", "b.md"} and '"[[b]]"' in made["a.md"]
    again = spark.createDataFrame(list(made.items()), "source_file string, text string")
    assert api.link_notes(again, vectors).count() == 0


def test_new_terms_and_notes(spark, notes):
    terms = spark.createDataFrame([("rank-fusion", "Rank Fusion", ["RRF"])], "slug string, display string, aliases array<string>")
    asked = spark.createDataFrame([("rrf",), ("Rank Fusions",), ("zzz",)], "term string")
    got = {r.term: (r.taken_by, r.near) for r in api.check_term(asked, terms).collect()}
    assert got == {"rrf": ("Rank Fusion", ["Rank Fusion"]), "Rank Fusions": (None, ["Rank Fusion"]), "zzz": (None, [])}
    new = spark.createDataFrame([("A", "text", ["agents"]), ("New One", "text", ["ok"])], "title string, body string, tags array<string>")
    vocabulary = spark.createDataFrame([("agent",), ("ok",)], "tag string")
    rows = {r.title: r for r in api.compose_notes(new, notes, vocabulary).collect()}
    assert rows["A"].exists and rows["A"].hints == ["agents ~ agent"]
    assert not rows["New One"].exists and rows["New One"].hints == [] and rows["New One"].text == "---\ntags: [ok]\n---\n\n# New One\n\ntext\n"


def test_terms_are_added_and_linked(spark):
    terms = spark.createDataFrame([("rank-fusion", "Rank Fusion", ["fusion"])], "slug string, display string, aliases array<string>")
    asked = [("Ablation Study", " What is left out. ", ["ablations"]), ("Fusion!", "x", None), ("ablations", "again", []), ("?!", "x", None), ("Rank fusions", None, None)]
    notes = [("a.md", "---\ntags: [ablations]\n---\nAblations and an ablation study.\n"), ("b.md", "nothing"), ("c.md", "see [[ablation-study]], ablation study"), ("d.md", "fusion, rank fusions"), ("e.md", None)]
    made, linked = api.add_terms(spark.createDataFrame(asked, "term string, definition string, aliases array<string>"), terms, spark.createDataFrame(notes, "source_file string, text string"))
    got = {r.term: r for r in made.collect()}
    assert {t: r.refused for t, r in got.items()} == {"Ablation Study": None, "Fusion!": "fusion is taken by rank-fusion", "ablations": "ablations is asked for twice", "?!": "it has no usable characters", "Rank fusions": None}
    assert got["Ablation Study"].text == "---\ntype: glossary\naliases: [ablations]\ntags: [glossary]\n---\n\n# Ablation Study\n\nAblation Study ? What is left out.\n\n#flashcards/glossary\n"
    assert got["Rank fusions"].near == ["Rank Fusion"] and "A one-line definition" in got["Rank fusions"].text
    # The term is linked before its aliases, and a slug only once.
    assert {r.source_file: r.new_text for r in linked.collect()} == {"a.md": "---\ntags: [ablations]\n---\nAblations and an [[ablation-study|ablation study]].\n", "d.md": "fusion, [[rank-fusions|rank fusions]]"}


def test_files_that_may_come_in(spark):
    asked = spark.createDataFrame([("/in/a.pdf",), ("/in/b.txt",), ("/in/old.PDF",), ("/x/a.pdf",)], "path string")
    there = spark.createDataFrame([("vault/areas/old.PDF",)], "source_file string")
    got = {r.path: (r.source_file, r.refused) for r in api.check_intake(asked, there, "areas").collect()}
    assert got == {"/in/a.pdf": ("vault/areas/a.pdf", None), "/in/b.txt": ("vault/areas/b.txt", "not a .pdf"), "/in/old.PDF": ("vault/areas/old.PDF", "destination exists"), "/x/a.pdf": ("vault/areas/a.pdf", "another file takes this name")}
    with pytest.raises(ValueError):
        api.check_intake(asked, there, "nowhere")


def test_embedder_by_environment_and_file(tmp_path, monkeypatch):
    from corpusloom.functions import embedding

    file = tmp_path / "embedder.toml"
    file.write_text('backend = "model:small"\n')
    assert embedding.backend_name(str(file), {}) == "model:small"
    assert embedding.backend_name(str(file), {"CORPUSLOOM_EMBEDDER": "test"}) == "test"
    assert embedding.backend_name(str(tmp_path / "none"), {}) == "test"
    file.write_text("not toml [")
    assert embedding.backend_name(str(file), {}) == "test"
    file.write_text('backend = "model:small"\n')
    with pytest.raises(KeyError):
        embedding.configured(str(file), {})
    monkeypatch.setitem(embedding.EMBEDDERS, "model:small", SMALL)
    assert embedding.configured(str(file), {}) is SMALL


def test_one_of_two_writers_gets_the_place(spark, tmp_path):
    """Both have passed the check of the manifest; the place is given once."""
    from corpusloom.sources.index import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.replace(spark.range(1))
    one, two = table.draft(), table.draft()
    for draft, n in ((one, 2), (two, 3)):
        draft.put("", spark.range(n))
    assert table.claim(one.base, one.name)
    with pytest.raises(RuntimeError):
        two.commit()
    table.release()  # the first writer died before it was current
    two.commit()
    assert table.read().count() == 3
    table.vacuum()
    table.replace(spark.range(4))
    assert table.read().count() == 4



def test_an_index_embeds_each_text_once(spark, tmp_path):
    """The check of the length, the numbers and the vectors come from one making."""
    from corpusloom.functions.embedding import BatchEmbedder

    seen = tmp_path / "seen"

    def client(texts):
        with open(seen, "a") as file:
            file.write("x" * len(texts))
        return [[1.0, float(len(t))] for t in texts]

    def made():
        n = seen.stat().st_size
        seen.unlink()
        return n

    model = BatchEmbedder("model", client, dim=2)
    notes = spark.createDataFrame([(f"vault/areas/n{i}.md", f"note {i}") for i in range(7)], "source_file string, text string")
    notes_index = api.NoteIndex(spark, f"file://{tmp_path}/notes")
    notes_index.build(notes, api.embed_notes(notes, embedder=model), dim=2)
    assert made() == 7 == notes_index.vectors.read().count()
    pages = spark.createDataFrame([(f"p{i}", 1, f"page {i}") for i in range(5)], "source_file string, page int, text string")
    passages = api.PassageIndex(spark, f"file://{tmp_path}/passages")
    passages.load(api.ingest_paged_source(pages, embedder=model), dim=2)
    assert made() == 5
    passages.update(api.ingest_paged_source(pages.where("source_file < 'p2'"), embedder=model), dim=2)
    assert made() == 2 and passages.read().select("id").distinct().count() == 5
