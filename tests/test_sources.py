"""Readers, versions, and the stream against the batch."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import changes
from corpusloom.sources import notes as N
from corpusloom.sources import sidecars
from corpusloom.sources.index import VersionedTable
from corpusloom.sources.shared import shared_folder
from corpusloom.sources.sidecar_files import SidecarReader
from corpusloom.streaming.apply import apply_batch, read_feed
from corpusloom.streaming.staged import follow, with_state_store


@pytest.fixture
def vault(tmp_path):
    for path, text in {
        "areas/deep/a b.md": "---\ntags: [x, y]\n---\n# A\n", "projects/p.md": "plain", "templates/t.md": "no", "areas/n.txt": "no",
        "glossary/rrf.md": "---\naliases: [fusion]\n---\n\n# Rank Fusion\n", "glossary/README.md": "no", "glossary/_t.md": "no",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "areas/.a.embed.json").write_text(json.dumps({"source_file": "a", "type": "test", "content_hash": "h", "vector": [0.5]}))
    (tmp_path / "areas/.b.pdf.embed.json").write_text(json.dumps({"source_file": "b", "type": "test", "chunks": [{"chunk_id": 0, "text": "t", "vector": [1.0]}]}))
    (tmp_path / "areas/.c.embed.json").write_text("{broken")
    return tmp_path


def test_notes(spark, vault):
    got = {r.source_file: (r.root, r.stem, r.tags) for r in N.read_notes(spark, str(vault)).collect()}
    assert got == {"areas/deep/a b.md": ("areas", "a b", ["x", "y"]), "projects/p.md": ("projects", "p", [])}
    assert N.note_at(N.read_notes(spark, str(vault)), "projects/../projects/p.md").count() == 1
    with pytest.raises(ValueError):
        N.note_at(N.read_notes(spark, str(vault)), "../secret.md")
    assert N.read_notes(spark, str(vault / "nothing")).count() == 0


def test_sidecars(spark, vault):
    assert {r.sidecar: r.doc_kind for r in N.read_sidecars(spark, str(vault / "areas")).collect()} == {".a.embed.json": "note", ".b.pdf.embed.json": "chunked", ".c.embed.json": "unreadable"}


def test_glossary(spark, vault):
    assert [(r.slug, r.display, r.aliases) for r in N.read_glossary(spark, str(vault / "glossary")).collect()] == [("rrf", "Rank Fusion", ["fusion"])]


def test_listing(spark, tmp_path):
    for n in ("B.pdf", "a.pdf", "c.txt"):
        (tmp_path / n).write_text("x")
    names = lambda **k: [r.name for r in N.list_files(spark, str(tmp_path), newest_first=False, **k).collect()]
    assert names() == ["a.pdf", "B.pdf"] and names(offset=1, limit=1) == ["B.pdf"]
    assert N.inside(str(tmp_path / "a.pdf"), str(tmp_path)) and not N.inside(str(tmp_path / "../x"), str(tmp_path))
    assert N.resolve_folder("in", "/base") == "/base/in"


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.version is None
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = lambda *x: spark.createDataFrame(list(x), "path string, v long")
    first = table.replace(rows(("a", 1), ("b", 1)))
    old = table.read()
    table.upsert(rows(("b", 2), ("c", 2)), "path")
    assert sorted(map(tuple, old.collect())) == [("a", 1), ("b", 1)]  # readers keep their version
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2), ("c", 2)]
    table.upsert(rows(("b", 2), ("c", 2)), "path")
    assert table.read().count() == 3
    table.delete(rows(("a", 0)), "path")
    assert sorted(r.path for r in table.read().collect()) == ["b", "c"]
    table.vacuum()
    assert table.version != first and table.read().count() == 2


def test_batches_in_turn_equal_one(spark, tmp_path):
    feed = [("A", "a", None, 1), ("A", "b", None, 2), ("R", "a", "c", 3), ("D", "b", None, 4), ("M", "c", None, 5), ("A", "b", None, 6)]
    frame = lambda x: spark.createDataFrame(x, "status string, path string, new_path string, seq long")
    fetch = lambda keys: keys.withColumn("v", F.upper("path"))
    parts, whole = VersionedTable(spark, f"file://{tmp_path}/p"), VersionedTable(spark, f"file://{tmp_path}/w")
    for i in range(0, 6, 2):
        apply_batch(parts, frame(feed[i : i + 2]), fetch)
        apply_batch(parts, frame(feed[i : i + 2]), fetch)  # again: nothing changes
    apply_batch(whole, frame(feed), fetch)
    assert sorted(map(tuple, parts.read().collect())) == sorted(map(tuple, whole.read().collect())) == [("b", "B"), ("c", "C")]


def test_pdf_reader_says_what_it_needs(spark):
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="pypdf"):
            N.read_pdf_pages(spark, "/nowhere")


def test_sidecars_of_folders(spark, vault):
    """A partition for each folder, whatever is below it; others' files are not read."""
    (vault / "areas/deep/.d.embed.json").write_text(json.dumps({"source_file": "d", "vector": [1.0]}))
    (vault / ".top.embed.json").write_text("{}")
    (vault / "areas/x.embed.json").write_text("not hidden")
    rows = N.read_sidecars(spark, str(vault))
    assert sorted(r.sidecar for r in rows.collect()) == [".top.embed.json", "areas/.a.embed.json", "areas/.b.pdf.embed.json", "areas/.c.embed.json", "areas/deep/.d.embed.json"]
    names = {p.path for p in SidecarReader(str(vault)).partitions()}
    assert names == {"", "areas", "projects", "templates", "glossary"}
    assert N.read_sidecars(spark, str(vault / "nothing")).count() == 0


def everything(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_a_write_leaves_all_files_or_none(spark, tmp_path):
    files = lambda bad: spark.range(40).repartition(4).selectExpr("concat('f', id % 3, '/.n', id, '.embed.json') AS path", f"if(id = {bad}, raise_error('stop'), concat('{{', id, '}}')) AS content")
    (tmp_path / "old").mkdir()
    with pytest.raises(Exception, match="stop"):
        sidecars.write_files(files(39), str(tmp_path / "old")).collect()
    assert everything(tmp_path / "old") == []
    with pytest.raises(Exception, match="outside"):
        sidecars.write_files(spark.createDataFrame([("a/.x.embed.json", "1"), ("../.y.embed.json", "2")], "path string, content string"), str(tmp_path / "old"))
    assert everything(tmp_path) == []
    made = sidecars.write_files(files(-1), str(tmp_path / "new")).collect()
    assert len(made) == 40 and everything(tmp_path / "new") == sorted(r.path for r in made)
    sidecars.write_files(spark.createDataFrame([("f0/.n0.embed.json", "again")], "path string, content string"), str(tmp_path / "new"))
    assert (tmp_path / "new/f0/.n0.embed.json").read_text() == "again" and len(everything(tmp_path / "new")) == 40
    with pytest.raises(Exception, match="append"):
        files(-1).write.format("sidecars").mode("overwrite").save(str(tmp_path / "new"))


def test_scoped_stream_takes_late_and_repeated_commits(spark, tmp_path):
    own = with_state_store(spark)
    at = lambda name, root="areas": f"vault/{root}/{name}.md"
    batches = [
        [("A", at("a"), None, 5), ("A", at("b"), None, 6), ("A", at("t", "templates"), None, 7), ("A", "vault/areas/x.txt", None, 8)],
        [("D", at("a"), None, 3), ("A", at("b"), None, 6)],  # late, and again
        [("R090", at("b"), at("c", "projects"), 9), ("R100", at("a"), "elsewhere/a.md", 10)],
        [("M", at("b"), None, 2), ("C100", at("c", "projects"), at("d"), 11), ("A", None, None, 12)],
    ]
    frame = lambda rows: own.createDataFrame(rows, "status string, path string, new_path string, seq long")
    table, seen = VersionedTable(own, f"file://{tmp_path}/t"), []
    fetch = lambda keys: keys.withColumn("v", F.upper("path"))
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        follow(read_feed(own, f"{tmp_path}/feed", 1), table, fetch, f"{tmp_path}/progress").awaitTermination()
        seen.append(sorted(r.path for r in table.read().collect()))
    assert seen == [[at("a"), at("b")], [at("a"), at("b")], [at("c", "projects")], [at("d"), at("c", "projects")]]
    whole = changes.in_scope(frame([r for rows in batches for r in rows])).groupBy("path").agg(F.max_by("op", F.struct("seq", "step")).alias("op"))
    assert sorted(r.path for r in whole.where("op = 'upsert'").collect()) == seen[-1]
    assert sorted(r.path for r in changes.staged_notes(frame(batches[0] + batches[3])).collect()) == [at("a"), at("b"), at("d")]
    with pytest.raises(RuntimeError, match="stateStore"):
        follow(read_feed(spark, f"{tmp_path}/feed"), table, fetch, f"{tmp_path}/other")


def test_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session)


def files_below(folder):
    return {str(f.relative_to(folder)): f.read_text() for f in sorted(folder.rglob("*")) if f.is_file()}


@pytest.fixture
def inbox(tmp_path):
    for path, text in {"in/a.pdf": "one", "in/deep/er/b c.pdf": "zwei ä", "out/areas/old.pdf": "old"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def asked(spark, *rows):
    return spark.createDataFrame(rows, "path string, source string").repartition(2)


def test_files_are_taken_in(spark, inbox):
    from corpusloom.sources import vault as V

    at = lambda name: f"file://{inbox}/{name}"
    rows = asked(spark, ("areas/a.pdf", "a.pdf"), ("areas/b.pdf", "deep/er/b c.pdf"))
    V.take_in(rows, at("in"), at("out"))
    assert len(files_below(inbox / "in")) == 2
    assert files_below(inbox / "out") == {"areas/a.pdf": "one", "areas/b.pdf": "zwei ä", "areas/old.pdf": "old"}
    V.take_in(asked(spark, ("areas/c.pdf", "a.pdf")), at("in"), at("out"), move=True)
    assert list(files_below(inbox / "in")) == ["deep/er/b c.pdf"] and files_below(inbox / "out")["areas/c.pdf"] == "one"
    V.take_in(rows.limit(0), at("in"), at("out"), move=True)
    assert {(r.path, r.size) for r in V.list_vault(spark, at("out")).collect()} == {("areas/a.pdf", 3), ("areas/b.pdf", 7), ("areas/c.pdf", 3), ("areas/old.pdf", 3)}
    assert V.list_vault(spark, at("nothing")).count() == 0


@pytest.mark.parametrize("rows", [
    [("areas/x.pdf", "a.pdf"), ("areas/old.pdf", "deep/er/b c.pdf")],  # a place is taken
    [("areas/x.pdf", "a.pdf"), ("areas/x.pdf", "deep/er/b c.pdf")],  # two files, one place
    [("areas/x.pdf", "a.pdf"), ("areas/y.pdf", "missing.pdf")],
    [("areas/x.pdf", "a.pdf"), ("../y.pdf", "a.pdf")],
])
def test_a_failed_intake_changes_nothing(spark, inbox, rows):
    from corpusloom.sources import vault as V

    before = files_below(inbox)
    with pytest.raises(Exception):  # noqa: B017
        V.take_in(asked(spark, *rows), f"file://{inbox}/in", f"file://{inbox}/out", move=True)
    assert files_below(inbox) == before and not (inbox / "out/_drafts").exists()


def test_seed_and_wipe(spark, inbox):
    from corpusloom.sources import vault as V

    kept = {"areas/.gitkeep": "", "areas/x.txt": "x", "config/n.md": "c", ".obsidian/areas/n.md": "o", "n.md": "top"}
    for path, text in (kept | {"areas/n.md": "n", "areas/a/b/c/.n.embed.json": "{}", "projects/p q.md": "p"}).items():
        (inbox / "seeds" / path).parent.mkdir(parents=True, exist_ok=True)
        (inbox / "seeds" / path).write_text(text)
    base = f"file://{inbox}/v"
    (inbox / "v/areas").mkdir(parents=True)
    (inbox / "v/areas/n.md").write_text("edited")
    for _ in range(2):
        V.seed(spark, f"file://{inbox}/seeds", base)
        assert files_below(inbox / "v") == files_below(inbox / "seeds")
    gone = {"areas/n.md", "areas/a/b/c/.n.embed.json", "projects/p q.md"}
    assert {r.path for r in V.wipe(spark, base).collect()} == gone and files_below(inbox / "v") == files_below(inbox / "seeds")
    assert {r.path for r in V.wipe(spark, base, force=True).collect()} == gone
    assert files_below(inbox / "v") == kept and (inbox / "v/areas/a/b/c").is_dir()
    assert V.wipe(spark, base, force=True).count() == 0


def test_files_of_a_vault_pass_the_driver_neither_way(spark, vault, tmp_path):
    """Notes and terms are listed and read by tasks, hidden ones left out as
    Spark's readers do, and a write returns nothing of its files."""
    from corpusloom.sources import sidecar_files as S

    for path in ("areas/_draft.md", "areas/.hidden.md", "areas/_folder/n.md", "areas/_k=v/n.md", "areas/x.md"):
        (vault / path).parent.mkdir(exist_ok=True)
        (vault / path).write_text("# n")
    before = {r.source_file for r in N.read_notes(spark, str(vault)).collect()}
    assert {"areas/_k=v/n.md", "areas/x.md"} <= before and not before & {"areas/_draft.md", "areas/.hidden.md", "areas/_folder/n.md"}
    for rows in (N.read_notes(spark, str(vault)), N.read_glossary(spark, str(vault / "glossary"))):
        assert "FileScan" not in rows._jdf.queryExecution().executedPlan().toString()
    assert N.read_notes(spark, str(vault), ()).count() == 0
    made = S.bring_in(spark.range(9).selectExpr("concat('a/', id) AS path"), str(tmp_path / "out"), lambda out, row: out.write(b"x"))
    assert sorted(r.path for r in made.collect()) == [f"a/{i}" for i in range(9)] == everything(tmp_path / "out")
    S.register(spark)
    with pytest.raises(Exception, match="write_files"):
        made.selectExpr("path AS sidecar", "path AS json").write.format("sidecars").mode("append").save(str(tmp_path / "out"))
