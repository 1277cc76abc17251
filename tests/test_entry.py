"""The entry points, with and without the parts that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_exact' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["knn_graph_neighbors", "bm25_topk", "rrf_hybrid_search", "chunk_offsets", "chunk_page_asof", "canonical_body", "parse_tags", "tag_near_miss", "tag_apply_mapping", "glossary_lookup", "layer_audit", "incremental_apply", "stream_apply_equals_batch", "knn_graph_mutual_links", "tag_singletons", "passage_fetch", "layer_verdict", "repair_plan", "knn_calibration", "tag_hygiene_lines", "glossary_listing", "glossary_unlinked", "notes_under_root", "ingest_summary", "long_documents", "knn_indexed", "knn_graph_indexed", "knn_probed_recall", "bm25_unindexed", "bm25_within_source", "passage_best_per_source", "passage_within_document", "staged_notes", "stream_scoped_state", "note_sidecar_files", "chunk_sidecar_files", "link_pass_patches", "frontmatter_splits", "linked_forms", "hit_lines", "paged_repair", "intake_check", "passage_index_upkeep", "new_terms", "tag_hygiene_report", "vault_seeded_notes", "vault_wiped", "intake_moved", "term_files", "note_index_upkeep", "tag_rewrite", "composed_notes", "bm25_phrases", "tag_mapping_files", "tag_rewrite_by_table", "tag_hygiene_json", "link_invariance", "inbox_listing", "sidecar_states"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__

    got = __spark_entry__.queries()[name](spark, SF)
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(want) > 0  # two empty results would say nothing
    clean = lambda v: round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, tuple) else v
    key = lambda rows: sorted(repr([clean(v) for v in r]) for r in rows)
    assert key(got.select(columns).collect()) == key(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())


def test_keys_of_whole_texts(spark):
    test_queries_equal_their_sql(spark, "normalize_keys")
    from corpusloom.plans import queries as Q

    rows = Q.QUERIES["normalize_keys"](spark, SF).collect()
    assert max(len(r.tag) for r in rows) > 30 and max(len(r.bare) for r in rows) > 30


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from corpusloom.operators import lexical, tags
    from corpusloom.plans import queries as Q

    text = plan(Q.QUERIES["tag_near_miss"](spark, SF))
    assert "Nested" not in text and "Cartesian" not in text
    near = plan(Q.QUERIES["knn_exact"](spark, SF))
    assert "Nested" not in near and "Cartesian" not in near and "BroadcastHashJoin" not in near
    indexed = plan(Q.QUERIES["bm25_topk"](spark, SF))
    assert "documents.parquet" not in indexed  # the texts are not read again
    scores = lexical.bm25(Q.benchmark_queries(spark, SF, False), Q.document_index(spark, SF))
    ranked = plan(lexical.ranked(scores, 20))
    assert "WindowGroupLimit" in ranked and "BatchEvalPython" not in ranked
    assert "TakeOrderedAndProject" in plan(Q.QUERIES["source_listing_paged"](spark, SF))
    assert "ReadSchema: struct<text:string>" in plan(Q.table(spark, SF, "documents").select(Q.T.snippet(Q.F.col("text")).alias("s")))
    assert tags
