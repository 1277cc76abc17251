"""Stored indexes against comparing all with all, and what they leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks, cells, graph, lexical, vectors
from corpusloom.sources.index import VersionedTable


@pytest.fixture
def put(spark, tmp_path):
    draft = VersionedTable(spark, f"file://{tmp_path}/index").draft()
    return draft.put


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "distance").collect()))


def clustered(n, dim=12, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return [(i, (centres[i % 20] + spread * rng.standard_normal(dim)).tolist()) for i in range(n)]


def test_cells_give_the_exact_neighbours(spark, put):
    """Clusters, equal vectors, and vectors without direction or value."""
    rows = clustered(600) + [(1000 + i, [1.0] * 12) for i in range(30)] + [(2000, [0.0] * 12), (2001, None), (2002, [float("nan")] * 12)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    index = cells.build(v, put)
    assert index.cells.select(F.sum(F.size("ids"))).first()[0] == 630
    q = v.withColumnRenamed("id", "query_id")
    for how in ({}, {"exclude_self": True}):
        want = rows_of(vectors.nearest(q.where("not isnan(vector[0])"), v.where("not isnan(vector[0])"), 4, **how))
        assert rows_of(index.nearest(q, 4, **how)) == want
    few = index.work(q.where("query_id < 600"), 4).first()
    assert 0 < few.probed < few.stored / 2  # clusters far away are not read
    plan = index.nearest(q, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Nested" not in plan and "Cartesian" not in plan


def test_tuned_probes_reach_the_recall(spark, put):
    v = spark.createDataFrame(clustered(800, spread=0.6, seed=4), "id long, vector array<double>")
    index = cells.build(v, put)
    probes = index.probes_for(v, 5)
    true = {(r.src, r.dst) for r in graph.neighbors(v, 5).collect()}
    found = {(r.src, r.dst) for r in graph.neighbors(v, 5, index, probes).collect()}
    assert probes < index.centroids.count() and len(true & found) >= 0.9 * len(true)


def test_large_cells_are_dealt_to_groups(spark, put, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 8)
    v = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(100)], "id long, vector array<double>")
    index = cells.build(v, put, cells=2)
    assert index.centroids.agg(F.max("groups")).first()[0] > 4
    q = v.withColumnRenamed("id", "query_id")
    assert rows_of(index.nearest(q, 3)) == rows_of(vectors.nearest(q, v, 3))


def test_cells_of_nothing(spark, put):
    v = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    index = cells.build(v, put)
    assert index.nearest(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).count() == 0


WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=2):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 60)))) for i in range(n)]
    return docs + [(n, ""), (n + 1, None), (n + 2, "rare_word w1"), (n + 3, "rare word"), (n + 4, "word rare")]


ASKED = [(1, "w1 w5 w40 w40"), (2, "W0 rare_word"), (3, ""), (4, None), (5, "nowhere w59"), (6, " ".join(WORDS)), (7, "w7")]


@pytest.mark.parametrize("shard", [8192, 50])
def test_blocks_give_the_rows_of_bm25(spark, put, shard):
    docs = spark.createDataFrame(corpus(700), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    index = blocks.build(blocks.listed(docs, "doc_id", "text"), put, shard=shard, block=16)
    for k in (5, None):
        want = lexical.ranked(lexical.bm25(queries, lexical.build_index(docs, "doc_id", "text")), k)
        key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
        assert key(blocks.top(queries, index, k)) == key(want)
    work = blocks.scored(queries, index, 5, work=True).agg(F.sum("scored"), F.sum("blocks")).first()
    assert work[0] < work[1] or shard == 50  # blocks that can't matter are skipped
    assert blocks.top(queries.limit(0), index, 5).count() == 0


def test_skipped_blocks_of_a_clear_query(spark, put):
    """One block has the rare word; behind it nothing can come near."""
    docs = [(i, "common filler words here") for i in range(2000)] + [(i, "needle needle common") for i in range(2000, 2010)]
    index = blocks.build(blocks.listed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text"), put)
    queries = spark.createDataFrame([(1, "needle common")], "query_id long, text string")
    r = blocks.scored(queries, index, 5, work=True).first()
    assert r.scored <= blocks.STEP + 1 < r.blocks and {x.id for x in blocks.top(queries, index, 5).collect()} == {2000, 2001, 2002, 2003, 2004}


def test_texts_are_read_once(spark, put, tmp_path):
    """After the index is stored the texts may go."""
    spark.createDataFrame(corpus(50), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    index = blocks.build(blocks.listed(spark.read.parquet(f"{tmp_path}/docs"), "doc_id", "text"), put)
    plan = blocks.top(spark.createDataFrame(ASKED, "query_id long, text string"), index, 5)._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/docs" not in plan and "BatchEvalPython" not in plan


def test_blocks_keep_the_best_of_all_blocks_and_no_more():
    """Ties, copies, vectors without direction and with themselves, over blocks
    that come one after another: the rows of all distances, given out once a block of queries."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    y = rng.standard_normal((900, 6))
    y[::9], y[3], y[4], y[5, 0] = y[1], 0, np.nan, np.inf
    ids = rng.permutation(900)
    names = ["qids", "qm", "bids", "bm"]
    block = lambda a, b: [pa.array([ids[a:b].tolist()], pa.list_(pa.int64())), pa.array([y[a:b].tobytes()], pa.binary())]
    pairs = [pa.RecordBatch.from_arrays([*block(q, q + 300), *block(b, b + 180)], names) for q in (0, 300, 600) for b in range(0, 900, 180)]
    for k, own in ((4, False), (4, True), (1000, False)):
        with np.errstate(invalid="ignore"):
            d = vectors.distances(y, y)
        if own:
            np.fill_diagonal(d, np.inf)
        order = [sorted(np.flatnonzero(np.isfinite(d[q])).tolist(), key=lambda j: (d[q, j], ids[j]))[:k] for q in range(900)]  # noqa: B023
        want = sorted((int(ids[q]), int(ids[j]), d[q, j] + 0.0) for q in range(900) for j in order[q])
        found = list(vectors.meeting(k, own)(iter(pairs)))
        assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == want
        assert len(found) == 3


def test_a_grid_copies_blocks_as_often_as_the_root_of_the_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [spark.range(40).select(F.col("id").alias(n)) for n in ("a", "b")]
        met = vectors.each_with_each(*rows, "a", "b", 40 * vectors.BLOCK, 40 * vectors.BLOCK)
        assert met.distinct().count() == met.count() == 1600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_query_is_sent_once_to_a_bucket_of_cells():
    """However many cells of a bucket a query visits, its vector travels there once."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    points = rng.standard_normal((200, 4))
    points /= np.linalg.norm(points, axis=1)[:, None]
    known = cells.Centroids(np.arange(200), points, np.full(200, 3.2), np.full(200, 2))
    x = rng.standard_normal((50, 4))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 10)), pa.array(x[i : i + 10].tolist()), pa.nulls(10, pa.float64())], ["query_id", "vector", "bound"]) for i in range(0, 50, 10)]
    visits = [r for b in known.others()(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] for r in visits) == 50 * 199  # all cells but the nearest
    assert sum(len(r["qm"]) for r in visits) <= cells.BUCKETS * x.nbytes and len(visits) == cells.BUCKETS


def test_few_vectors_meet_all_points_at_once():
    """More vectors have more points, so what is held of both at once must not grow with them."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    points, x = rng.standard_normal((40, 4)), rng.standard_normal((1000, 4))
    points /= np.linalg.norm(points, axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(x.tolist())], ["id", "vector"])
    made = list(cells.placing(points)(iter([batch])))
    assert max(b.num_rows for b in made) <= 256
    cosine = (x / np.linalg.norm(x, axis=1)[:, None]) @ points.T
    assert [r["cell"] for b in made for r in b.to_pylist()] == cosine.argmax(axis=1).tolist()
    assert np.allclose([r["cosine"] for b in made for r in b.to_pylist()], cosine.max(axis=1))


def test_the_best_of_each_group_are_those_of_all_scores(spark, put):
    """Groups without name, documents of several groups and of none; only what may count leaves a shard."""
    docs = spark.createDataFrame(corpus(700), "doc_id long, text string").repartition(3)
    index = blocks.build(blocks.listed(docs, "doc_id", "text"), put, shard=200, block=16)
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    ids = docs.select(F.col("doc_id").alias("id"))
    groups = ids.where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("grp")).unionByName(ids.where("id % 7 = 0").withColumn("grp", F.lit("seven")))
    every = {(r.query_id, r.id): r.score for r in blocks.top(queries, index, None).collect()}
    of = {}
    for r in groups.collect():
        for q in {q for q, _ in ASKED}:
            if (q, r.id) in every:
                of.setdefault((q, r.grp), []).append((-every[q, r.id], r.id))
    want = {(q, g, n + 1, i, -s) for (q, g), rows in of.items() for n, (s, i) in enumerate(sorted(rows)[:3])}
    found = blocks.top_within(queries, index, groups, 3)
    assert {tuple(r) for r in found.select("query_id", "grp", "rank", "id", "score").collect()} == want and {g for _, g, *_ in want} > {None, "seven"}
    assert blocks.scored(queries.where("query_id = 6"), index, 3, groups=groups).count() < 100 < sum(q == 6 for q, _ in every)
    assert blocks.top_within(queries, index, groups.limit(0), 3).count() == 0


def test_asked_terms_do_not_move_the_postings(spark, put):
    """The terms asked for go to the postings, of which only theirs are moved; their sizes are stored."""
    index = blocks.build(blocks.listed(spark.createDataFrame(corpus(100), "doc_id long, text string"), "doc_id", "text"), put)
    plan = blocks.scored(spark.createDataFrame(ASKED, "query_id long, text string").where("query_id <> 2"), index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    sizes = index.postings.where("term is not null").select("n", F.size("places").alias("size"))
    assert sizes.where("n <> size").count() == 0 and index.postings.where("term is null").select(F.sum("n")).first()[0] == 105


def test_joined_terms_are_the_tokens(spark):
    texts = ["Café straße foo_bar x² 3.14 it's", "", None, " . ", "a", "Ünï  cödé—Ź", "日本語 テキスト", "x y\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    from corpusloom.functions import text as T

    rows = blocks.listed(df, "id", "t", F.lit("en")).join(df.select("id", T.index_tokens(F.col("t")).alias("want")), "id").collect()
    assert len(rows) == len(texts) and all(r.terms.split(" ") == [*r.want, "en"] for r in rows)
    assert {r.terms for r in blocks.listed(df.where("id in (1, 2, 3)"), "id", "t", "t").collect()} == {""}


def test_a_text_is_hashed_once(monkeypatch):
    """However many values a vector has; they are those of whole texts with a counter behind, and the rounding is SQL's."""
    import hashlib
    from types import SimpleNamespace

    from corpusloom.functions import embedding

    made = []
    monkeypatch.setattr(embedding, "hashlib", SimpleNamespace(sha256=lambda text: made.append(text) or hashlib.sha256(text)))
    texts = [b"", "Größe".encode(), b"x" * 1000]
    got = embedding.hash_values(texts, 20)
    assert made == texts
    for text, values in zip(texts, got.tolist()):
        words = b"".join(hashlib.sha256(text + c.to_bytes(4, "big")).digest() for c in range(3))
        assert values == [int.from_bytes(words[i : i + 4], "big") / 2**32 * 2 - 1 for i in range(0, 80, 4)]
    halves = np.array([0.0000005, -0.0000005, 0.1234565, 0.1234575, 0.0000004999, -0.0000001, 0.25])
    assert embedding.rounded(halves).tolist() == [0.000001, -0.000001, 0.123457, 0.123458, 0.0, 0.0, 0.25]


def test_spans_and_words_by_tables(spark):
    import re

    from corpusloom.functions import text as T
    from corpusloom.operators import chunking

    rng = random.Random(3)
    texts = ["".join(rng.choices("aé \n\t\u00a0\u2003\u3000\u3001\x1c\x85😀_.", k=rng.randrange(60))) for _ in range(200)] + ["".join(map(chr, range(256)))]
    for t in texts:
        words = [m.span() for m in re.finditer(r"\S+", t)]
        want = [words[at : at + 3] for at in range(0, max(len(words) - 1, 1), 2)] if words else []
        assert chunking.chunk_spans(t, 3, 0.25) == [(w[0][0], w[-1][1]) for w in want]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.index_words(F.col("t")).alias("words"), F.array_join(T.index_tokens(F.col("t")), " ").alias("want")).collect()
    assert all(r.words == r.want for r in rows)
    import pyarrow as pa

    assert T.latin_words(pa.array(["Ünï_x ², ß", "日本", ""])).to_pylist() == ["uni x ² ß", None, ""]


def test_few_queries_go_to_the_cells(spark, put, monkeypatch):
    """The cells stay where they are, and the rows are those of queries that are sent to them."""
    rows = clustered(600) + [(1000 + i, [1.0] * 12) for i in range(30)] + [(2000, [0.0] * 12), (2001, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    index = cells.build(v, put)
    q = v.withColumnRenamed("id", "query_id")
    few = [index.nearest(q, 4), index.nearest(q, 4, exclude_self=True), index.nearest(q, 700), index.nearest(q, 4, probes=3), index.nearest(q.limit(0), 4)]
    assert all("ShuffledHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in few)
    got = [rows_of(df) for df in few]
    monkeypatch.setattr(cells, "FEW", 10)
    many = [index.nearest(q, 4), index.nearest(q, 4, exclude_self=True), index.nearest(q, 700), index.nearest(q, 4, probes=3), index.nearest(q.limit(0), 4)]
    assert "ShuffledHashJoin" in many[0]._jdf.queryExecution().executedPlan().toString()
    assert got == [rows_of(df) for df in many] and len(got[0]) == 630 * 4 and got[4] == []


def test_vectors_are_made_once(spark, tmp_path):
    """While an index is stored, its vectors are made once and not for each pass over them."""
    made = spark.sparkContext.accumulator(0)

    def vectors_of(batches):
        import pyarrow as pa

        for batch in batches:
            made.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[float(i % 7 + 1), float(i % 11), 1.0] for i in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["id", "vector"])

    draft = VersionedTable(spark, f"file://{tmp_path}/index").draft()
    index = cells.build(spark.range(500).mapInArrow(vectors_of, "id long, vector array<double>"), draft.put)
    assert made.value == 500 and index.cells.agg(F.sum(F.size("ids"))).first()[0] == 500


def sourced(spark, n=300):
    """Passages of three sources and of none, some with the text of others."""
    from corpusloom.functions.embedding import HashEmbedder

    texts = dict(corpus(n))
    rows = [(i, [None, "A", "B", "C"][i % 4] if i % 5 else "A", i, 1, texts[i % 90 if i % 3 == 0 else i]) for i in range(n)]
    chunks = spark.createDataFrame(rows, "id long, source_file string, chunk_id int, page int, text string").repartition(3)
    ask = spark.createDataFrame([a for a in ASKED if a[1]], "query_id long, text string")
    return HashEmbedder(16).embed(chunks, "text", "vector"), HashEmbedder(16).embed(ask, "text", "vector")


def test_ranks_within_a_source_are_counted_in_the_cells(spark, put, monkeypatch):
    """Ties by equal vectors; vectors without direction; no passage of others is listed or moved."""
    rng = np.random.default_rng(4)
    mine, theirs = rng.integers(0, 5, (3, 4)) / 10, rng.integers(0, 5, (3, 9)) / 10
    own, ids = np.array([50, 3, 20, 7]), rng.permutation(60)[:9]
    want = [[sum((theirs[q, j], ids[j]) < (mine[q, i], own[i]) for j in range(9)) for i in range(4)] for q in range(3)]
    assert vectors.before(mine, own, theirs, ids).tolist() == want
    rows = [(i, [float(i % 5), float(i % 3), 1.0] if i % 50 else [0.0] * 3) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0] * 3)], "query_id long, vector array<double>")
    index, some, others = cells.build(v, put), v.where("id % 40 < 2"), v.where("id % 40 >= 2")
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "rank", "distance").collect()))
    found = index.ranks_among(q, some, others)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = key(vectors.ranks_among(q, some, others))
    assert key(found) == want and len(want) == 2 * 18
    monkeypatch.setattr(cells, "FEW", 5)
    assert key(index.ranks_among(q, some, others)) == want


def test_passages_within_a_source_by_stored_indexes(spark, put):
    from corpusloom.operators import search

    chunks, ask = sourced(spark)
    near, words = cells.build(chunks.select("id", "vector"), put), blocks.build(blocks.listed(chunks, "id", "text"), put, shard=50, block=16)
    key = lambda df: sorted(map(tuple, df.collect()))
    for how in ({"source": "B"}, {"source": "B", "pool": 9, "mode": "all_chunks"}, {"source": "nowhere"}):
        want = key(search.search_passages(ask, chunks, lexical.build_index(chunks, "id", "text"), **how))
        assert key(search.search_passages(ask, chunks, words, vectors=near, **how)) == want
        assert bool(want) == (how["source"] == "B")
    own = chunks.where("source_file = 'B'").select("id", F.lit("").alias("grp"))
    found = blocks.scored(ask, words, None, groups=own)
    assert 0 < found.count() == found.join(own, "id", "left_semi").count()  # only its passages leave a shard


def test_hits_go_to_the_passages(spark, put):
    """The hits of few queries fetch their texts; neither texts nor vectors are moved to them."""
    from corpusloom.operators import search

    chunks, ask = sourced(spark)
    kept, ask = put("passages", chunks), ask.where("query_id <> 2")  # no phrase, which has joins of its own
    near, words = cells.build(kept.select("id", "vector"), put), blocks.build(blocks.listed(kept, "id", "text"), put)
    index = lexical.build_index(kept, "id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in search.MODES:
            found = search.search_passages(ask, kept, words, mode=mode, vectors=near)
            text = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.search_passages(ask, kept, index, mode=mode).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_of_hybrid_search_are_stored_once(spark):
    """The vectors lie in blocks and cells; none is stored as a row besides, and none is moved to the queries."""
    from pathlib import Path

    from corpusloom.plans import queries as Q
    from corpusloom.plans import stored

    found = Q.QUERIES["rrf_hybrid_search"](spark, "/root/testdata/sf0.001")
    (table,) = [t for k, t in stored._kept.items() if k[3] == "document-vectors" and k[0] == spark.sparkContext.applicationId]
    parts = Path(table.folder(table.version).removeprefix("file://"))
    assert {p.name for p in parts.iterdir()} == {"unsorted", "centroids", "cells"}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in text and "SortMergeJoin" not in text


def test_rounded_vectors_take_half_the_bytes():
    """Values of six decimals are whole numbers; others stay as they are, and all come back equal."""
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((50, 16)), 6)
    assert len(vectors.packed(x)) == 8 + x.nbytes // 2 and (vectors.unpacked(vectors.packed(x), 50) == x).all()
    for y in (x + 1e-9, x * 1e5, x * 1e305):
        assert len(vectors.packed(y)) == 8 + y.nbytes and (vectors.unpacked(vectors.packed(y), 50) == y).all()


def test_embedded_texts_are_blocked_without_a_second_vector(spark):
    """No filter on the vector, which would be made for the filter and once more for its use."""
    from corpusloom.functions.embedding import HashEmbedder

    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, text string").repartition("id")
    made = vectors.in_blocks(HashEmbedder(8).embed(texts, "text", "vector"), "id", "vector", ("block", "ids", "matrix"), stored=True)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(i for r in made.collect() for i in r.ids) == [1, 3]
    rows = spark.createDataFrame([(1, [1.0]), (2, None), (3, [0.0])], "id long, vector array<double>")
    assert sorted(i for r in vectors.in_blocks(rows, "id", "vector", ("block", "ids", "matrix")).collect() for i in r.ids) == [1, 3]
