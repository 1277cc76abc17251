"""Ranked search, license scans and vector codes against brute force, and on
awkward tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusloom.llm")
from corpusloom.llm import license_scan, ranked_search, vector_codes  # noqa: E402
from corpusloom.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


# Ranked search


def best_by_hand(docs, items, k):
    """``docs`` as (doc_id, text) rows, ``items`` as (item_id, text)."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(m for *_, m in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = {}
    for item, terms in asked.items():
        scores = []
        for doc, c, m in counted:
            s = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * m * n) // length)))
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (None if null else doc, -s)
    return out


def ranked(df):
    rows = df.collect()
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    made = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    assert len(made) == len(rows)
    return made


def test_ranked_search_equals_brute_force(spark):
    docs, items = Q.table(spark, SF, "documents"), Q.table(spark, SF, "benchmark")
    want = best_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()], 50)
    assert ranked(Q.op11_ranked_search(spark, SF)) == want
    # Small windows and blocks of few items change nothing.
    assert ranked(ranked_search.rank(docs, items, window=8, pairs=150)) == want


DOCS = [
    (1, "Alpha beta, beta"), (2, "alpha BETA beta"), (-70, "beta beta alpha"), (3, None), (4, "  .,;"), (5, "gamma"), (5, "alpha gamma"), (5, "alpha gamma"), (5, "alpha gamma"),
    (None, "alpha alpha été"), (None, None), (10**15, "Été été gamma_delta"), (8, "long " * 40_000 + "delta"), (9, "x" * 60_000),
]
ITEMS = [(1, "alpha beta"), (2, "GAMMA-delta"), (2, "gamma"), (3, None), (4, ""), (None, "été"), (5, "nowhere"), (6, "long"), (6, "long")]


@pytest.mark.parametrize("how", [{}, {"window": 2}, {"k": 2}, {"pairs": 1}])
def test_ranked_search_on_awkward_rows(spark, how):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).withColumns({"score": F.lit(1), "row": F.lit("x"), "terms": F.lit(0)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"term": F.lit(1), "doc_id": F.lit(2)})
    want = best_by_hand(DOCS, ITEMS, how.get("k", 50))
    assert ranked(ranked_search.rank(docs, items, **how)) == want and want
    assert ranked(ranked_search.rank(docs.limit(0), items, **how)) == {}
    assert ranked(ranked_search.rank(docs, items.limit(0), **how)) == {}


def test_gains_beyond_64_bits():
    small = ranked_search.gains(np.array([3000]), np.array([7]), np.array([900]), 10, 4000)
    assert small.tolist() == [3000 * ((7 * 10**9) // (7000 + 20 * (50 + 50 * 900 * 10 // 4000)))]
    n, docs = 10**9, 10**11
    large = ranked_search.gains(np.array([3000]), np.array([10**10]), np.array([n]), docs, 10**14)
    assert large.tolist() == [3000 * ((10**19) // (10**13 + 20 * (50 + 50 * n * docs // 10**14)))]


# License scans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def labels_by_hand(text):
    words = terms_of(text)
    found = set()
    for n in license_scan.all_notices():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                said = " ".join(words[i:j])
                if len(said) > len(n.words) + n.edits:
                    break
                if len(said) >= len(n.words) - n.edits and distance(said, n.words) <= n.edits:
                    found.add(n.label)
    return found


def with_edits(rng, words, k):
    s = list(words)
    for _ in range(k):
        at = rng.randrange(len(s))
        s[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "x"])
    return "".join(s)


def test_notices_with_edits_are_found(spark):
    rng = random.Random(5)
    notices = license_scan.all_notices()
    texts = []
    for _ in range(120):
        said = [with_edits(rng, n.words, rng.randrange(n.edits + 2)) for n in rng.sample(notices, 2)]
        texts.append("Some words: " + " and others, ".join(x.replace(" ", rng.choice([" ", ", ", " \n", "-"])) for x in said) + ". The end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_scan(docs).collect():
        assert {m.label for m in r.matches} == labels_by_hand(texts[r.doc_id]), texts[r.doc_id]
        for m in r.matches:
            said = " ".join(terms_of(texts[r.doc_id][m.start : m.stop]))
            assert distance(said, m.notice) == m.edits and (m.base <= (m.edits == 0))
            assert said == " ".join(terms_of(texts[r.doc_id])[m.first_word : m.last_word + 1])


def base_by_hand(text):
    words = terms_of(text)
    at = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p)
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


LICENSED = [
    (1, "Released under the MIT License, mit-license; MIT LICENSE"), (2, None), (2, ""), (2, ""), (3, "cc by cc by-nc 4.0"), (None, "the gnu general public license"),
    (4, "mit licence or apache licens"), (5, "smit licenses emit"), (6, "license " * 5000), (7, "Émit license gnu general public license x_apache_license"), (8, "mit"), (9, "cc by" * 3), (10, "cc" + " by cc" * 20_000),
]


def test_license_query_and_awkward_rows(spark):
    docs = Q.table(spark, SF, "documents").select("doc_id", "text").collect()
    made = {r.doc_id: r for r in Q.op12_license_scan(spark, SF).collect()}
    assert len(made) == len(docs)
    for r in docs:
        m = made[r.doc_id]
        assert (m.n_words, m.n_base, m.first_word, m.last_word, m.base_labels) == base_by_hand(r.text)
        assert set(filter(None, m.base_labels.split(","))) <= set(m.labels.split(",")) and (m.score == 1.0) == (m.n_base > 0 or ":0" in m.spans)
    df = spark.createDataFrame(LICENSED, "doc_id long, text string").withColumns({"matches": F.lit(1), "label": F.lit("x")})
    got = license_scan.digest(license_scan.license_scan(df)).collect()
    want = Counter((i, *base_by_hand(t)) for i, t in LICENSED)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].labels == "apache,mit" and 0.8 < by_id[4].score < 1 and by_id[4].base_labels == ""
    assert by_id[6].labels == "" and by_id[6].score == 0 and by_id[3].labels == "cc-by,cc-by-nc"
    assert license_scan.license_scan(df.limit(0)).count() == 0


# Vector codes


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """``rows`` as (vec_id, vector, label): the stated steps with Python's numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in kept]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in seeds] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(book, cut(v)[p])[1]].append(cut(v)[p])
            for i, own in groups.items():
                book[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, label, [near(book, x) for book, x in zip(books, cut(v), strict=True)]) for i, v, label in kept]
    total = Counter()
    for _, label, near_ in found:
        total[label] += sum(d for d, _ in near_)
    return sorted(((i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), total[label]) for i, label, n in found), key=repr)


def coded(df):
    rows = df.collect()
    assert len({r.codebooks_sha256 for r in rows}) <= 1
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=repr)


def test_vector_codes_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in Q.table(spark, SF, "embeddings").collect()]
    assert coded(Q.op13_vector_codes(spark, SF)) == codes_by_hand(rows)


VECTORS = [(i, [((i * 7 + j * j) % 5) * 0.25 - 0.5 for j in range(16)], i % 3 if i % 4 else None) for i in range(60)] + [
    (3, [0.5] * 16, 1), (3, [0.5] * 16, 1), (3, [-0.5] * 16, 2), (None, [0.25] * 16, None), (100, None, 1), (-5, [math.nan] + [0.0] * 15, 1), (-6, [math.inf] + [0.0] * 15, 2), (-7, [None] + [0.0] * 15, 2), (101, [1e-30, -1e-30] * 8, 7),
]


@pytest.mark.parametrize("rows", [VECTORS, VECTORS[:5], [(1, [0.0] * 8, None)] * 40, [(1, None, None)]])
def test_vector_codes_with_ties_and_awkward_rows(spark, rows):
    """Few values make many equal distances; the lower index has to win."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumns({"code": F.lit(1), "of": F.lit(2), "id": F.lit(3), "salt": F.lit(4)})
    assert coded(vector_codes.compress(df)) == codes_by_hand(rows)
    assert coded(vector_codes.compress(df.limit(0))) == []


def test_label_sums_without_broadcast(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int")
    books = vector_codes.fit_codebooks(df)
    codes = vector_codes.encode(df, books).withColumn("salt", F.lit(9))
    dealt = vector_codes.with_label_error(codes, labels=0, salts=4)
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, vector_codes.with_label_error(codes).collect()))


def test_trees_visit_equal_bounds():
    rng = np.random.default_rng(3)
    for width, high in ((1, 3), (2, 3), (8, 2), (8, 2000)):
        book, x = rng.integers(-high, high, (16, width)), rng.integers(-high, high, (500, width))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, best = vector_codes.KdTree(book).nearest(x)
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


@pytest.mark.parametrize("vectors", [[[1.0] * 9], [[1.0] * 8, [1.0] * 16], [[1e9] * 8], [[]]])
def test_vectors_that_have_no_codes(spark, vectors):
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="components|lengths|too large"):
        vector_codes.compress(df).collect()
