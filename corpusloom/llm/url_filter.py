"""URL filtering: host and path rules, and boosted trees for the rest.

Where a rule fits, the longest decides.  Other URLs are judged by
gradient-boosted trees on lexical features (lengths, depth, digit ratio,
entropy, parameters) and on suffix statistics: how often labelled URLs with the
same top-level domain, domain, first directory or file suffix are blocked.  The
statistics cover all labelled URLs, in a hashed table of fixed size; the trees
are fitted on a bounded sample of them.  Hosts are dealt into folds: a URL's own
fold never counts in the statistics that it teaches with, and scores of hosts
that a model has not seen set the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import lean, short_batches

# Fixed values: (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Labelled URLs that the trees are fitted on at most, chosen by hash.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
#: Weight of the overall rate in a suffix's rate.
SMOOTHING = 20.0
#: Places for suffixes of one kind in the statistics, and folds that hosts are dealt into.
PLACES, FOLDS = 1 << 14, 5
KINDS = 4
LEXICAL = 15


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def fits(host: Column, path: Column, rule: str) -> Column:
    name, _, start = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, null if none does."""
    return F.coalesce(*(F.when(fits(host, path, r), r) for _, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))), F.lit(None).cast("string"))


def places(host: Column, path: Column) -> Column:
    """The places of a URL's top-level domain, domain, first directory and file suffix in the statistics."""
    file = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?\z", 1)
    suffixes = (F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), F.regexp_extract(path, r"^/([^/]*)/", 1), file)
    return F.array(*((F.crc32(x.cast("binary")) % PLACES).cast("int") for x in suffixes))


def fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def features(url: str, host: str, path: str) -> list[float]:
    """The lexical features; the rates of the suffixes come behind them."""
    n = max(1, len(url))
    query = url.split("#")[0].partition("?")[2]
    counts = Counter(url)
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        query.count("&") + 1 if query else 0, len(query), "#" in url, url.startswith("https:"),
        max(map(len, re.split(r"[./-]", host))), host.startswith("www."),
    ]


class BoostedTrees:
    """Logistic loss, level-wise trees over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.start, self.trees = math.log(rate / (1 - rate)), []
        self.edges = [self.cuts(c) for c in x.T] if len(x) else []
        if len(set(y.tolist())) < 2:
            return
        bins, f = self.binned(x), np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            f += RATE * self.walk(tree, bins)

    @staticmethod
    def cuts(column: np.ndarray) -> np.ndarray:
        """Midways from a quantile to the next value, so that values between two seen ones go to the nearer."""
        values = np.unique(column)
        at = np.searchsorted(values, np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")))
        at = at[at + 1 < len(values)]
        return (values[at] + values[at + 1]) / 2

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """Nodes in heap order: (feature, bin) of a split, or None; and values."""
        node, splits, values = np.zeros(len(g), dtype=np.int64), [None] * (2**DEPTH - 1), np.zeros(2 ** (DEPTH + 1) - 1)
        for i in range(len(values)):
            own = np.flatnonzero(node == i)
            if not len(own):
                continue
            total_g, total_h = g[own].sum(), h[own].sum()
            values[i] = total_g / (total_h + 1.0)
            if i >= len(splits) or len(own) < 20:
                continue
            best = (1e-6, None)
            for j in range(bins.shape[1]):
                sg = np.bincount(bins[own, j], g[own], BINS).cumsum()[:-1]
                sh = np.bincount(bins[own, j], h[own], BINS).cumsum()[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(sh < 1) | (total_h - sh < 1)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
            splits[i] = best[1]
            if best[1]:
                j, b = best[1]
                node[own] = 2 * i + 1 + (bins[own, j] > b)
        return [splits, values]

    def walk(self, tree: list, bins: np.ndarray) -> np.ndarray:
        splits, values = tree
        node = np.zeros(len(bins), dtype=np.int64)
        for _ in range(DEPTH):
            for i in np.unique(node):
                if i < len(splits) and splits[i]:
                    own = np.flatnonzero(node == i)
                    node[own] = 2 * i + 1 + (bins[own, splits[i][0]] > splits[i][1])
        return values[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        if self.trees:
            bins = self.binned(x)
            for tree in self.trees:
                f += RATE * self.walk(tree, bins)
        return 1 / (1 + np.exp(-f))


class UrlModel:
    """Trees, the threshold from which a score means block, and the statistics:
    blocked and all labelled URLs by kind of suffix, place and fold."""

    def __init__(self, blocked: np.ndarray, total: np.ndarray):
        self.blocked, self.total = blocked, total
        self.trees, self.threshold, self.held_out = BoostedTrees(np.zeros((0, 0)), np.zeros(0)), 0.5, {}

    def rates(self, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """A column per kind: the smoothed share of blocked URLs at places ``at``, without the folds ``own``."""
        columns = []
        for kind in range(KINDS):
            k, m = self.blocked[kind].sum(axis=1)[at[:, kind]], self.total[kind].sum(axis=1)[at[:, kind]]
            all_k, all_m = self.blocked[kind].sum(), self.total[kind].sum()
            if own is not None:
                k, m = k - self.blocked[kind][at[:, kind], own], m - self.total[kind][at[:, kind], own]
                all_k, all_m = all_k - self.blocked[kind].sum(axis=0)[own], all_m - self.total[kind].sum(axis=0)[own]
            columns.append((k + SMOOTHING * (all_k + 1) / (all_m + 2)) / (m + SMOOTHING))
        return np.column_stack(columns)

    def fit(self, lexical: np.ndarray, at: np.ndarray, own: np.ndarray, y: np.ndarray) -> UrlModel:
        if not len(y):
            self.threshold = 1.0  # nothing is known: allow
            return self
        x = np.column_stack([lexical, self.rates(at, own)])
        self.trees = BoostedTrees(x, y)
        if len(set(y.tolist())) == 2:
            unseen = np.zeros(len(y))
            for f in np.unique(own):
                unseen[own == f] = BoostedTrees(x[own != f], y[own != f]).score(x[own == f])
            self.threshold, self.held_out = best_threshold(unseen, y)
        return self

    def score(self, lexical: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.trees.score(np.column_stack([lexical, self.rates(at)]))


def best_threshold(score: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, float]]:
    """The threshold with the best balanced accuracy (of several, the one
    nearest to the labels' rate), and the figures there.

    Accuracy is balanced as the share of blocked URLs among those that the
    rules happen to reach says nothing about the others.
    """
    values = np.unique(score)
    cuts = np.concatenate([values[:1], (values[1:] + values[:-1]) / 2])
    positive, negative = np.sort(score[y == 1]), np.sort(score[y == 0])
    caught = 1 - np.searchsorted(positive, cuts) / len(positive)
    spared = np.searchsorted(negative, cuts) / len(negative)
    balanced = (caught + spared) / 2
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    i = best[np.abs(cuts[best] - y.mean()).argmin()]
    below = np.searchsorted(negative, positive) + np.searchsorted(negative, positive, "right")
    return float(cuts[i]), {"auc": float(below.mean() / 2 / len(negative)), "caught": float(caught[i]), "spared": float(spared[i])}


def _described(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("url", "host", "path", "places")), strict=True)
    rows = [(features(u or "", h, p), at) for u, h, p, at in rows]
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, LEXICAL), np.array([r[1] for r in rows], dtype=np.int64).reshape(-1, KINDS)


def fit_url_model(taught: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Statistics over all of ``taught`` (url, host, path, blocked), and trees
    on at most ``sample`` of its distinct URLs, those with the least hashes."""
    taught = taught.select("url", "host", "path", "blocked", places(F.col("host"), F.col("path")).alias("places"), fold(F.col("host")).alias("fold"))
    sums = taught.select("blocked", "fold", F.posexplode("places").alias("kind", "place")).groupBy("kind", "place", "fold").agg(F.sum("blocked").alias("k"), F.count("*").alias("m"))
    rows = sums.toArrow()  # at most KINDS * PLACES * FOLDS
    blocked, total = np.zeros((KINDS, PLACES, FOLDS)), np.zeros((KINDS, PLACES, FOLDS))
    where = tuple(rows[c].to_numpy() for c in ("kind", "place", "fold"))
    blocked[where], total[where] = rows["k"].to_numpy(), rows["m"].to_numpy()

    # Rows are at least as many as distinct URLs, so about ``sample`` pass at most.
    share = min(1.0, sample / max(1.0, float(total[0].sum())))
    order = F.pmod(F.xxhash64("url"), F.lit(1 << 32))
    chosen = taught.where(order < int(share * (1 << 32))).withColumn("order", order).distinct().toArrow()
    chosen = chosen.sort_by([("order", "ascending"), ("url", "ascending"), ("blocked", "ascending")]).slice(0, sample)
    lexical, at = _described(chosen)
    return UrlModel(blocked, total).fit(lexical, at, chosen["fold"].to_numpy(), chosen["blocked"].to_numpy().astype(np.float64))


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` with host and path, empty where there is none."""
    return urls.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})


def url_filter(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE, model: UrlModel | None = None) -> DataFrame:
    """Judge every URL.

    ``labelled`` has url and blocked (0 or 1); by default the URLs that a rule
    fits are the labelled ones.  ``model`` is a fitted one to use instead.
    Returns page_id, host, path, rule (null where none fits) and verdict: the
    rule's, else block where the trees' score reaches the model's threshold.  A
    null url, or one without ``://``, has an empty host and path, and the
    verdict of its features; very long URLs are read whole; repeated rows are
    judged alike, count each time in the statistics and once in the sample, and
    URLs with both labels teach both; without labels of both kinds the more
    frequent one decides, allow if there are none.  URLs whose hashes tie at the
    sample's end go by URL.  Suffixes that share a place share a rate.  An empty
    table gives no rows; other columns are not read.
    """
    urls = parsed(pages.select(F.col("page_id").cast("long"), "url")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.coalesce(*(F.when(F.col("rule") == r, v) for v, r in rules), F.lit(None).cast("string"))
    if model is None:
        if labelled is None:
            taught = urls.where("rule is not null").withColumn("blocked", (ruled == "block").cast("int"))
        else:
            taught = parsed(labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where("url is not null and blocked in (0, 1)"))
        model = fit_url_model(taught, sample)
    short_batches(pages.sparkSession)
    asked = urls.withColumn("places", places(F.col("host"), F.col("path")))
    kept = ["page_id", "host", "path", "rule"]

    @lean("urls")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                said = np.where(model.score(*_described(batch)) >= model.threshold, "block", "allow")
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(said.tolist(), pa.string())], [*kept, "said"])

    schema = StructType([*asked.select(kept).schema.fields, StructField("said", StringType())])
    return asked.mapInArrow(run, schema).select(*kept, F.coalesce(ruled, "said").alias("verdict"))
