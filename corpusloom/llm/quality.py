"""Quality rules whose thresholds come from the corpus.

Each metric's distribution is kept per language and source in a histogram
sketch: values fall in buckets of at most 1/64 relative width, and sketches
merge by adding counts, in any order and with the same result.  A language's
merged sketch is part of each of its sources', with the weight of a bounded
number of documents, so the fewer documents a source has the more it counts.
The fence is where a sketch falls into two classes that lie far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, parts, short_batches

# The base rules' symbols, white space and limits.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30

#: Metrics, in thousandths.
METRICS = ("symbols", "dup_lines", "repeats", "stutter", "upper")
#: The weight, in documents, that a language's sketch has in those of its sources.
PRIOR = 100
#: Share of a sketch's variance that lies between its two classes, at least, for
#: it to have an upper class that is apart from the rest.
LEAST_APART = 0.9
#: Leading bits that a bucket keeps of a value.
PRECISION = 7

FEATURES = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_stutter long, n_upper long"


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def repeated_words(word: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """For each document, its words in windows of ``width`` words that it has
    twice or more.  ``word`` holds the documents' word numbers one after
    another, ``doc`` each word's document, in order."""
    n = len(word) - width + 1
    if n < 1:
        return np.zeros(n_docs, dtype=np.int64)
    start = np.flatnonzero(doc[:n] == doc[width - 1 :])
    with np.errstate(over="ignore"):
        mixed = (word + 1) * np.int64(-7046029254386353131)
        mixed ^= mixed >> 29
        digest = doc.astype(np.int64) * np.int64(-4417276706812531889)
        digest = digest[:n].copy()
        for k in range(width):
            digest = digest * np.int64(6364136223846793005) + mixed[k : n + k]
            digest ^= digest >> 31
    digest = digest[start]
    order = np.argsort(digest, kind="stable")
    same = np.flatnonzero(digest[order[1:]] == digest[order[:-1]])
    if not len(same):
        return np.zeros(n_docs, dtype=np.int64)
    # Windows of one digest are compared word by word.
    at = start[np.unique(np.concatenate([order[same], order[same + 1]]))]
    windows = np.column_stack([doc[at], *(word[at + k] for k in range(width))])
    _, which, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[which.ravel()] > 1]
    edge = np.bincount(at, minlength=len(word) + 1)[: len(word) + 1] - np.bincount(at + width, minlength=len(word) + 1)
    inside = np.cumsum(edge[: len(word)]) > 0
    return np.bincount(doc[inside], minlength=n_docs)


def text_features(texts: list[str | None]) -> np.ndarray:
    """A row per text: words, word characters, symbols, repeated lines, words in
    repeated windows, lines with a word, words equal to the one before, A-Z."""
    out = np.zeros((len(texts), 8), dtype=np.int64)
    numbers, words = _Numbers(), []
    for i, text in enumerate(texts):
        data = (text or "").encode()
        own = data.split()
        words.append(own)
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        out[i, 0] = len(own)
        out[i, 1] = len(text or "") - len(data) + len(data.translate(None, WHITE))
        out[i, 2] = len(data) - len(data.translate(None, SYMBOLS))
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5] = len(lines)
        out[i, 7] = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    word = np.fromiter((n for own in words for n in map(numbers.__getitem__, own)), dtype=np.int64, count=out[:, 0].sum())
    doc = np.repeat(np.arange(len(texts)), out[:, 0])
    out[:, 4] = repeated_words(word, doc, len(texts))
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    out[:, 6] = np.bincount(doc[again], minlength=len(texts))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """The features of every whole text, with doc_id, lang and source."""

    @lean("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            for part in parts(batch, 3):
                found = text_features(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(found[:, k]) for k in range(8))], names)

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, FEATURES)


def bucket(value: Column) -> Column:
    """The lower end of a value's sketch bucket."""
    drop = F.greatest(F.length(F.bin(value)) - PRECISION, F.lit(0))
    return F.floor(value / F.pow(F.lit(2), drop)) * F.pow(F.lit(2), drop).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bucket, n) of the sketches of one language
    and source each."""
    long = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS))).alias("m"))
    return long.groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def with_prior(sketch: DataFrame) -> DataFrame:
    """``sketch`` with a weight w for each bucket: its own documents, and the
    PRIOR documents' worth of the language's merged sketch."""
    merged = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    share = F.col("n") * float(PRIOR) / F.sum("n").over(Window.partitionBy("lang", "metric"))
    merged = merged.select(F.col("lang").alias("of"), "metric", "bucket", share.alias("share"))
    groups = sketch.select("lang", "source").distinct()
    pooled = groups.join(merged, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "source", "metric", "bucket", F.col("share").alias("w"))
    # Both have a row at most for a bucket: two terms, whose order does not matter.
    return pooled.unionByName(sketch.withColumn("w", F.col("n").cast("double")).drop("n")).groupBy("lang", "source", "metric", "bucket").agg(F.sum("w").alias("w"))


def fences(weighted: DataFrame) -> DataFrame:
    """A row per language and source: the highest bucket that each metric may
    have there, null where all may.

    On the scale of square roots a sketch is split in two where the variance
    between the classes is largest; the split is a fence if that is nearly all
    variance there is.  A group has at most a few hundred buckets.
    """
    group = Window.partitionBy("lang", "source", "metric")
    upto = group.orderBy("bucket")
    root = F.sqrt("bucket")
    moments = weighted.select(
        "lang", "source", "metric", "bucket",
        F.sum("w").over(upto).alias("c"), F.sum(F.col("w") * root).over(upto).alias("s"),
        F.sum("w").over(group).alias("wt"), F.sum(F.col("w") * root).over(group).alias("st"), F.sum(F.col("w") * F.col("bucket")).over(group).alias("qt"),
        F.max("bucket").over(group).alias("last"),
    ).where("bucket < last")
    between = F.expr("pow(s / c - (st - s) / (wt - c), 2) * c * (wt - c) / wt / (qt - st * st / wt)")
    best = moments.groupBy("lang", "source", "metric").agg(F.max(F.struct(F.round(between, 9).alias("apart"), (-F.col("bucket")).alias("b"))).alias("x"))
    fence = best.where(F.col("x.apart") >= LEAST_APART).select("lang", "source", "metric", (-F.col("x.b")).alias("most"))
    return fence.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"most_{m}") for m in METRICS))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judge every whole text by the base rules and the corpus's own fences.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and ``failed_fences`` (the metrics that
    lie above their fence; a group without an upper class apart has none).  A
    null or empty text has no words and fails the base rules; texts of any length
    are read whole; null languages and sources are groups of their own; repeated
    rows are judged alike, each with a row; an empty table gives no rows; other
    columns are not read.
    """
    rows = materialize(measure(docs), "quality")
    thousandths = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    rows = rows.withColumns(
        {
            "symbols": thousandths("n_symbols", "word_chars"),
            "dup_lines": thousandths("n_dup_lines", "n_lines"),
            "repeats": thousandths("n_repeat_words", "n_words"),
            "stutter": thousandths("n_stutter", "n_words"),
            "upper": thousandths("n_upper", "word_chars"),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
        }
    )
    most = fences(with_prior(sketches(rows))).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    over = F.array_compact(F.array(*(F.when(bucket(F.col(m)) > F.col(f"most_{m}"), F.lit(m)) for m in METRICS)))
    return (
        rows.join(most, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("failed_fences", over)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_fences") == 0)).alias("kept"), "failed_fences")
    )
