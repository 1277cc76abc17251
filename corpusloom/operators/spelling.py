"""Words that are inside each other or spelt alike, without comparing all pairs.

The similarity of two words is twice the letters of their matching blocks over
their lengths together.  Matching letters are common letters, so a similarity
of c takes c / 2 * (n + m) common letters, repeats counted.  Two words that
have so many share one of the rarest few of either; that is what they meet on.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def letters(word: Column) -> Column:
    """The letters of a word, each with how often it has stood there before:
    distinct tokens, of which two words share as many as letters."""
    each = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    return F.flatten(F.transform(F.array_distinct(each), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(each, lambda x: x == c))), lambda i: F.concat(c, i.cast("string")))))


def least_common(n: Column, m: Column, cutoff: float) -> Column:
    """Letters that words of ``n`` and ``m`` letters have in common at least."""
    return F.ceil(F.round(cutoff / 2 * (n + m), 6))


def rarest(tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """``tokens`` (word, n, token) with their ``place`` in their word, rarest first."""
    order = Window.partitionBy("word").orderBy(F.coalesce("df", F.lit(0)), "token")
    return tokens.join(frequency, "token", "left").withColumn("place", F.row_number().over(order))


def candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(l, r): pairs of words whose letters and lengths allow for ``cutoff``;
    all pairs that reach it are among them."""
    tokens = lambda words: words.select("word", F.length("word").alias("n"), F.explode(letters(F.col("word"))).alias("token"))
    a, b = tokens(left), tokens(right)
    frequency = b.groupBy("token").agg(F.count("*").alias("df"))
    # A word of n letters is like no word of fewer than n * c / (2 - c).
    shortest = F.ceil(F.round(F.col("n") * cutoff / (2 - cutoff), 6))
    few = F.col("place") <= F.col("n") - least_common(F.col("n"), shortest, cutoff) + 1
    a, b = rarest(a, frequency).where(few), rarest(b, frequency).where(few)
    a = a.select(F.col("word").alias("l"), F.col("n").alias("ln"), "token", F.col("place").alias("lp"))
    b = b.select(F.col("word").alias("r"), F.col("n").alias("rn"), "token", F.col("place").alias("rp"))
    need = least_common(F.col("ln"), F.col("rn"), cutoff)
    # Behind this token either word has at most so many more to share; words so short that they'd share all have few.
    left_over = F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) + F.least("lp", "rp")
    met = a.join(b, "token").where((F.least("ln", "rn") >= need) & (left_over >= need)).select("l", "r", "ln", "rn").distinct()
    common = F.size(F.array_intersect(letters(F.col("l")), letters(F.col("r"))))
    return met.where(common >= need).select("l", "r")


def grams(word: Column, n: int) -> Column:
    """The distinct runs of ``n`` letters of a word."""
    return F.when(F.length(word) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(i, o): words that stand in others.  A word of three letters or more is
    sought where its rarest three are, a shorter one where all of it is."""
    size = F.least(F.length("word"), F.lit(GRAM))
    all_ = F.concat(*(grams(F.col("word"), n) for n in range(1, GRAM + 1)))
    where = outer.select(F.col("word").alias("o"), F.explode(all_).alias("token"))
    frequency = where.groupBy("token").agg(F.count("*").alias("df"))
    own = F.when(size == 1, grams(F.col("word"), 1)).when(size == 2, grams(F.col("word"), 2)).otherwise(grams(F.col("word"), GRAM))
    key = rarest(inner.select("word", F.explode(own).alias("token")), frequency).where("place = 1").select(F.col("word").alias("i"), "token")
    return key.join(where, "token").where(F.col("o").contains(F.col("i"))).select("i", "o")


def closeness(a: str, b: str) -> float:
    """The similarity as stated; ``b``'s letters are looked up in ``a``'s places."""
    return difflib.SequenceMatcher(None, b, a).ratio()


def similar(asked: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """(asked, key, close) of words (asked) and (key): all pairs of which one is
    inside the other, and all whose similarity is at least ``cutoff``."""
    left, right = asked.select(F.col("asked").alias("word")), keys.select(F.col("key").alias("word")).where("word <> ''")
    met = candidates(left, right, cutoff)
    met = met.unionByName(inside(left, right).select(F.col("i").alias("l"), F.col("o").alias("r")))
    met = met.unionByName(inside(right, left).select(F.col("o").alias("l"), F.col("i").alias("r"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [closeness(a, k) for a, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(close, pa.float64())], ["asked", "key", "close"])

    scored = met.mapInArrow(run, "asked string, key string, close double")
    within = F.col("key").contains(F.col("asked")) | F.col("asked").contains(F.col("key"))
    return scored.where(within | (F.col("close") >= cutoff))
