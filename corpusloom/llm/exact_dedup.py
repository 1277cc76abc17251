"""Exact deduplication over an extendible-hash index, in DataFrame operations.

The index is two tables in the shared folder: a directory, whose slots are the
first bits of a 64-bit key and lead to buckets, and the buckets' entries, one for
each distinct text.  The directory doubles, by one more bit, until no bucket has
more distinct keys than its capacity; each doubling splits the overfull buckets
and no others.  The owner of a range of buckets and keys sorts the texts of a key
into chains by comparing their bytes.  Every document finds its group by its key's
slot, its bucket and its place in the chain.

Copies are summed before they are sent to an owner, so one text may be a third
of all rows; texts whose key occurs once never leave the task that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, lower_ascii, materialize, maybe_in, split_by

#: Distinct keys in a bucket at most.
BUCKET_KEYS = 50_000
#: The directory has at most 2**MOST_BITS slots, so it may be broadcast; beyond,
#: a bucket at full depth may exceed its capacity, not its correctness.
MOST_BITS = 16
#: Parts in which the copies of a text are summed before its owner adds them up.
SALTS = 16


def slot_of(key: str, bits: int):
    """A key's first ``bits`` bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int = BUCKET_KEYS) -> tuple[int, list[tuple[int, int, int]]]:
    """The depth of the directory for distinct ``keys`` (a column key), and its
    slots (slot, bucket, the bucket's own depth).

    The keys are counted once, by their first MOST_BITS bits, which bounds what
    the driver gets; the doublings work on the counts.
    """
    full = 1 << MOST_BITS
    below = [0] * (full + 1)
    for r in keys.groupBy(slot_of("key", MOST_BITS).alias("slot")).count().collect():  # at most 2**MOST_BITS rows
        below[r.slot + 1] = r["count"]
    for i in range(full):
        below[i + 1] += below[i]
    depth, buckets = 0, {0: 0}  # the depths of buckets, by the least prefix of their keys
    overfull = lambda start, own: below[start + (full >> own)] - below[start] > capacity
    while depth < MOST_BITS and (split := [start for start, own in buckets.items() if own == depth and overfull(start, own)]):
        depth += 1
        for start in split:
            buckets[start] = buckets[start + (full >> depth)] = depth
    shift = MOST_BITS - depth
    return depth, [((start >> shift) + i, start, own) for start, own in buckets.items() for i in range(1 << (depth - own))]


def exact_dedup(docs: DataFrame, capacity: int = BUCKET_KEYS) -> DataFrame:
    """Group equal whole texts, A-Z lower-cased; the row with the largest
    doc_id stays.

    Returns a row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256.  Null counts as the empty text; a null doc_id is smaller than
    any other, and stays only in a group without others.  Of rows that repeat
    both doc_id and text one stays.  Very long texts are compared whole; an
    empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long"), lower_ascii(F.col("text")).alias("bytes"))
    found = source.select("doc_id", key_of("bytes").alias("key"), F.sha2("bytes", 256).alias("text_sha256"))
    found = materialize(found.groupBy("doc_id", "key", "text_sha256").agg(F.count("*").alias("copies")), "documents")
    index, find = build_index(docs, found, capacity)
    met = find(found).join(index, ["bucket", "key", "text_sha256"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return met.select("doc_id", "keep_id", "group_size", each, stays.alias("stays"), "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def key_of(bytes_: str):
    return F.xxhash64(bytes_)


def build_index(docs: DataFrame, found: DataFrame, capacity: int):
    """The entries (bucket, key, link, text_sha256, group_size, keep_id) of all
    distinct texts, and a function that gives rows their key's bucket.

    ``found`` has (doc_id, key, text_sha256, copies) of ``docs``.
    """
    spark = docs.sparkSession
    keys = materialize(found.groupBy("key").agg(F.sum("copies").alias("n"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256")), "keys")
    bits, slots = build_directory(keys, capacity)
    directory = materialize(spark.createDataFrame(slots, "_slot long, bucket long, depth int").select("_slot", "bucket"), "directory")

    def find(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_slot", slot_of("key", bits)).join(F.broadcast(directory), "_slot").drop("_slot")

    shared = keys.where("n > 1").select("key")
    # The texts of those keys, and few others; the copies of one are summed in SALTS parts.
    ids = found.join(shared, "key", "left_semi").select("doc_id")
    texts = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id").select("doc_id", lower_ascii(F.col("text")).alias("bytes"))
    summed = texts.groupBy(key_of("bytes").alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "bytes").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id"))
    # Owners take ranges of buckets and keys.  A key's texts lie in order of
    # their bytes, so a link of its chain begins where they differ from those before.
    chain = Window.partitionBy("bucket", "key").orderBy("bytes")
    begins = F.coalesce(F.col("bytes") != F.lag("bytes").over(chain), F.lit(True))
    linked = find(summed).repartitionByRange("bucket", "key").withColumn("begins", begins.cast("int")).withColumn("link", F.sum("begins").over(chain))
    chains = linked.groupBy("bucket", "key", "link").agg(F.max(F.when(F.col("begins") == 1, F.sha2("bytes", 256))).alias("text_sha256"), F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    chains = chains.join(shared, "key", "left_semi")
    single = find(keys.where("n = 1")).select("bucket", "key", F.lit(1).cast("long").alias("link"), "text_sha256", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"))
    return materialize(single.unionByName(chains.select(*single.columns)), "index"), find


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that
    :func:`exact_dedup` keeps; its docstring says what becomes of nulls, empty
    texts and repeated rows.  Rows whose doc_id no dropped row has are not moved.
    """
    found = materialize(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "dedup")
    dropped = found.where("not kept").select("doc_id", "text_sha256").distinct()
    verdict = found.join(dropped, (found.doc_id.eqNullSafe(dropped.doc_id)) & (found.text_sha256 == dropped.text_sha256), "left_semi").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"))
    key, id_, digest, of, kept = (free_name(docs, x) for x in ("_key", "_id", "_sha", "_of", "_kept"))
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    sure, others = split_by(keyed, dropped.select(F.col("doc_id").alias(key)), key)
    others = others.withColumn(digest, F.sha2(lower_ascii(F.col("text")), 256))
    verdict = verdict.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(of), F.col("kept").alias(kept))
    judged = others.join(verdict, others[key].eqNullSafe(verdict[id_]) & (others[digest] == verdict[of]), "left")
    alone = judged.where(F.col(kept).isNull())
    repeated = judged.where(kept).dropDuplicates([key, digest])  # rows that repeat doc_id and text
    return sure.drop(key).unionByName(alone.unionByName(repeated).select(*docs.columns))
