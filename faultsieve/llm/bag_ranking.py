"""Ranked lexical search that scores each bag of words once.

Documents are restricted to the vocabulary of the items. Those with the same term frequencies and the same length factor m
are one class: classes are grouped by a hash of both together with the frequencies themselves, so a collision makes two
classes. A class is scored once for all items; the best classes of an item are expanded to their documents, by ascending doc_id.

Terms are counted and joined in Spark. The vocabulary is broadcast only where its measured size allows it; beyond that
it is joined with shuffled counts. Items meet the classes in blocks of bounded size: a block's weights are a dense table
of terms by items, and each task keeps the best classes of each item, so a task returns no more than that.
An item needs no more than `most` classes (those before the first `most` by score and least doc_id cannot all be behind
another class), and a class no more than `most` documents, so both limits are exact.

Defined cases: a null text has no terms, and a document or item without terms is in no result; documents without terms
don't count; a document with a null doc_id counts but is not listed; repeated rows are documents of their own, ordered by
doc_id and then in any order (equal rows); rows of one item_id are one item with the terms of all; a null item_id is no
item; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, new_path

#: ASCII letters, digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 50
#: The vocabulary is broadcast up to so many bytes of terms with 32 more for each.
BROADCAST_BYTES = 64 << 20
#: Items of a block, and entries of its table of terms by items.
ITEMS, ENTRIES = 256, 16 << 20
SALTS = 32


def terms(column: str = "text") -> Column:
    """The terms of a text, still with their capitals."""
    return F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(TERM), F.lit(0))


def lowered(c: Column) -> Column:
    """Only A-Z become small letters; a term of ASCII alone needs no look at each letter."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""
    return items.where("item_id is not null").select("item_id", F.explode(terms()).alias("term")).select("item_id", lowered(F.col("term")).alias("term")).distinct()


def bags(docs: DataFrame, vocabulary: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """_row, doc_id, n (all terms) and bag (the frequencies of the vocabulary's terms by number) of each document.

    `vocabulary` has term and t; t is below 0 for the empty term, which every document is given once so that none is lost.
    """
    words = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), terms().alias("_terms"))
    words = words.select("_row", "doc_id", F.size("_terms").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), "_terms")).alias("term"))
    words = words.withColumn("term", lowered(F.col("term")))
    size = vocabulary.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    keys = ["_row", "doc_id", "n"]
    if size <= broadcast_bytes:
        counts = words.join(F.broadcast(vocabulary), "term").groupBy(*keys, "t").agg(F.count("*").alias("tf"))
    else:
        counts = words.groupBy(*keys, "term").agg(F.count("*").alias("tf")).join(vocabulary, "term")
    pair = F.when(F.col("t") >= 0, F.struct("t", "tf"))
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("bag"))


def _blocks(weights: DataFrame) -> int:
    """The number of blocks that keeps a block's items and its table of terms by items bounded."""
    n, postings = weights.agg(F.count_distinct("item_id"), F.count("*")).first()
    return max(1, math.ceil(n / ITEMS), math.ceil(math.sqrt(n * postings / ENTRIES)))


def _best(scores: np.ndarray, firsts: np.ndarray, classes: np.ndarray, most: int) -> np.ndarray:
    """Places of the best scores above 0, equal ones by least document."""
    at = np.flatnonzero(scores > 0)
    if len(at) > most:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((classes[at], firsts[at], -scores[at]))[:most]]


def _score(classes: DataFrame, block: list, most: int) -> DataFrame:
    """class_id, item_id, score and first of the best classes of each item of a block, for each task."""
    items = np.array(sorted({r["item_id"] for r in block}), dtype=np.int64)
    known = np.array(sorted({r["t"] for r in block}), dtype=np.int64)
    table = np.zeros((len(known), len(items)), np.int64)
    for r in block:
        table[np.searchsorted(known, r["t"]), np.searchsorted(items, r["item_id"])] = r["w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0, np.int64),) * 3 for _ in items]
        for batch in batches:
            ids, firsts, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bag = batch.column(3)
            pairs, ends = bag.flatten(), np.concatenate(([0], np.cumsum(bag.value_lengths().to_numpy(zero_copy_only=False))))
            t, tf = (x.to_numpy(zero_copy_only=False) for x in pairs.flatten())
            place = np.minimum(np.searchsorted(known, t), len(known) - 1)
            gain = np.where(known[place] == t, 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(ends))), 0)
            scores = np.array([gain[a:b] @ table[place[a:b]] for a, b in zip(ends, ends[1:])]).reshape(-1, len(items))
            for i, (s, f, c) in enumerate(kept):
                new = _best(scores[:, i], firsts, ids, most)
                s, f, c = np.concatenate((s, scores[new, i])), np.concatenate((f, firsts[new])), np.concatenate((c, ids[new]))
                best = _best(s, f, c, most)
                kept[i] = s[best], f[best], c[best]
        for item, (s, f, c) in zip(items, kept):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.full(len(c), item)), pa.array(s), pa.array(f)], names=["class_id", "item_id", "score", "first"])

    return classes.select("class_id", "first", "m", "bag").mapInArrow(run, "class_id long, item_id long, score long, first long")


def _limited(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; tasks cut their own rows first, and groups are salted before they meet."""
    for keys in ([*by, "_salt"], by):
        df = df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)
    return df.drop("_salt")


def rank(docs: DataFrame, items: DataFrame, most: int = MOST, broadcast_bytes: int = BROADCAST_BYTES, hash_mask: int = -1) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each item, and class_id, which documents of one bag share.

    `hash_mask` leaves some bits of the hash alone; the result does not depend on it.
    """
    spark = docs.sparkSession
    wanted = materialize(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")), "item-terms")
    empty = spark.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("t"))
    vocabulary = materialize(wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")).unionByName(empty), "vocabulary")
    rows = materialize(bags(docs, vocabulary, broadcast_bytes), "bags")
    n_docs, n_terms = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("bag.t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    w = F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = materialize(wanted.join(vocabulary, "term").join(df, "t").select("item_id", "t", w.alias("w")), "weights")

    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    code = F.xxhash64("bag", "m").bitwiseAND(F.lit(hash_mask).cast("long"))
    bagged = rows.where((F.size("bag") > 0) & F.col("doc_id").isNotNull()).withColumn("m", m).withColumn("code", code)
    classes = bagged.groupBy("code", "m", "bag").agg(F.min("_row").alias("class_id"), F.min("doc_id").alias("first"))
    classes = materialize(classes, "classes")

    path, blocks = new_path(spark, "best"), _blocks(weights)
    for k in range(blocks):
        block = weights.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        found = _score(classes, block, most) if block else spark.createDataFrame([], "class_id long, item_id long, score long, first long")
        found.write.mode("append").parquet(path)
    best = spark.read.schema("class_id long, item_id long, score long, first long").parquet(path)
    best = materialize(_limited(best.withColumn("_salt", F.pmod("class_id", F.lit(SALTS))), ["item_id"], [F.desc("score"), F.col("first"), F.col("class_id")], most).select("item_id", "class_id", "score"), "best-classes")

    needed = classes.join(best.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "code", "m", "bag")
    twice = classes.groupBy("code", "m").agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
    members = bagged.select("code", "m", "doc_id", "_row")
    if twice.isEmpty():
        members = members.join(needed.drop("bag"), ["code", "m"])
    else:  # a hash of two bags: the bags themselves decide
        members = bagged.select("code", "m", "bag", "doc_id", "_row").join(needed, ["code", "m", "bag"])
    members = _limited(members.select("class_id", "doc_id", "_row", F.pmod("_row", F.lit(SALTS)).alias("_salt")), ["class_id"], [F.col("doc_id"), F.col("_row")], most).select("class_id", "doc_id", "_row")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "_row")
    listed = best.join(members, "class_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return listed.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "class_id")
