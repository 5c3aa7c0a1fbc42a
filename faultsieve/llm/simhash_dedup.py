"""SimHash near-duplicates: segment popcounts, a grid range join under Manhattan distance, exact verification.

A fingerprint of 64 bits maps to its bit counts in 32 segments of two bits. The Manhattan distance of two count vectors
never exceeds the Hamming distance of the fingerprints. At a Hamming distance of 3 or less, one of the two halves of
the vector (16 segments) is within Manhattan distance 1: it is equal, or one segment differs by one. So each distinct
fingerprint is posted in the grid cell of each half and probes the cells that lie one lower in one segment. Fingerprints
that meet in a cell are compared exactly.

Cells with more than `HOT_CELL` rows are cut into blocks; each pair of blocks is one task that compares its members with
numpy and returns a spanning forest of the links, so neither the memory of a task nor the rows made grow with the square
of a cell. Every comparison is made; only redundant links within a block are left out, which no component needs.

Defined cases: a null or wordless text has fingerprint zero and links like any other; texts of fewer words than a shingle
are one shingle; repeated rows each get a row; a null doc_id gets a row, and counts for no component_id (null if no
member has an id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

SEED = 42
MAX_BITS = 3
HOT_CELL = 64
BLOCK = 2048


def simhash(words: list[bytes], shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 values."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that are set in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t.lower().split(), shingle) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _forest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks, as a spanning forest."""
    fp = pdf["fp"].to_numpy(np.int64)
    nodes, index = np.unique(fp, return_inverse=True)
    left = np.unique(index[pdf["as_left"].to_numpy(bool)])
    right = np.unique(index[pdf["as_right"].to_numpy(bool)])
    codes = nodes.view(np.uint64)
    label = np.arange(len(nodes))
    out: list[tuple[int, int]] = []
    for i in left:
        near = right[np.bitwise_count(codes[right] ^ codes[i]) <= MAX_BITS]
        apart = near[label[near] != label[i]]
        while len(apart):
            j = apart[0]
            out.append((nodes[i], nodes[j]))
            label[label == label[j]] = label[i]
            apart = apart[label[apart] != label[i]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at a Hamming distance of 3 or less, enough for all components."""
    rows = prints.select("fp").where("fp is not null").distinct()
    parts = []
    for half in (0, 1):
        x = (F.col("fp") if half == 0 else F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        c = x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))  # each two bits hold their count of 0 to 2
        base = F.array(F.struct((c * 2 + half).alias("cell"), F.lit(True).alias("base")))
        lower = F.filter(
            F.array(*[
                F.when(F.shiftright(c, 2 * j).bitwiseAND(F.lit(3)) > 0, F.struct(((c - (1 << 2 * j)) * 2 + half).alias("cell"), F.lit(False).alias("base")))
                for j in range(16)
            ]),
            lambda x: x.isNotNull(),
        )
        parts += [base, lower]
    # one row becomes about 25, so few large partitions are dealt anew before, by a key of their own: as they lie by fp, dealing by fp does nothing
    posted = rows.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")).select("fp", F.explode(F.concat(*parts)).alias("p")).select("p.cell", "p.base", "fp")
    w = W.partitionBy("cell")
    met = posted.withColumns({"n": F.count("*").over(w), "bases": F.count_if("base").over(w)}).where("n > 1 and bases > 0").drop("bases")
    met = materialize(met, "simhash-cells")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS
    few = met.where(F.col("n") <= HOT_CELL)
    plain = (
        few.where("base").alias("l")
        .join(few.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (~F.col("r.base") | (F.col("l.fp") < F.col("r.fp"))) & near & (F.col("l.fp") != F.col("r.fp")))
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    blocks = F.ceil(F.col("n") / BLOCK)
    hot = met.where(F.col("n") > HOT_CELL).withColumns({"of": blocks, "own": F.pmod(F.xxhash64("fp"), blocks)})
    every = F.sequence(F.lit(0).cast("long"), F.col("of") - 1)
    left = hot.where("base").withColumn("j", F.explode(every)).select("cell", F.col("own").alias("i"), "j", "fp", F.lit(True).alias("as_left"), (F.col("own") == F.col("j")).alias("as_right"))
    right = hot.withColumn("i", F.explode(every)).where("not base or i <> own").select("cell", "i", F.col("own").alias("j"), "fp", F.lit(False).alias("as_left"), F.lit(True).alias("as_right"))
    blocked = left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(_forest, "a long, b long")
    return plain.unionByName(blocked)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node of its component.

    Rounds of large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    was = state(e)
    while was["n"]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "links")
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links, for each row of docs."""
    prints = materialize(fingerprints(docs), "simhash")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    found = components(links(first))
    nodes = found.join(first, found.node == first.fp).select("fp", "root", "first")
    least = nodes.groupBy("root").agg(F.min("first").alias("least"))
    linked = nodes.join(least, "root").select("fp", "least")
    owner = first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    owner = materialize(owner, "simhash-owner")
    return prints.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
