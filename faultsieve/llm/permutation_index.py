"""Approximate nearest neighbours with a permutation index.

Pivots are vectors of a bounded sample, those with the least hashes. Every distinct vector is represented by its `PREFIX`
nearest pivots in order. The index is dealt into shards of about `SHARD` vectors; each shard posts its vectors, with the
places of the pivots, in one inverted file per pivot. A query block meets each shard in one task: the files of a query's
`QUERY_PREFIX` nearest pivots add up to the footrule distance of the two orders as far as those pivots go (a pivot outside a
vector's prefix counts as at its end), the best of the shard are ranked again by the exact inner product in double precision, and the best of all shards are merged. In all shards
together about `BREADTH` times the root of the number of vectors are ranked again, a share that falls as the table grows. Lengths
are taken into account by one more coordinate that brings all vectors to equal length. A query is scaled to length 1 and has
zero there, so that the points nearest to it are those with the greatest inner products.

Equal vectors are one entry with their smallest ids, at most one more than asked for, so a group of copies is neither a
large posting nor many equal queries.

Defined cases: null or zero vectors and those with null or non-finite components take no part, as queries or candidates, nor
do null ids and vectors of another length than most; with fewer candidates than asked for, all are returned; ties go to the
smaller vec_id; rows that repeat id and vector count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

PIVOTS = 1024
PREFIX = 256
QUERY_PREFIX = 128
SHARD = 8192
QUERY_BLOCK = 16384
BREADTH = 5.0
TOP = 20


def candidates_of(n: int, shards: int, breadth: float = BREADTH) -> int:
    """How many vectors of each shard are ranked again for a query: its part of breadth * sqrt(n), and three deviations more."""
    mean = breadth * math.sqrt(n) / shards
    return math.ceil(mean + 3 * math.sqrt(mean)) if shards > 1 else math.ceil(mean)


def entries(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """Distinct vectors: rep (smallest id), v (array of double), ids (the smallest, at most top + 1)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("v")).withColumn("d", F.size("v"))
    most = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.col("d") == (most["d"] if most else 0)).drop("d").withColumn("key", F.xxhash64("v"))
    rank = F.dense_rank().over(W.partitionBy("key", "v").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= top + 1)
    return few.groupBy("key", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids")


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest length, with a coordinate that makes them unit vectors."""
    v = v / longest
    return np.column_stack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))])


def _asked(v: np.ndarray) -> np.ndarray:
    """Vectors over their own lengths, with a coordinate of zero."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return np.column_stack([v / np.sqrt((v * v).sum(axis=1, keepdims=True)), np.zeros(len(v))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    near = -(v @ pivots.T)
    part = np.argpartition(near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(v), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(near, part, axis=1), axis=1, kind="stable"), axis=1)


def represent(found: DataFrame, pivots: np.ndarray, lift: Callable[[np.ndarray], np.ndarray], prefix: int) -> DataFrame:
    """Adds near, the numbers of the nearest pivots to the lifted vectors in order, to entries (rep, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(lift(_matrix(batch.column(1))), pivots, prefix)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in near.astype(np.int16)], pa.binary())], names=["rep", "v", "near"])

    return found.select("rep", "v").mapInArrow(run, "rep long, v array<double>, near binary")


def _search(prefix: int, n_pivots: int, candidates: int, keep: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "rep", "score"]
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        shard = shard.sort_values("rep", kind="stable")
        n, ids, v = len(shard), shard["rep"].to_numpy(), np.stack(shard["vector"].to_numpy())
        pivots = np.frombuffer(b"".join(shard["pivots"]), np.int16)
        # the inverted files: for each pivot and vector how far the pivot stands from the end of the vector's prefix
        files = np.zeros((n_pivots, n), np.uint16)
        files[pivots, np.repeat(np.arange(n), prefix)] = np.tile(np.arange(prefix, 0, -1, dtype=np.uint16), n)
        out, both, shared = [], np.empty(n, np.uint16), np.empty(n, np.uint16)
        for query, q, near in zip(queries["query"], queries["q"], queries["q_pivots"]):
            # the footrule distance falls by twice the sum over pivots of the lesser of the two distances from the end
            shared[:] = 0
            for a, p in enumerate(np.frombuffer(near, np.int16)):
                np.minimum(files[p], np.uint16(prefix - a), out=both)
                np.add(shared, both, out=shared)
            few = min(n, candidates)
            least = np.partition(shared, n - few)[n - few]
            above, level = np.flatnonzero(shared > least), np.flatnonzero(shared == least)
            chosen = np.concatenate([above, level[: few - len(above)]])
            score = v[chosen] @ q
            best = np.lexsort((ids[chosen], -score))[:keep]
            out.append((np.full(len(best), query), ids[chosen][best], score[best]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    return run


def search(vectors: DataFrame, top: int = TOP, every: int = 20, n_pivots: int = PIVOTS, prefix: int = PREFIX, shard: int = SHARD, breadth: float = BREADTH, query_prefix: int = QUERY_PREFIX) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of the rows whose vec_id is divisible by every."""
    found = materialize(entries(vectors, top), "ann-entries")
    n, longest = found.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    sample = [r["v"] for r in found.orderBy(F.xxhash64("rep"), "rep").select("v").limit(n_pivots).collect()]
    prefix, n_pivots = min(prefix, max(1, len(sample))), max(1, len(sample))
    pivots = _lifted(np.array(sample, dtype=float).reshape(len(sample), -1), longest) if sample else np.zeros((1, 1))
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("v")).where(F.col("query_id") % every == 0)
    asked = materialize(asked.join(found.select("rep", "v"), "v").select("query_id", F.col("rep").alias("query")).distinct(), "ann-asked")
    index = materialize(represent(found, pivots, lambda v: _lifted(v, longest or 1.0), prefix), "ann-index")
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(n / QUERY_BLOCK / max(1, every) * 2))
    dealt = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    side = index.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"), dealt(blocks).alias("block"), "rep", F.col("v").alias("vector"), F.col("near").alias("pivots"))
    own = represent(found.join(asked.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi"), pivots, _asked, min(query_prefix, prefix))
    queries = own.select(dealt(shards).alias("shard"), F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).alias("block"), F.col("rep").alias("query"), F.col("v").alias("q"), F.col("near").alias("q_pivots"))
    met = queries.groupBy("shard", "block").cogroup(side.groupBy("shard", "block")).applyInPandas(_search(prefix, n_pivots, max(top + 1, candidates_of(n, shards, breadth)), top + 1), "query long, rep long, score double")
    w = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    merged = materialize(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top + 1), "ann-merged")
    # the copies of each vector found, then the best ids by score; one more than asked for, as the query itself goes
    ids = merged.join(found.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    best = ids.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    rows = asked.join(lists, "query").select("query_id", F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, top).alias("best"))
    return rows.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), "b.vec_id", "b.score")
