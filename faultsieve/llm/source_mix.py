"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

The schedule has one slot for each block of words of the mix. Slot i has the point frac(i * golden ratio), in whole numbers of
45 bits; the point falls into one source's part of the cumulative targets, and that alone gives the slot to the source. Slots
are ranked within their source, and slot k of a source takes block k of the source's documents, which stand in a shuffled order
(by a hash of id and text) and are gone over again from the start, at most three times. Nothing else decides what is taken: a
source gets the blocks of the slots that its part of the line was hit by, so the words taken differ from its target by the
discrepancy of the points, a few blocks. A block has a 2**18th of all words, from 1 to `BLOCK_WORDS`.

Ranks and running sums are taken in chunks (ranges of sources, leading digits of the shuffle hash, runs of slots), then the
chunks' sums are added up, so that neither a source with most rows nor a great number of sources is a single task.

Defined cases: null texts have size 0; a null source is a source, the last; sources without words have target 0; documents
without words are taken 0 times and have no slot; repeated rows each get a row (and may differ in taken by one pass); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running, word_count

BLOCK_WORDS, SLOTS = 1024, 1 << 18
MOST_PASSES = 3
SEED = 20_24
#: The golden ratio's fraction in 45 bits.
TURN_BITS = 45
TURN = 1 << TURN_BITS
GOLDEN = (math.isqrt(5 << 2 * TURN_BITS) - TURN) // 2
SLOTS_PER_CHUNK = 1 << 16
DOCS_PER_CHUNK = 1_000
GRID = 4096


def block_words(total: int) -> int:
    return min(BLOCK_WORDS, max(1, total // SLOTS))


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to sources (source_size, weight): shares of the whole by weight, none above three times its size."""
    total, weight = sources.agg(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    level = total / weight if weight else 0.0
    cap = MOST_PASSES * F.col("source_size")
    while weight:
        full, rest = sources.agg(F.sum(F.when(cap <= level * F.col("weight"), cap)), F.sum(F.when(cap > level * F.col("weight"), F.col("weight")))).first()
        new = (total - (full or 0)) / rest if rest else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def sources_of(sized: DataFrame) -> DataFrame:
    """Sources by code point, null last, with number, weight (1, 2, 3, repeating), size, target and range, the chunk they stand in."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranges = materialize(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumns({"range": F.spark_partition_id(), "all": F.lit(0)}), "mix-ranges")
    ranked = running(ranges, "all", "range", [F.col("source").asc_nulls_last()], F.lit(1), "sid").withColumn("sid", F.col("sid") + 1)
    return targets(materialize(ranked.withColumn("weight", (F.col("sid") - 1) % 3 + 1), "mix-sources"))


def point(slot: Column) -> Column:
    """frac(slot * golden ratio) in 45 bits, in two halves of the factor so that no product leaves 64 bits for slots below 2**40."""
    half = 22
    high, low = GOLDEN >> (TURN_BITS - half), GOLDEN & ((1 << TURN_BITS - half) - 1)
    return (((slot % (1 << half)) * high % (1 << half)) * (1 << TURN_BITS - half) + slot * low) % TURN


def parts_of(sources: DataFrame) -> DataFrame:
    """sid, lo and hi of each source's part of the line of 2**45 points, in proportion to its target in whole words."""
    whole = sources.withColumn("words", F.round("target").cast("long"))
    all_ = whole.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] or 1
    ends = running(whole, "all", "range", [F.col("sid")], F.col("words"), "before")
    share = lambda c: F.expr(f"cast(({c}) as decimal(20, 0)) * cast({TURN} as decimal(15, 0)) div cast({all_} as decimal(20, 0))")
    return ends.select("sid", share("before").alias("lo"), share("before + words").alias("hi")).where("hi > lo")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, k): the source that each slot's point falls to, and the rank of the slot within it."""
    spark = sources.sparkSession
    parts = materialize(parts_of(sources), "mix-parts")
    step = TURN // max(GRID, 1 << max(1, parts.count() * 2 - 1).bit_length())
    grid = parts.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") / step))
    drawn = points.join(grid, "cell").where("u >= lo and u < hi").select("slot", "sid", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    return materialize(running(drawn, "sid", "chunk", [F.col("slot")], F.lit(1), "k").select("slot", "sid", "k"), "mix-slots")


def plan(docs: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's shuffled order, and the pieces of documents that the slots take.

    Documents: doc_id, source, tie (a hash of the text), size, sid, source_size, target, start. Pieces: slot, sid, k, start,
    pass, doc_id, first and words, the part of the document that block k of the source holds.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"))
    sized = materialize(sized, "mix-sizes")
    sources = materialize(sources_of(sized), "mix-targets")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block or block_words(total)
    digits = max(1, math.ceil(math.log(max(1, n / DOCS_PER_CHUNK), 16)))
    known = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target")
    own = sized.join(known, sized.source.eqNullSafe(known._source)).drop("_source").withColumn("_u", F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie")))
    own = own.withColumn("chunk", F.substring("_u", 1, digits))
    placed = running(own, "sid", "chunk", [F.col("_u"), F.col("doc_id"), F.col("size")], F.col("size"), "start").drop("chunk", "_u")
    placed = materialize(placed, "mix-places")
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    passes = placed.where("size > 0").withColumn("pass", F.explode(F.array(*[F.lit(p).cast("long") for p in range(MOST_PASSES)]))).withColumn("begin", begin)
    passes = passes.withColumn("end", F.col("begin") + F.col("size"))
    held = passes.withColumn("k", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    held = held.select("sid", "k", "start", "pass", "doc_id", (F.greatest("begin", F.col("k") * block) - F.col("begin")).alias("first"), (F.least("end", (F.col("k") + 1) * block) - F.greatest("begin", F.col("k") * block)).alias("words"))
    return placed, held.join(schedule(sources, math.ceil(total / block)), ["sid", "k"])


def mix(docs: DataFrame, block: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (the words the mix takes, repeats counted), slot (the first), source, tie."""
    placed, pieces = plan(docs, block)
    taken = pieces.groupBy("sid", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    some = placed.where("size > 0").join(taken, ["sid", "start"], "left")
    rows = some.unionByName(placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slot": F.lit(None).cast("long")}))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "slot", "source", "tie")


def mixture(docs: DataFrame, block: int | None = None) -> DataFrame:
    """The mix as documents, in the order of their slots: each row of docs once for each pass that takes half of its words or more."""
    placed, pieces = plan(docs, block)
    taken = pieces.groupBy("sid", "start", "pass").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    some = placed.where("size > 0").join(taken, ["sid", "start"])
    copies = some.groupBy("doc_id", "source", "tie", "pass").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.min("slot").alias("slot")).where("2 * taken >= size")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    same = own.id.eqNullSafe(copies.doc_id) & own["from"].eqNullSafe(copies.source) & (own["hash"] == copies.tie)
    return own.join(copies, same).select("row", "slot").repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")
