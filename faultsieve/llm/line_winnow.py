"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window begins at each line of a document and takes as many following lines as it needs to hold `MIN_WORDS` words. Its least
line, by tier (longer lines first) and hash, the leftmost of equal ones, is its fingerprint. Neighbouring windows mostly share
theirs, and only lines chosen so are kept, each with the hashes of the lines beside it that a run of which it is the fingerprint
may begin or end with. Equal runs of `MIN_WORDS` words hold equal windows, and those choose the same line, so whatever occurs
twice is found where one fingerprint stands at two positions.

Positions meet by fingerprint alone. Those of one fingerprint with equal lines beside them fall into a class first, so that
copies are not compared: all but the first position of a class, in the order of doc_id and line, repeat all that was kept of
it. The first positions of the classes of a fingerprint are then compared with the earlier ones: from the two lines the match is
extended to both sides while line hashes agree, and is a repeat if it reaches `MIN_WORDS` words. Where a fingerprint has more than `CLASSES`
classes, comparing each with each would grow with the square; there the runs around the fingerprint that begin or end as a window does
are put in groups, and all but the first of a group are repeats, which finds the same. What lies
further off is matched from another fingerprint. All lines of a later match are deleted, so of each repeated run the first occurrence stays.

Defined cases: lines end at a line feed and count as equal if their bytes are; a line without words weighs one word; a
null or empty text, and a text of fewer words than a window, has nothing deleted; a text whose lines are all deleted
becomes empty and its row stays; rows with equal doc_id and equal text are one document and get the same result; null
doc_ids stand first; extra columns are kept by `drop_repeats`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize

MIN_WORDS = 50
#: Classes of a fingerprint that are compared with each other; more are grouped by the runs around it.
CLASSES = 64
#: Lines of fewer words are chosen only where a window holds no longer one: short lines stand in many places.
SHORT = 8
#: Parts that the classes of one fingerprint are dealt to when they are counted.
SALTS = 8
PLACE = ["doc", "tie", "pos"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line: doc, tie (hash of the text), pos, h (hash of the line), before (words of the lines before)."""
    split = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.greatest(F.regexp_count(x, F.lit(WORD)), F.lit(1)).alias("w")))
    rows = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("tie"), F.posexplode(split).alias("pos", "line"))
    rows = rows.select("doc", "tie", "pos", "line.h", "line.w")
    once = rows.repartition("doc", "tie").groupBy("doc", "tie", "pos").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    up = W.partitionBy("doc", "tie").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return once.withColumn("before", F.sum("w").over(up) - F.col("w"))


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The chosen lines: doc, tie, pos, mark (the line's hash), w (its words), left and right (h and w of lines beside it, nearest first)."""
    by = W.partitionBy("doc", "tie").orderBy("before")
    ahead, back = by.rangeBetween(W.currentRow, min_words - 1), by.rangeBetween(1 - min_words, W.currentRow)
    tier = F.when(F.col("w") >= min_words, 0).when(F.col("w") >= SHORT, 1).otherwise(2)
    line = F.struct("h", "w")
    rows = _lines(docs).withColumns({
        "least": F.min(F.struct(tier.alias("tier"), "h", "before")).over(ahead), "words": F.sum("w").over(ahead), "_ahead": F.collect_list(line).over(ahead),
        "left": F.collect_list(line).over(by.rangeBetween(1 - min_words, -1)),
    })
    # a run that ends behind the window may take all that fits into one from the next line on
    rows = rows.withColumns({"right": F.lead("_ahead").over(by), "_chosen": F.collect_list(F.when(F.col("words") >= min_words, F.col("least.before"))).over(back)})
    rows = rows.where(F.array_contains("_chosen", F.col("before")))
    return rows.select(*PLACE, F.col("h").alias("mark"), "w", F.reverse("left").alias("left"), F.coalesce("right", F.array().cast("array<struct<h:bigint,w:int>>")).alias("right"))


def _without(rows: DataFrame, firsts: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose place is in none of firsts."""
    firsts = firsts.select(*[F.col(c).alias(f"_{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(firsts.hint("merge"), same, "left_anti")


#: Offsets of the lines that x has in common with y around their fingerprint, or null if they have too few words.
_MATCH = """
    transform(array(named_struct(
        'a', coalesce(nullif(array_position(zip_with(x.left, y.left, (p, q) -> coalesce(p.h <> q.h, true)), true), 0) - 1, size(x.left)),
        'b', coalesce(nullif(array_position(zip_with(x.right, y.right, (p, q) -> coalesce(p.h <> q.h, true)), true), 0) - 1, size(x.right)))),
      s -> if(x.w + aggregate(slice(x.left, 1, cast(s.a as int)), 0L, (n, l) -> n + l.w) + aggregate(slice(x.right, 1, cast(s.b as int)), 0L, (n, l) -> n + l.w) >= {least},
        named_struct('a', cast(s.a as int), 'b', cast(s.b as int)), null))[0]
"""

#: Offsets of the runs around a fingerprint that are no longer than they need be at one end.
_RUNS = """
    filter(flatten(transform(sequence(0, size(left)), a -> transform(sequence(0, size(right)), b -> named_struct('a', a, 'b', b,
        'words', w + aggregate(slice(left, 1, a), 0L, (n, l) -> n + l.w) + aggregate(slice(right, 1, b), 0L, (n, l) -> n + l.w),
        'first', if(a = 0, w, get(left, a - 1).w), 'last', if(b = 0, w, get(right, b - 1).w))))),
      r -> r.words >= {least} and (r.words - r.first < {least} or r.words - r.last < {least}))
"""


def _compared(few: DataFrame, min_words: int) -> DataFrame:
    """Spans (doc, tie, pos, a, b) of first positions that match an earlier one of their mark; a mark has up to CLASSES of them."""
    groups = few.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct(*PLACE, "w", "left", "right"))).alias("g"))
    match = f"filter(transform(slice(g, 1, i), y -> {_MATCH.format(least=min_words)}), s -> s is not null)"
    found = groups.select(F.explode(F.expr(f"transform(g, (x, i) -> named_struct('doc', x.doc, 'tie', x.tie, 'pos', x.pos, 'spans', array_distinct({match})))")).alias("x"))
    return found.select("x.doc", "x.tie", "x.pos", F.explode("x.spans").alias("s")).select(*PLACE, "s.a", "s.b")


def _grouped(many: DataFrame, min_words: int) -> DataFrame:
    """The same for marks of any number of classes, by the runs around them."""
    rows = many.withColumn("r", F.explode(F.expr(_RUNS.format(least=min_words))))
    beside = [F.slice("left", 1, F.col("r.a")), F.slice("right", 1, F.col("r.b"))]
    rows = materialize(rows.select(*PLACE, "mark", "r.a", "r.b", F.xxhash64(*beside).alias("x"), F.hash(*beside).alias("y")), "winnow-runs-of-marks")
    firsts = rows.groupBy("mark", "a", "b", "x", "y").agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*", "a", "b")
    return _without(rows.select(*PLACE, "a", "b"), firsts, [*PLACE, "a", "b"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of lines to delete: doc, tie, runs (array of first and last line, apart and in order)."""
    chosen = materialize(fingerprints(docs, min_words), "winnow-fingerprints")
    beside = [F.size("left"), F.col("left"), F.col("right")]
    narrow = chosen.select(*PLACE, "mark", F.size("left").alias("a"), F.size("right").alias("b"), F.xxhash64(*beside).alias("x"), F.hash(*beside).alias("y"))
    firsts = materialize(narrow.groupBy("mark", "x", "y").agg(F.min(F.struct(*PLACE)).alias("first")).select("first.*", "mark"), "winnow-classes")
    copies = _without(narrow.select(*PLACE, "a", "b"), firsts, PLACE)

    counts = firsts.groupBy("mark").agg(F.count("*").alias("classes")).where("classes > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = firsts.withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).cast("int")).join(counts, ["mark", "salt"])
    shared = shared.select(*[F.col(c).alias(f"_{c}") for c in PLACE], "classes")
    contested = materialize(chosen.join(shared.hint("merge"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")) & (F.col("pos") == F.col("_pos"))).select(*chosen.columns, "classes"), "winnow-shared")
    spans = copies.unionByName(_compared(contested.where(F.col("classes") <= CLASSES), min_words)).unionByName(_grouped(contested.where(F.col("classes") > CLASSES), min_words))
    spans = spans.select("doc", "tie", (F.col("pos") - F.col("a")).alias("lo"), (F.col("pos") + F.col("b")).alias("hi"))
    by = W.partitionBy("doc", "tie").orderBy("lo", "hi")
    apart = spans.distinct().withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    runs = apart.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy("doc", "tie", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def _with_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """row (all columns of docs), text, and runs to delete or null."""
    found = materialize(repeats(docs, min_words), "winnow-runs")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    # runs grow with the input and are not to be broadcast, so texts are always dealt by document
    return own.join(found.hint("merge"), own.id.eqNullSafe(found.doc) & (own["hash"] == found.tie), "left").select("row", F.col("row.text").alias("text"), "runs")


def _kept_lines() -> Column:
    """Lines of text outside of the runs: the pieces between them, so that the work is that of the text once."""
    lines, runs = F.split("text", "\n"), F.col("runs")
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r.hi + 1))
    ends = F.concat(F.transform(runs, lambda r: r.lo), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs of lines taken out of text; n_chars, if it is there, follows, other columns stay."""
    rows = _with_runs(docs, min_words).withColumn("left", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(), "\n")))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("runs").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("left")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and text (what stays) for each row of docs."""
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + (r.hi - r.lo + 1).cast("int"))
    text = F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept_lines(), "\n"))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    return _with_runs(docs, min_words).select(F.col("row.doc_id").cast("long").alias("doc_id"), lines.alias("n_lines"), F.coalesce(gone, F.lit(0)).alias("n_deleted"), text.alias("text"))
