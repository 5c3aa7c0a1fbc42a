"""The flat dataset of dependency failures and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import one_row, positions
from ..functions.text import once
from ..sources.storage import scan_dependency_errors
from .rules import DEV_IDS, assign_split, classify_refined, classify_subtype, extract_failing_module

SPLITS = ["dev", "evaluation", "excluded"]
# Rows of each refined subtype in a validation sample; others are taken whole.
SAMPLE_LIMITS = {"missing_package": 10, "wrong_version": 10, "system_library": 5}


def dataset(executions: DataFrame) -> DataFrame:
    """Dependency failures with module, subtype, scope and split: 18 columns."""
    rows = once(scan_dependency_errors(executions), "failing_module", extract_failing_module(F.col("error_message")))
    rows = once(rows, "_c", classify_subtype(F.col("error_type"), F.col("error_message"), F.col("failing_module")))
    rows = rows.select("*", "_c.*").drop("_c").withColumn("split", assign_split(F.col("notebook_execution_id"), F.col("scope_status")))
    return rows.select(*[c for c in rows.columns if c != "created_at"], "created_at")


def refined(data: DataFrame) -> DataFrame:
    """Adds refined_subtype, confidence and root_cause_hint to the dataset."""
    rule = classify_refined(F.col("error_type"), F.col("error_message"), F.col("failing_module"), F.col("subtype"))
    return once(data, "_r", rule).select("*", "_r.*").drop("_r")


def value_counts(data: DataFrame, *columns: str) -> DataFrame:
    """Counts of the values of several columns in one pass: metric, key, count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("key")) for c in columns]))
    return data.select(pairs.alias("p")).groupBy("p.metric", "p.key").agg(F.count("*").alias("count"))


def exclusion_reason_counts(data: DataFrame) -> DataFrame:
    return data.where("exclusion_reason <> ''").groupBy("exclusion_reason").agg(F.count("*").alias("count"))


def split_manifest(data: DataFrame) -> DataFrame:
    """Ids of each split in order as rows; a split without rows has one row with a null id."""
    domain = data.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    own = data.select("split", F.col("notebook_execution_id").alias("id"))
    return domain.join(positions(own, "id", "split"), "split", "left")


def top_failing_modules(data: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent modules; ties go to the one that appears first."""
    counts = data.groupBy("failing_module").agg(F.count("*").alias("count"), F.min("notebook_execution_id").alias("first_id"))
    return counts.orderBy(F.desc("count"), "first_id").limit(n)


def refinement_shift(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("subtype").alias("original_subtype"), "refined_subtype").agg(F.count("*").alias("count"))


def stratified_sample(rows: DataFrame, limits: dict[str, int] = SAMPLE_LIMITS) -> DataFrame:
    """The first rows of each refined subtype by id, up to its limit; subtypes without a limit are taken whole.

    The largest limit stands in the filter by itself, so that rows beyond it fall away before the shuffle.
    """
    limit = F.coalesce(*[F.when(F.col("refined_subtype") == k, v) for k, v in limits.items()])
    ranked = rows.where(F.col("refined_subtype").isin(list(limits))).withColumn("_n", F.row_number().over(W.partitionBy("refined_subtype").orderBy("notebook_execution_id")))
    whole = rows.where(~F.coalesce(F.col("refined_subtype").isin(list(limits)), F.lit(False)))
    return ranked.where((F.col("_n") <= max(limits.values())) & (F.col("_n") <= limit)).drop("_n").unionByName(whole)


def validation_sample(rows: DataFrame) -> DataFrame:
    """The sample as an annotator gets it, buckets in order of appearance."""
    sample = stratified_sample(rows)
    buckets = sample.groupBy("refined_subtype").agg(F.min("notebook_execution_id").alias("bucket"))
    known = buckets.withColumnRenamed("refined_subtype", "_subtype")
    return sample.join(known, F.col("refined_subtype").eqNullSafe(F.col("_subtype")), "left").select(
        "notebook_execution_id", "error_type", "error_message", "failing_module", F.col("subtype").alias("original_subtype"), "refined_subtype",
        "confidence", "root_cause_hint", "context_status", F.lit("").alias("manual_label"), F.lit("").alias("notes"), "bucket",
    )


def holdout_leaks(data: DataFrame) -> DataFrame:
    """Evaluation rows whose id is a development id; there must be none."""
    dev = data.where(F.col("notebook_execution_id").isin(DEV_IDS)).select("notebook_execution_id")
    return data.where("split = 'evaluation'").join(dev, "notebook_execution_id", "left_semi").select("notebook_execution_id")


def reason_share(executions: DataFrame) -> DataFrame:
    """Share of each error type among all executions."""
    counts = executions.groupBy("error_type").agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.round(F.col("count") / F.sum("count").over(W.partitionBy()), 6))


def label_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Observed agreement and Cohen's kappa of two label columns, from their confusion table."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("n_a"))
    right = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("n_b"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0)).alias("chance"))
    observed, expected = F.col("same") / F.col("total"), F.col("chance") / (F.col("total").cast("double") * F.col("total"))
    return one_row(total, chance).select(F.col("total").alias("n"), F.round(observed, 6).alias("observed"), F.round((observed - expected) / (1 - expected), 6).alias("kappa"))
