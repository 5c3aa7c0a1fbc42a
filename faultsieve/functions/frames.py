"""Steps over whole DataFrames that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

IDS_PER_RANGE = 4096


def positions(rows: DataFrame, name: str, *by: str, to: str = "position") -> DataFrame:
    """Adds the place of each row in the order of the whole number `name`, from 1, within the groups of `by`.

    Places are counted within ranges of numbers, then shifted by the rows of the ranges before, so that a group with most
    rows is no single task. Rows without a number have no place; null is a group.
    """
    keys = [*by, "_range"]
    cut = rows.withColumn("_range", F.floor(F.col(name) / IDS_PER_RANGE))
    up = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = cut.where("_range is not null").groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(up) - F.col("_n"))
    before = sums.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], "_before")
    own = cut.where("_range is not null").withColumn("_own", F.row_number().over(W.partitionBy(*keys).orderBy(name)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)])
    counted = own.join(before, same).withColumn(to, F.col("_own") + F.col("_before"))
    rest = cut.where("_range is null").withColumn(to, F.lit(None).cast("bigint"))
    return counted.select(*rows.columns, to).unionByName(rest.select(*rows.columns, to))


def one_row(*parts: DataFrame) -> DataFrame:
    """Single rows with different columns as one row."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
