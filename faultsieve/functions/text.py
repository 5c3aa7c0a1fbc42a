"""Text functions as columns, with the white space of Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def filled(c: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(c, F.lit(""))


def truncate_with_marker(c: Column, most: int = 12_000) -> Column:
    return F.when(c.isNull(), "").when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("\n...[truncated]")))


def split_paths(c: Column) -> Column:
    """Items of a list with semicolons, stripped, without blank ones."""
    return F.filter(F.transform(F.split(filled(c), ";"), strip), lambda p: p != "")


def normalize_distribution(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-_.]+", "-")


def or_missing(c: Column, missing: str = "Not available") -> Column:
    """Stripped text, or the words for a gap."""
    text = strip(filled(c.cast("string")))
    return F.when(text == "", missing).otherwise(text)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: later uses read it and are not merged with its expression."""
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, within an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


_KEPT: dict[tuple, Column] = {}


def kept(df: DataFrame, key: tuple, build: Callable[[], Column]) -> Column:
    """An expression over columns named in key, built once for an application: large ones take a second to put together."""
    full = (df.sparkSession.sparkContext.applicationId, *key)
    if full not in _KEPT:
        _KEPT[full] = build()
    return _KEPT[full]
