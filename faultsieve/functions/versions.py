"""Release numbers and Python requirements as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

VERSION = r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)[-_.]?((?:a|b|c|rc|alpha|beta|pre|preview)[-_.]?\d*)?(?:(?:[-_.]?(?:post|rev|r)[-_.]?(\d*))|-(\d+))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+.*)?$"


def _group(c: Column, n: int) -> Column:
    return F.regexp_extract(F.lower(c), VERSION, n)


def numbers(c: Column) -> Column:
    """Parts of a dotted number as an array."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))


def trimmed(parts: Column) -> Column:
    """Parts without the zeros at their end, so that arrays compare as release numbers of any length."""
    last = F.array_position(F.transform(F.reverse(parts), lambda x: x != 0), True)
    return F.when(last > 0, F.slice(parts, F.lit(1), (F.size(parts) - last + 1).cast("int"))).otherwise(F.slice(parts, 1, 0))


def is_version(c: Column) -> Column:
    return F.lower(c).rlike(VERSION)


def is_pre_release(c: Column) -> Column:
    return (_group(c, 3) != "") | (_group(c, 6) != "")


def version_key(c: Column) -> Column:
    """A struct that sorts versions: epoch, release, phase (dev alone, a, b, rc, final) and its number, post number, dev number (none is last)."""
    parts = F.struct(*[_group(c, i).alias(n) for i, n in enumerate(("epoch", "release", "pre", "post", "bare", "dev", "dev_number"), 1)], F.lower(c).alias("text"))

    def key(v: Column) -> Column:
        number = lambda x, missing: F.coalesce(x.try_cast("bigint"), F.lit(missing))
        letter, dev = F.substring(v.pre, 1, 1), v.dev != ""
        post = F.when(v.post != "", v.post.try_cast("bigint")).when(v.bare != "", v.bare.try_cast("bigint")).when(v.text.rlike(r"(post|rev|\dr)\d*"), 0).otherwise(-1)
        phase = F.when(letter == "a", 1).when(letter == "b", 2).when(letter != "", 3).when(dev & (post < 0), 0).otherwise(4)
        return F.struct(
            number(v.epoch, 0).alias("epoch"), trimmed(numbers(v.release)).alias("release"), phase.alias("phase"), number(F.regexp_extract(v.pre, r"(\d+)$", 1), 0).alias("number"),
            post.cast("bigint").alias("post"), F.when(dev, number(v.dev_number, 0)).otherwise((1 << 63) - 1).alias("dev"),
        )

    return let(parts, key)


def python_compatibility(requires: Column, python: Column) -> Column:
    """compatible, incompatible, or unknown if either is missing."""
    full = numbers(python)
    own = trimmed(full)
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    first = lambda parts, n: F.slice(F.concat(parts, zeros(n)), F.lit(1), n)

    def clause(x: Column) -> Column:
        x = F.regexp_replace(x, r"\s", "")
        op = F.regexp_extract(x, r"^(===|~=|==|!=|<=|>=|<|>)", 1)
        number = F.regexp_replace(x, r"^[=~!<>]+", "")
        wild = number.endswith(".*")
        base = F.regexp_replace(number, r"\.\*$", "")
        parts = numbers(base)
        other, depth = trimmed(parts), F.size(parts)
        starts = first(full, depth) == parts
        near = first(full, F.greatest(depth - 1, F.lit(1))) == first(parts, F.greatest(depth - 1, F.lit(1)))
        return (
            F.when(op == "===", python == number).when(op == "==", F.when(wild, starts).otherwise(own == other)).when(op == "!=", F.when(wild, ~starts).otherwise(own != other))
            .when(op == "~=", (own >= other) & near).when(op == "<=", own <= other).when(op == ">=", own >= other).when(op == "<", own < other).when(op == ">", own > other).otherwise(False)
        )

    fits = F.forall(F.filter(F.split(requires, ","), lambda x: F.trim(x) != ""), clause)
    return F.when(python.isNull() | (F.coalesce(F.trim(requires), F.lit("")) == ""), "unknown").when(fits, "compatible").otherwise("incompatible")
