"""Strict JSON in columns, and the JSON object that a longer text holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def strict(c: Column) -> Column:
    """The variant of a text that is JSON and nothing more, else null.

    Spark's parser accepts text behind the first value; a text that parses within brackets and within an object, as a single
    element, has none. Repeated keys and numbers that JSON does not have (NaN, Infinity) do not parse; `loads` takes those too.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    items = F.try_variant_get(listed, "$", "array<variant>")
    return F.when(keyed.isNotNull() & (F.size(items) == 1), items[0])


#: The key of the object that stands for NaN, Infinity or -Infinity; its value is that word.
NOT_A_NUMBER = "\x01number"
_ODD = ["NaN", "Infinity", "-Infinity"]
_STRING = r'"(?:[^"\\\x00-\x1F]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
_SCALAR = rf"^(?:{_STRING}|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)$"
#: Tokens of JSON; what is no token comes out as one that no place of a text takes.
_TOKEN = r'"(?:[^"\\]|\\[\s\S])*+"|[{}\[\],:]|[^ \t\n\r"{}\[\],:]+|"'
_OPEN = "struct<kind:string,members:map<string,string>,items:string,key:string>"
_STATE = f"struct<stack:array<{_OPEN}>,phase:string,result:string>"


def _top_and_rest(stack: Column) -> tuple[Column, Column]:
    return F.try_element_at(stack, F.lit(-1)), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def _put(stack: Column, value: Column) -> Column:
    """The state behind a whole value: it ends the text, or joins the innermost open object or array; a repeated key replaces its value."""
    top, rest = _top_and_rest(stack)
    members = F.map_concat(F.map_filter(top.members, lambda k, _: k != top.key), F.create_map(top.key, value))
    grown = F.when(top.kind == "{", F.struct(top.kind.alias("kind"), members.alias("members"), F.lit("").alias("items"), F.lit("").alias("key"))).otherwise(
        F.struct(top.kind.alias("kind"), top.members.alias("members"), F.when(top["items"] == "", value).otherwise(F.concat(top["items"], F.lit(","), value)).alias("items"), F.lit("").alias("key"))
    )
    inner = F.struct(F.concat(rest, F.array(grown)).alias("stack"), F.lit("next").alias("phase"), F.lit("").alias("result"))
    whole = F.struct(stack.alias("stack"), F.lit("end").alias("phase"), value.alias("result"))
    return F.when(F.size(stack) == 0, whole.cast(_STATE)).otherwise(inner.cast(_STATE))


def _step(s: Column, x: Column) -> Column:
    """The state behind one more token; a token that cannot stand there gives a state that takes none."""
    to = lambda stack, phase: F.struct(stack.alias("stack"), phase.alias("phase"), F.lit("").alias("result")).cast(_STATE)
    opened = lambda kind: F.concat(s.stack, F.array(F.struct(kind.alias("kind"), F.create_map().cast("map<string,string>").alias("members"), F.lit("").alias("items"), F.lit("").alias("key")).cast(_OPEN)))
    top, rest = _top_and_rest(s.stack)
    inside = F.coalesce(top.kind, F.lit(""))
    takes_value, scalar = s.phase.isin("value", "first"), x.rlike(_SCALAR)
    closes_object = (x == "}") & (inside == "{") & s.phase.isin("first key", "next")
    closes_array = (x == "]") & (inside == "[") & s.phase.isin("first", "next")
    members = F.array_join(F.transform(F.map_entries(top.members), lambda e: F.concat(e.key, F.lit(":"), e.value)), ",")
    odd = F.concat(F.lit('{"\\u0001number":"'), x, F.lit('"}'))
    value = (
        F.when(closes_object, F.concat(F.lit("{"), members, F.lit("}"))).when(closes_array, F.concat(F.lit("["), top["items"], F.lit("]")))
        .when(takes_value & scalar, F.when(x.isin(_ODD), odd).otherwise(x))
    )
    key = F.when(x.contains("\\"), F.to_json(F.try_parse_json(x))).otherwise(x)
    named = F.concat(rest, F.array(F.struct(top.kind.alias("kind"), top.members.alias("members"), F.lit("").alias("items"), key.alias("key")).cast(_OPEN)))
    moved = (
        F.when(x.isin("{", "[") & takes_value, to(opened(x), F.when(x == "{", "first key").otherwise("first")))
        .when((x == ",") & (s.phase == "next"), to(s.stack, F.when(inside == "{", "key").otherwise("value")))
        .when((x == ":") & (s.phase == "colon"), to(s.stack, F.lit("value")))
        .when(x.startswith('"') & scalar & s.phase.isin("key", "first key"), to(named, F.lit("colon"))).otherwise(to(s.stack, F.lit("bad")))
    )
    put = F.transform(F.array(value), lambda v: _put(F.when(closes_object | closes_array, rest).otherwise(s.stack), v))[0]
    return F.when(s.phase == "bad", s).when(value.isNotNull(), put).otherwise(moved)


def plain(c: Column) -> Column:
    """A JSON text with each key once, with its last value, and with objects of NOT_A_NUMBER for NaN and Infinity; null if it is no JSON.

    One pass over the tokens with a stack of what is open; a value is written when it ends, so depth is not bounded.
    """
    start = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit("value").alias("phase"), F.lit("").alias("result")).cast(_STATE)
    return F.aggregate(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), start, _step, lambda s: F.when(s.phase == "end", s.result))


#: How a JSON text begins; what begins otherwise is not parsed, as a parse that fails costs most.
START = r"^[ \t\n\r]*[\[{\"0-9tfnNI-]"


def loads(c: Column) -> Column:
    """The variant of a text that is JSON, also with repeated keys (the last value counts, at any depth) and with NaN or Infinity.

    Only texts that are not strict JSON but hold such a word, or two equal strings before colons, are gone through by tokens.
    The session's settings do not matter.
    """
    names = F.regexp_extract_all(c, F.lit(r'("(?:[^"\\]|\\[\s\S])*+")\s*:'), F.lit(1))
    repeated = let(names, lambda n: (F.size(n) > F.size(F.array_distinct(n))) | F.exists(n, lambda x: x.contains("\\")))
    return F.when(c.rlike(START), F.coalesce(strict(c), F.when(c.rlike("NaN|Infinity") | repeated, let(plain(c), strict))))


def fenced(c: Column) -> Column:
    """What stands between the line of the first code fence and the next fence, stripped, or null."""
    start = F.locate("```", c)
    rest = F.substr(c, start)
    line = F.locate("\n", rest)
    body = F.substr(rest, line + 1)
    end = F.locate("```", body)
    return F.when((start > 0) & (line > 0) & (end > 0), strip(F.substr(body, F.lit(1), end - 1)))


#: Pieces that a text falls into: strings (an open one reaches to the end), escaped characters, braces, and what lies between.
PIECES = r'"(?:[^"\\]++|\\[\s\S])*+"|"[\s\S]*+|\\[\s\S]?|[{}]|[^{}"\\]++'


def first_object(c: Column) -> Column:
    """The first balanced object from the first brace on, or null; braces in strings and escaped characters don't count."""
    text = F.substr(c, F.locate("{", c))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        depth = s.depth + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        at = s.at + F.length(x)
        return F.when(s.end > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when((x == "}") & (depth == 0), at).otherwise(0).alias("end")))

    end = F.aggregate(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), start, step, lambda s: s.end)
    return F.when((F.locate("{", c) > 0) & (end > 0), F.substr(text, F.lit(1), end))
