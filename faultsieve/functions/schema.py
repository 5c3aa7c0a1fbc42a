"""JSON Schema compiled to columns: what is wrong with a variant, by path and rule.

A schema is read once, on the driver; each of its keywords becomes a column expression over the variant, so a change of the schema's text
changes the plan and nothing else. Keywords apply to the types that they are about, as the standard says: a number has no
minLength to violate. Known are type, enum, const, required, properties, additionalProperties, items, minLength, maxLength, pattern, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, minItems, maxItems, allOf, anyOf, oneOf, not, if/then/else, $ref within the
schema, and boolean schemas; annotations are passed over. Another keyword raises an error, so no rule is dropped silently.

Numbers that JSON does not have (see `jsontext.loads`) are numbers here too.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import NOT_A_NUMBER
from .text import let

_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")
VIOLATIONS = "array<struct<path:string,rule:string>>"
ROOT = "<root>"
_ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format"}
_KNOWN = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "minItems", "maxItems", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref",
}


def _none() -> Column:
    return F.array().cast(VIOLATIONS)


def _both(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


class _Node:
    """A variant at a path: its kind, and readers that are null for other kinds."""

    def __init__(self, value: Column, path: str | Column):
        self.value, self.path = value, path

    @property
    def where(self) -> Column:
        if isinstance(self.path, str):
            return F.lit(self.path or ROOT)
        return self.path

    def child(self, step: str | Column) -> str | Column:
        if isinstance(self.path, str) and isinstance(step, str):
            return f"{self.path}/{step}" if self.path else step
        step = F.lit(step) if isinstance(step, str) else step
        return F.concat(F.lit(f"{self.path}/" if self.path else "") if isinstance(self.path, str) else F.concat(self.path, F.lit("/")), step)

    def wrong(self, bad: Column, rule: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(self.where.alias("path"), F.lit(rule).alias("rule")))).otherwise(_none())


def _is(kind: Column, fields: Column, name: str, number: Column) -> Column:
    odd = lambda: F.coalesce(F.map_contains_key(fields, NOT_A_NUMBER), F.lit(False))
    numeric = lambda: kind.isin(*_NUMBERS) | kind.startswith("DECIMAL")
    known = {
        "string": lambda: kind == "STRING", "null": lambda: kind == "VOID", "boolean": lambda: kind == "BOOLEAN", "array": lambda: kind.startswith("ARRAY"), "object": lambda: kind.startswith("OBJECT") & ~odd(),
        "number": lambda: numeric() | odd(), "integer": lambda: numeric() & F.coalesce(number % 1 == 0, F.lit(False)),
    }
    return known[name]()


class Compiler:
    def __init__(self, schema: dict | str):
        self.schema = json.loads(schema) if isinstance(schema, str) else schema

    def _resolve(self, ref: str, seen: tuple) -> dict | bool:
        if not ref.startswith("#") or ref in seen:
            raise ValueError(f"reference {ref} is not within the schema, or leads to itself")
        node = self.schema
        for step in [s for s in ref[1:].split("/") if s]:
            node = node[step.replace("~1", "/").replace("~0", "~")]
        return node

    def check(self, value: Column, schema=None, path: str | Column = "", seen: tuple = ()) -> Column:
        """The violations of a variant that is there."""
        schema = self.schema if schema is None else schema
        node = _Node(value, path)
        if isinstance(schema, bool):
            return _none() if schema else node.wrong(F.lit(True), "false")
        if unknown := set(schema) - _KNOWN - _ANNOTATIONS:
            raise ValueError(f"keywords that are not known: {', '.join(sorted(unknown))}")
        def facts(kind: Column) -> Column:
            """What is read of a value, each for its kind alone: other casts would fail row by row."""
            read = lambda to: F.try_variant_get(value, "$", to)
            fields = F.when(kind.startswith("OBJECT"), read("map<string,variant>"))
            number = F.when(kind.isin(*_NUMBERS) | kind.startswith("DECIMAL"), read("double"))
            return F.struct(kind.alias("kind"), fields.alias("fields"), F.when(kind == "STRING", read("string")).alias("text"), F.when(kind == "BOOLEAN", read("boolean")).alias("flag"), number.alias("number"), F.when(kind.startswith("ARRAY"), read("array<variant>")).alias("items"))

        full = let(F.schema_of_variant(value), lambda kind: let(facts(kind), lambda f: self._rules(node, schema, f, seen)))
        sound = self._sound(value, schema)
        return full if sound is None else F.when(sound, _none()).otherwise(full)

    def _sound(self, value: Column, schema: dict) -> Column | None:
        """True only where a value keeps the schema, by its type as one text and few reads; null where the schema has no such test.

        Most values keep their schema, and this costs a fraction of all rules. What is not sound here is judged by the rules.
        """
        names = schema.get("properties", {})
        if schema.get("type") == "object":
            closed = schema.get("additionalProperties") is False and set(schema.get("required", [])) == set(names)
            if not names or not closed or set(schema) - {"type", "properties", "required", "additionalProperties"} - _ANNOTATIONS or not all(re.fullmatch("[a-z_]+", n) for n in names):
                return None
        found = {n: self._parts(s) for n, s in names.items()} if names else {"": self._parts(schema)}
        if not all(found.values()):
            return None
        order = sorted(found)
        types = [", ".join(f"{n}: {t}" if n else t for n, t in zip(order, chosen)) for chosen in itertools.product(*(found[n][0] for n in order))]
        if len(types) > 64:
            return None
        tests = [test(lambda to, n=n: F.try_variant_get(value, f"$.{n}" if n else "$", to)) for n in order for test in found[n][1]]
        kind = F.schema_of_variant(value).isin(*[f"OBJECT<{t}>" if names else t for t in types])
        return F.coalesce(reduce(lambda a, b: a & b, tests, kind), F.lit(False))

    @staticmethod
    def _parts(schema) -> tuple[list[str], list] | None:
        """The types that a text, null or list of texts may have, and tests given a reader of the value; null for other schemas."""
        if not isinstance(schema, dict) or set(schema) - {"type", "minLength", "maxLength", "enum", "items"} - _ANNOTATIONS:
            return None
        kinds = schema.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds == ["array"] and set(schema) <= {"type", "items"} | _ANNOTATIONS:
            inner = Compiler._parts(schema.get("items", True))
            if inner is None or inner[0] != ["STRING"]:
                return None
            each = lambda x: reduce(lambda a, b: a & b, [test(lambda _: x) for test in inner[1]], x.isNotNull())
            return ["ARRAY<STRING>"], [lambda read: F.forall(read("array<string>"), each)]  # a null among texts is told by none of the types
        if not kinds or set(kinds) - {"string", "null"} or "items" in schema or not all(isinstance(v, str) for v in schema.get("enum", [])) or ("enum" in schema and kinds != ["string"]):
            return None
        kept = lambda test: lambda read: F.coalesce(test(read("string")), F.lit(True))
        tests = [kept(t) for t in [
            *([lambda x: F.length(x) >= schema["minLength"]] if "minLength" in schema else []), *([lambda x: F.length(x) <= schema["maxLength"]] if "maxLength" in schema else []),
            *([lambda x: x.isin(*schema["enum"])] if "enum" in schema else []),
        ]]
        return [{"string": "STRING", "null": "VOID"}[k] for k in kinds], tests

    def _rules(self, node: _Node, schema: dict, f: Column, seen: tuple) -> Column:
        kind, fields, number, items = f.kind, f.fields, f.number, f["items"]
        text = f.text
        is_a = lambda name: _is(kind, fields, name, number)
        only = lambda test, found: F.when(F.coalesce(test, F.lit(False)), found).otherwise(_none())
        again = lambda s: self.check(node.value, s, node.path, seen)
        parts: list[Column] = []
        if "$ref" in schema:
            parts.append(self.check(node.value, self._resolve(schema["$ref"], seen), node.path, (*seen, schema["$ref"])))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            test = F.lit(False)
            for n in names:
                test = test | is_a(n)
            parts.append(node.wrong(~test, "type"))
        for word in ("enum", "const"):
            if word in schema:
                test = F.lit(False)
                for v in schema["enum"] if word == "enum" else [schema["const"]]:
                    test = test | F.coalesce(self._equals(kind, text, f, v), F.lit(False))
                parts.append(node.wrong(~test, word))
        size = {"minLength": lambda n: F.length(text) < n, "maxLength": lambda n: F.length(text) > n, "pattern": lambda p: ~text.rlike(p)}
        size |= {"minimum": lambda n: number < n, "maximum": lambda n: number > n, "exclusiveMinimum": lambda n: number <= n, "exclusiveMaximum": lambda n: number >= n}
        size |= {"minItems": lambda n: F.size(items) < n, "maxItems": lambda n: F.size(items) > n}
        parts += [node.wrong(test(schema[word]), word) for word, test in size.items() if word in schema]
        parts += self._members(node, schema, only, is_a("object"), fields, seen)
        if "items" in schema:
            each = F.transform(items, lambda x, i: self.check(x, schema["items"], node.child(i.cast("string")), seen))
            parts.append(only(is_a("array"), F.flatten(each)))
        valid = lambda s: F.size(again(s)) == 0
        for s in schema.get("allOf", []):
            parts.append(again(s))
        for word in ("anyOf", "oneOf"):
            if word in schema:
                count = sum((valid(s).cast("int") for s in schema[word]), F.lit(0))
                parts.append(node.wrong(count < 1 if word == "anyOf" else count != 1, word))
        if "not" in schema:
            parts.append(node.wrong(valid(schema["not"]), "not"))
        if "if" in schema:
            then = F.when(valid(schema["if"]), again(schema["then"]) if "then" in schema else _none())
            parts.append(then.otherwise(again(schema["else"]) if "else" in schema else _none()))
        return _both(parts)

    def _members(self, node: _Node, schema: dict, only, is_object: Column, fields: Column, seen: tuple) -> list[Column]:
        parts = [node.wrong(is_object & ~F.map_contains_key(fields, name), f"required {name}") for name in schema.get("required", [])]
        known = schema.get("properties", {})
        for name, inner in known.items():
            there = is_object & F.map_contains_key(fields, name)
            parts.append(only(there, self.check(F.try_element_at(fields, F.lit(name)), inner, node.child(name), seen)))
        more = schema.get("additionalProperties", True)
        if more is True:
            return parts
        names = F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
        if more is False:
            found = F.transform(names, lambda k: F.struct(node.where.alias("path"), F.concat(F.lit("additional "), k).alias("rule")))
        else:
            found = F.flatten(F.transform(names, lambda k: self.check(F.try_element_at(fields, k), more, node.child(k), seen)))
        return [*parts, only(is_object, found)]

    @staticmethod
    def _equals(kind: Column, text: Column, f: Column, v) -> Column:
        if v is None:
            return kind == "VOID"
        if isinstance(v, bool):
            return (kind == "BOOLEAN") & (f.flag == v)
        if isinstance(v, (int, float)):
            return _is(kind, f.fields, "number", f.number) & (f.number == v)
        if isinstance(v, str):
            return text == v
        raise ValueError("enum and const of objects and arrays are not known")


def violations(value: Column, schema: dict | str) -> Column:
    """What is wrong with a variant: structs of path and rule, in their order; null without a variant."""
    return F.when(value.isNotNull(), F.sort_array(F.array_distinct(Compiler(schema).check(value))))


def ddl(schema: dict | str) -> str:
    """The Spark type of what a schema describes: structs, arrays and texts; what is of several types, or of none, is text."""
    root = json.loads(schema) if isinstance(schema, str) else schema
    kinds = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}

    def of(node) -> str:
        if isinstance(node, dict) and "$ref" in node:
            return of(Compiler(root)._resolve(node["$ref"], ()))
        names = node.get("type", "string") if isinstance(node, dict) else "string"
        names = [n for n in ([names] if isinstance(names, str) else names) if n != "null"]
        if names == ["object"] and node.get("properties"):
            return "struct<" + ",".join(f"`{k}`:{of(v)}" for k, v in node["properties"].items()) + ">"
        if names == ["array"]:
            return f"array<{of(node.get('items', {}))}>"
        return kinds.get(names[0], "string") if len(names) == 1 else "string"

    return of(root)
