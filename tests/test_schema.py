"""Schemas compiled to columns, and JSON as model replies have it, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from faultsieve.functions import jsontext as J
from faultsieve.functions import schema as S
from faultsieve.operators import contracts
from faultsieve.operators import responses as Q

KINDS = {"string": str, "array": list, "object": dict, "boolean": bool}


def _is(v, name):
    if name == "null":
        return v is None
    if name in ("number", "integer"):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (name == "number" or (math.isfinite(v) and v == int(v)))
    return isinstance(v, KINDS[name])


def check(v, s, path=()):
    """Violations by plain recursion."""
    at = "/".join(path) or "<root>"
    if isinstance(s, bool):
        return set() if s else {(at, "false")}
    out = set()
    bad = lambda test, rule: out.add((at, rule)) if test else None
    if "type" in s:
        bad(not any(_is(v, n) for n in ([s["type"]] if isinstance(s["type"], str) else s["type"])), "type")
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool) and (a is None) == (b is None)
    if "enum" in s:
        bad(not any(same(v, e) for e in s["enum"]), "enum")
    if "const" in s:
        bad(not same(v, s["const"]), "const")
    if isinstance(v, str):
        bad(len(v) < s.get("minLength", 0), "minLength")
        bad(len(v) > s.get("maxLength", 99), "maxLength")
    if _is(v, "number"):
        bad("minimum" in s and v < s["minimum"], "minimum")
        bad("exclusiveMaximum" in s and v >= s["exclusiveMaximum"], "exclusiveMaximum")
    if isinstance(v, list):
        bad(len(v) < s.get("minItems", 0), "minItems")
        for i, x in enumerate(v):
            out |= check(x, s.get("items", True), (*path, str(i)))
    if isinstance(v, dict):
        for name in s.get("required", []):
            bad(name not in v, f"required {name}")
        for k, x in v.items():
            if k in s.get("properties", {}):
                out |= check(x, s["properties"][k], (*path, k))
            elif s.get("additionalProperties", True) is False:
                out.add((at, f"additional {k}"))
            else:
                out |= check(x, s.get("additionalProperties", True), (*path, k))
    for part in s.get("allOf", []):
        out |= check(v, part, path)
    if "anyOf" in s:
        bad(not any(not check(v, p) for p in s["anyOf"]), "anyOf")
    if "oneOf" in s:
        bad(sum(not check(v, p) for p in s["oneOf"]) != 1, "oneOf")
    if "not" in s:
        bad(not check(v, s["not"]), "not")
    if "if" in s:
        branch = "else" if check(v, s["if"]) else "then"
        out |= check(v, s.get(branch, True), path)
    return out


def value(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind < 6:
        return [None, True, rng.choice([0, 1, 7, -3]), rng.choice([0.5, 2.0, -1.25]), rng.choice(["", "a", "é", "abc"]), "a"][kind]
    if kind == 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcd"): value(rng, depth - 1) for _ in range(rng.randrange(5))}


def schema(rng, depth):
    s = {}
    if rng.random() < 0.5:
        s["type"] = rng.choice(["string", "number", "integer", "object", "array", ["string", "null"], ["object", "array", "boolean"]])
    for word, choices in (("enum", [["a", 1, None], [True, "é"], [2]]), ("const", ["a", 1, None, False]), ("minLength", [1, 2]), ("maxLength", [1]), ("minimum", [0, 1]), ("exclusiveMaximum", [2]), ("minItems", [1, 2]), ("required", [["a"], ["a", "b"]])):
        if rng.random() < 0.15:
            s[word] = rng.choice(choices)
    if depth:
        if rng.random() < 0.7:
            s["properties"] = {k: schema(rng, depth - 1) for k in rng.sample("abcd", 2)}
        if rng.random() < 0.4:
            s["additionalProperties"] = rng.choice([False, {"type": "string"}])
        if rng.random() < 0.4:
            s["items"] = schema(rng, depth - 1)
        for word in ("allOf", "anyOf", "oneOf"):
            if rng.random() < 0.1:
                s[word] = [schema(rng, 0), schema(rng, 0)]
        if rng.random() < 0.1:
            s["not"] = schema(rng, 0)
        if rng.random() < 0.15:
            s |= {"if": {"type": "object"}, "then": {"required": ["c"]}, "else": schema(rng, 0)}
    return s


@pytest.mark.parametrize("seed", range(6))
def test_schemas_as_plain_python(spark, seed):
    rng = random.Random(seed)
    s = schema(rng, 2)
    values = [value(rng, 3) for _ in range(120)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").withColumn("v", J.loads(F.col("t")))
    for r in rows.select("i", S.violations(F.col("v"), json.dumps(s)).alias("found")).collect():
        assert {tuple(x) for x in r.found} == check(values[r.i], s), (s, values[r.i])


def test_a_changed_schema_changes_violations(spark):
    good = {"summary": "s", "root_cause": "r", "evidence": ["e"], "failing_module": None, "explanation_confidence": "high", "limitations": "l"}
    rows = spark.createDataFrame([(json.dumps(good),)], "raw_response string")
    of = lambda schema: Q.parse_and_validate(rows, schema=schema).first()
    assert of(contracts.EXPLANATION_SCHEMA).valid
    changed = json.loads(contracts.EXPLANATION_SCHEMA)
    changed["properties"]["explanation_confidence"]["enum"] = ["sure"]
    changed["properties"]["evidence"]["items"] = {"type": "object", "required": ["text"]}
    changed["required"].append("cause_id")
    changed["properties"]["cause_id"] = {"type": "integer"}
    assert of(changed).errors == ["<root>: required cause_id", "evidence/0: type", "explanation_confidence: enum"]
    assert "`cause_id`:bigint" in S.ddl(changed)


def test_unknown_keywords_and_circles_are_refused():
    with pytest.raises(ValueError, match="uniqueItems"):
        S.violations(F.lit(None), {"uniqueItems": True})
    with pytest.raises(ValueError, match="leads to itself"):
        S.violations(F.lit(None), {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}})


def test_fix_schema(spark):
    fix = {"action": "pin_version", "import_name": "a", "install_name": "a", "version": "1", "command": "pip install a==1", "rationale": "r", "pypi_evidence": {"latest_version": "2", "chosen_version": "1", "requires_python": None}}
    odd = [fix, fix | {"action": "install"}, fix | {"action": "none"}, fix | {"action": "conda"}, fix | {"pypi_evidence": {"latest_version": 2}}, fix | {"version": None}, fix | {"command": "pip install a b"}]
    rows = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(odd)], "i int, t string")
    got = {r.i: [": ".join(v) for v in r.v] for r in rows.select("i", S.violations(J.loads(F.col("t")), contracts.FIX_SCHEMA).alias("v")).collect()}
    assert got == {
        0: [], 1: ["version: type"], 2: ["command: type", "install_name: type", "version: type"], 3: ["action: enum"],
        4: ["pypi_evidence: required chosen_version", "pypi_evidence: required requires_python", "pypi_evidence/latest_version: type"], 5: ["version: type"], 6: ["command: pattern"],
    }


def _text(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return rng.choice(["NaN", "Infinity", "-Infinity", "1", "-2.5", "1e3", "null", json.dumps(rng.choice(["a", "x{y", 'q"z', "é", "\n", "NaN, b"]), ensure_ascii=rng.random() < 0.5)])
    if kind == 6:
        return "[" + ", ".join(_text(rng, depth - 1) for _ in range(rng.randrange(4))) + "]"
    return "{" + " ,".join(rng.choice(['"a"', '"b"', '"\\u0061"', '"c d"', '"é"', '"\\u00e9"']) + rng.choice([":", " : "]) + _text(rng, depth - 1) for _ in range(rng.randrange(5))) + "}"


def _tagged(v):
    if isinstance(v, float) and not math.isfinite(v):
        return {J.NOT_A_NUMBER: "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"}
    if isinstance(v, list):
        return [_tagged(x) for x in v]
    return {k: _tagged(x) for k, x in v.items()} if isinstance(v, dict) else v


def _loaded(t):
    try:
        return _tagged(json.loads(t))
    except ValueError:
        return "no JSON"


def test_json_as_python_reads_it(spark):
    """Repeated keys, escaped keys, NaN and Infinity at any depth, and damaged texts."""
    rng = random.Random(5)
    texts = [_text(rng, 3) for _ in range(500)] + ['{"a": tru, "a": 1}', '{"a":1,"a":2} x', "", " ", "01", '{"a":1,}', "[NaN,]", '{"a" "a":1}', '{"a":01,"a":1}', "[" * 60 + "NaN" + "]" * 60]
    for t in texts[:250]:
        if len(t) > 2:
            i = rng.randrange(len(t))
            texts.append(t[:i] + rng.choice(['"', "{", "}", ",", ":", "1", "[", "]", " ", "\\", "tru"]) + t[i + rng.randrange(2) :])
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", F.to_json(J.loads(F.col("t"))).alias("j")).collect():
        assert (json.loads(r.j) if r.j is not None else "no JSON") == _loaded(r.t), r.t


def test_not_a_number_is_a_number_of_no_whole_value(spark):
    rows = spark.createDataFrame([("NaN",), ("-Infinity",), ("2.0",)], "t string").select(*[S.violations(J.loads(F.col("t")), {"type": k}).alias(k) for k in ("number", "integer", "object", "string")])
    assert [[len(x) for x in r] for r in rows.collect()] == [[0, 1, 1, 1], [0, 1, 1, 1], [0, 0, 1, 1]]


def test_values_that_keep_a_schema_are_told_without_its_rules(spark):
    import json

    from pyspark.sql import functions as F

    from faultsieve.functions import schema as J
    from faultsieve.operators.contracts import EXPLANATION_SCHEMA

    good = {"summary": "s", "root_cause": "r", "evidence": ["e"], "failing_module": None, "explanation_confidence": "low", "limitations": "l"}
    wrong = [{"summary": ""}, {"summary": None}, {"evidence": ["e", None]}, {"evidence": [""]}, {"evidence": ["e", 1]}, {"failing_module": 1}, {"explanation_confidence": "sure"}, {"a: STRING, b": "x"}]
    rows = [good, good | {"failing_module": "m"}, *[good | w for w in wrong], {k: v for k, v in good.items() if k != "limitations"}]
    v = F.parse_json("t")
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, t string")
    got = df.select("i", J.Compiler(EXPLANATION_SCHEMA)._sound(v, json.loads(EXPLANATION_SCHEMA)).alias("sound"), J.violations(v, EXPLANATION_SCHEMA).alias("v")).orderBy("i").collect()
    assert [r.sound for r in got] == [True, True] + [False] * (len(rows) - 2)
    assert [len(r.v) for r in got] == [0, 0] + [1] * (len(rows) - 2)
