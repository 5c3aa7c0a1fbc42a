"""Joins, responses, prompts, releases and attempts on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from faultsieve.operators import attempts as A
from faultsieve.operators import context as C
from faultsieve.operators import dataset as D
from faultsieve.operators import graph as G
from faultsieve.operators import prompts as P
from faultsieve.operators import releases as V
from faultsieve.operators import responses as Q
from faultsieve.sources import storage as S

CELL = "executing the following cell:\n----\nimport os\n----\n"
FAILURES = "notebook_execution_id long, notebook_id long, error_type string, error_message string, failing_module string"


@pytest.mark.parametrize("parts", [1, 7])
def test_legacy_hints(spark, parts):
    m = "ModuleNotFoundError"
    failures = spark.createDataFrame([(1, 1, m, "No module named 'foo'", "foo"), (2, 2, m, "No module named 'foo'", "foo"), (3, 3, m, "No module named 'foo'", "foo"), (4, 1, m, "x", ""), (5, 4, "ImportError", "cannot import name 'a' from 'b_%' (/x)", "b_%")], FAILURES)
    legacy = spark.createDataFrame([(9, 1, CELL + "No module named 'foo'"), (8, 1, CELL + 'No module named "foo" first'), (7, 1, "import foo, other error"), (6, 2, "import foo\nNo module named 'bar'"), (5, 4, "cannot import name 'a' from 'b_%' (elsewhere)")], "id long, notebook_id long, msg string")
    got = {r.notebook_execution_id: r for r in C.join_legacy_hint(failures, legacy.repartition(parts)).collect()}
    assert got[1].legacy_traceback_hint.raw_traceback.endswith("first") and got[1].legacy_traceback_hint.cell_source == "import os" and not got[1].legacy_hint_rejected
    assert got[2].legacy_traceback_hint is None and got[2].legacy_hint_rejected
    assert got[3].legacy_traceback_hint is None and not got[3].legacy_hint_rejected
    assert got[4].legacy_traceback_hint is None and not got[4].legacy_hint_rejected
    assert got[5].legacy_traceback_hint is not None and got[5].legacy_traceback_hint.cell_source is None


def test_notebook_cells(spark):
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": "import x"}] + [{"cell_type": "code", "source": ["import a\n", f"n = {i}"]} for i in range(6)] + [{"cell_type": "code"}]})
    rows = spark.createDataFrame([(1, book, 0), (2, book, 7), (3, book, None), (4, book, 99), (5, "bad", 0), (6, '{"cells": []}', 0), (7, None, 0)], "i long, c string, e long")
    got = {r.i: r.x for r in rows.select("i", C.notebook_context(F.col("c"), F.col("e")).alias("x")).collect()}
    assert got[1].failing_cell_source == "import x" and [c.cell_index for c in got[1].surrounding_cells] == [0, 1, 2]
    assert [c.cell_index for c in got[1].import_cells] == [1, 2, 3, 4, 5] and got[1].import_cells[0].source == "import a\nn = 0"
    assert got[2].failing_cell_source == "" and [c.cell_index for c in got[2].surrounding_cells] == [5, 6, 7]
    assert got[3].failing_cell_source is None and got[3].surrounding_cells == [] and got[4].surrounding_cells == []
    assert got[5] is None and got[6] is None and got[7] is None


def test_snapshot_priority(spark):
    rows = spark.createDataFrame([(1, "r", "nb", "c1", "a.txt;b.txt", None)], "notebook_execution_id long, repository string, notebook_name string, commit_ref string, requirements string, setups string").withColumns({"pipfiles": F.lit(None).cast("string"), "pipfile_locks": F.lit("p.lock")})
    shots = spark.createDataFrame([("r", "main", "nb", "M"), ("r", "c1", "nb", "C"), ("r", "master", "a.txt", "A"), ("r", "main", "p.lock", "")], "repository string, ref string, path string, content string")
    assert C.join_source_snapshot(rows, shots).first().content == "C"
    files = C.join_dependency_files(rows, shots).orderBy("field_no", "pos").collect()
    assert [(f.path, f.fetched, f.ref) for f in files] == [("a.txt", True, "master"), ("b.txt", False, None), ("p.lock", False, "main")] or files[2].ref == "main"


GOOD = {"summary": "s", "root_cause": "r", "evidence": ["e"], "failing_module": "m", "explanation_confidence": "high", "limitations": "l"}


def checked(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_response string")
    return [r for r in Q.parse_and_validate(rows).orderBy("i").collect()]


def test_validation(spark):
    good = json.dumps(GOOD)
    less = {k: v for k, v in GOOD.items() if k != "evidence"}
    texts = [
        good, f"Hi\n```json\n{good}\n```\nbye", f"Here: {good} done", json.dumps(less), json.dumps(GOOD | {"x": 1}), "[1, 2]", "nothing", json.dumps(GOOD | {"evidence": []}), json.dumps(GOOD | {"limitations": ""}),
        json.dumps(GOOD | {"explanation_confidence": "sure"}), json.dumps(GOOD | {"failing_module": None}), json.dumps(GOOD | {"evidence": ["", 1]}), json.dumps(GOOD | {"summary": 3}), None, '"text"', json.dumps(GOOD | {"failing_module": 1}),
    ]
    got = checked(spark, texts)
    assert [r.valid for r in got] == [True, True, True, False, False, False, False, True, False, False, True, False, False, False, False, False]
    assert [r.shape for r in got[:3]] == ["whole", "fenced", "embedded"]
    assert got[3].errors == ["<root>: required evidence"] and got[3].explanation.summary == "s"
    assert got[4].errors == ["<root>: additional x"] and got[5].errors[0].startswith("non_object_json") and got[5].explanation is None
    assert got[6].errors[0].startswith("invalid_json") and got[13].errors[0].startswith("invalid_json")
    assert got[8].errors == ["limitations: minLength"] and got[9].errors == ["explanation_confidence: enum"]
    assert got[11].errors == ["evidence/0: minLength", "evidence/1: type"] and got[12].errors == ["summary: type"] and got[15].errors == ["failing_module: type"]


def test_repeated_keys_of_a_reply(spark):
    setting = "spark.sql.variant.allowDuplicateKeys"
    replies = spark.createDataFrame([(1, '{"a": 1, "a": 2}'), (2, 'text {"a": {"b": 1, "b": "z"}} text'), (3, '{"a": NaN}')], "id long, raw_response string")
    want = ['{"a":2}', '{"a":{"b":"z"}}', '{"a":{"\\u0001number":"NaN"}}']
    for allowed in ("false", "true"):
        before = spark.conf.get(setting)
        spark.conf.set(setting, allowed)
        try:
            assert [r.j for r in Q.extract_json(replies).orderBy("id").select(F.to_json("payload").alias("j")).collect()] == want
        finally:
            spark.conf.set(setting, before)


def test_attempts_are_reduced(spark):
    good = json.dumps(GOOD)
    rows = [
        (1, 1, "reply", good, 10, 1, 100), (1, 2, "reply", "late", 10, 1, 100), (2, 1, "reply", "bad", 10, 1, 100), (2, 2, "reply", good, 20, 2, 50), (3, 1, "reply", "bad", 10, 1, 100), (3, 2, "timeout", None, None, None, 7),
        (4, 1, "runtime_error", None, None, None, 1), (4, 2, "reply", good, 1, 1, 1), (5, 1, "model_unavailable", None, None, None, 1), (5, 2, "reply", "[1]", 1, 1, 1), (5, 3, "reply", good, 1, 1, 1), (6, 1, "reply", "bad", 1, 1, 1),
    ]
    df = spark.createDataFrame(rows, "notebook_execution_id long, attempt int, kind string, raw_response string, tokens_input long, tokens_output long, latency_ms long")
    got = {r.notebook_execution_id: r for r in Q.reduce_attempts(df).collect()}
    assert [(got[i].status, got[i].failure_category, got[i].attempts) for i in range(1, 6)] == [("success", None, 1), ("success", None, 2), ("failed", "timeout", 2), ("failed", "runtime_error", 1), ("failed", "schema_validation_error", 2)]
    assert got[3].raw_response == "bad" and got[3].tokens_input is None and got[2].latency_ms == 150 and got[4].raw_response == ""
    assert got[6].status == "failed" and got[6].failure_category == "invalid_json"
    once = {r.notebook_execution_id: r for r in Q.reduce_attempts(df, max_retries=1, retry_on=["timeout"]).collect()}
    assert once[2].attempts == 1 and once[2].failure_category == "invalid_json"
    assert {r.notebook_execution_id for r in Q.retry_worklist(df.where("attempt = 1")).collect()} == {2, 3, 5, 6}


def test_values_are_not_expanded_again(spark):
    rows = spark.createDataFrame([("{{b}}", "B"), (None, " ")], "a string, b string")
    from faultsieve.functions.text import or_missing

    values = {"a": or_missing(F.col("a")), "b": or_missing(F.col("b"))}
    assert [r.prompt for r in P.render(rows, "x {{a}} y {{b}} {c}", values).collect()] == ["x {{b}} y B {c}", "x Not available y Not available {c}"]
    bad = P.render(rows, "bad={{unknown_field}}", values).collect()
    assert all(r.prompt is None and "unknown_field" in r.error for r in bad)
    sliced = P.record_slice(spark.createDataFrame([(i,) for i in range(20)], "i long"), "i", 3, 4)
    assert sorted(r.i for r in sliced.collect()) == [3, 4, 5, 6]


def test_releases(spark):
    files = [("3.0.0", ">=3.8", False), ("2.5.0", ">=3.8", True), ("2.0.0", "<3.7", False), ("1.9.0b1", ">=3.6", False), ("1.8.0", None, False), ("1.7.0", ">=3.8", False), ("odd", None, False)]
    df = spark.createDataFrame([("examplepkg", f"{v}.whl", v, r, y, None) for v, r, y in files], "distribution_name string, filename string, version string, requires_python string, yanked boolean, yanked_reason string")
    judged = V.judged_releases(V.release_grouping(df), "3.13")
    assert [(r.version, r.python_compatibility) for r in V.release_top5(judged).orderBy("rank").collect()] == [("3.0.0", "compatible"), ("1.8.0", "unknown"), ("1.7.0", "compatible")]
    assert {r.version: r.excluded for r in judged.where("excluded is not null").collect()} == {"2.5.0": "yanked", "2.0.0": "incompatible requires-python", "1.9.0b1": "pre-release", "odd": "invalid_version"}
    assert V.latest_version(judged).first().latest_version == "3.0.0"
    many = spark.createDataFrame([("p", "f", f"1.{i}", None, False, None) for i in range(12)], df.schema)
    assert [r.version for r in V.release_top5(V.judged_releases(V.release_grouping(many), None)).orderBy("rank").collect()] == ["1.11", "1.10", "1.9", "1.8", "1.7"]


def test_fix_objects(spark):
    evidence = {"latest_version": "2", "chosen_version": None, "requires_python": None}
    fixes = [("install", "a", None, "pip install a"), ("pin_version", "a", "1", "pip install a==1"), ("none", None, None, None), ("install", "a", "1", "pip install a"), ("pin_version", "a", "1", "pip install a==2"), ("install", "a", None, "conda install a"), (None, None, None, None)]
    texts = [json.dumps({"action": a, "import_name": "x", "install_name": n, "version": v, "command": c, "rationale": "r", "pypi_evidence": evidence}) for a, n, v, c in fixes] + ["no json", None, "[1]"]
    got = {r.id: [": ".join(v) for v in r.violations] for r in A.fix_violations(spark.createDataFrame(list(enumerate(texts)), "id int, fix string")).collect()}
    assert got[0] == got[1] == got[2] == []
    assert got[3] == ["version: type"] and got[4] == ["command: exact"] and got[5] == ["command: exact", "command: pattern"]
    assert got[6] == ["action: enum"] and got[7] == got[8] == ["<root>: invalid_json"] and got[9] == ["<root>: type"]


def test_kappa_by_hand(spark):
    pairs = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a")]
    r = D.label_agreement(spark.createDataFrame(pairs, "x string, y string"), "x", "y").first()
    assert (r.n, r.observed, r.kappa) == (50, 0.7, 0.4)


def test_csv_keeps_quotes_lines_and_gaps(spark, tmp_path):
    rows = [(1, 'say "x", y', ""), (2, "two\nlines", None), (3, None, "z")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    S.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, S.scan_csv(spark, str(tmp_path / "c"), "id long, a string, b string").collect())) == rows
    S.write_json(df, str(tmp_path / "j"))
    assert all(len(json.loads(r.value)) == 3 for r in spark.read.text(str(tmp_path / "j")).collect())


def test_lines_of_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("  ",), ("{bad",), ('{"a": 1} x',), (None,)], "value string")
    got = S.scan_jsonl(rows).collect()
    assert [r.error for r in got] == [None, "malformed JSON", "malformed JSON"]


def test_bad_ids_are_kept_apart(spark):
    rows = spark.createDataFrame([("1", "2", "3", "s"), ("x", "2", "3", None), (None, "2", "3", "s")], "notebook_execution_id string, notebook_id string, repository_id string, subtype string")
    rows = rows.withColumns({c: F.lit("v") for c in ("error_type", "failing_module", "refined_subtype", "confidence", "root_cause_hint")})
    got = C.quarantine_bad_rows(rows).collect()
    assert [(r.notebook_execution_id, r.rejected, r.refined_subtype) for r in got] == [(1, False, "v"), (None, True, "out_of_scope"), (None, True, "s")]


def test_positions_and_one_row(spark):
    from faultsieve.functions.frames import one_row, positions

    ids = [(k, None if i % 50 == 7 else i * 997) for k in ("a", "b", None) for i in range(60)]
    got = positions(spark.createDataFrame(ids, "k string, id long"), "id", "k").collect()
    assert len(got) == len(ids)
    for k in ("a", "b", None):
        own = sorted(i for g, i in ids if g == k and i is not None)
        assert {r.id: r.position for r in got if r.k == k and r.id is not None} == {i: n for n, i in enumerate(own, 1)}
    assert all(r.position is None for r in got if r.id is None)
    assert one_row(spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")).collect() == [(1, 2)]


def test_blank_repositories_have_no_files(spark):
    rows = spark.createDataFrame([(1, "", "nb", "a.txt"), (2, None, "nb", "a.txt"), (3, "r", "nb", "a.txt")], "notebook_execution_id long, repository string, notebook_name string, requirements string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("commit_ref", "setups", "pipfiles", "pipfile_locks")})
    shots = spark.createDataFrame([("r", "main", "a.txt", "A"), ("", "main", "a.txt", "B")], "repository string, ref string, path string, content string")
    assert [(f.notebook_execution_id, f.fetched) for f in C.join_dependency_files(rows, shots).collect()] == [(3, True)]


def test_best_file_of_a_release(spark):
    files = [("d", "a", "1.0", ">=3.8,<3.12", False, None), ("d", "b", "1.0", ">=3.10", False, None), ("d", "c", "1.0", ">=3.13", True, "bad"), ("d", "d", "1.1", ">=3.13", False, None), ("d", "e", "1.1", None, True, "bad")]
    df = spark.createDataFrame(files, "distribution_name string, filename string, version string, requires_python string, yanked boolean, yanked_reason string")
    got = {r.version: (r.requires_python, r.excluded) for r in V.judged_releases(V.release_grouping(df, "3.13"), "3.13").collect()}
    assert got == {"1.0": (">=3.10", None), "1.1": (">=3.13", None)}


def test_triples_as_lines(spark):
    facts = spark.createDataFrame([(7, 3, "m", 'pip\n"x"\\\t', "fixed", None, "gemma2:9b x")], "id long, notebook_execution_id long, failing_module string, command string, outcome string, new_error_type string, llm_model string")
    lines = [r.line for r in G.triple_lines(G.repair_triples(facts.withColumn("created_at", F.lit("2025-01-02 03:04:05").cast("timestamp")))).collect()]
    assert len(lines) == 8 and not any("\n" in x or "\t" in x or "\r" in x for x in lines)
    assert all(x.startswith("<urn:notebook-repair:") and x.endswith(" .") for x in lines)
    assert any('"pip\\n\\"x\\"\\\\\\t"' in x for x in lines)
    assert any(x.endswith('<urn:notebook-repair:gemma2%3A9b%20x> .') or x.endswith('<urn:notebook-repair:gemma2%3A9b+x> .') for x in lines)
    assert any(x.endswith('"2025-01-02T03:04:05Z"^^<http://www.w3.org/2001/XMLSchema#dateTime> .') for x in lines)


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})()

    with pytest.raises(ValueError):
        S.shared_dir(Session())
