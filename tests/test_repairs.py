"""Repairs: rounds and their errors, prompts from tables, triples asked and read, runs written again."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from faultsieve.operators import attempts as A
from faultsieve.operators import context as C
from faultsieve.operators import graph as G
from faultsieve.operators import lineage as L
from faultsieve.operators import prompts as P
from faultsieve.sources import storage as S

RERUN = "notebook_execution_id long, parent_execution_id long, run_id string, execution_status string, error_type string, error_message string, created_at timestamp"
ATTEMPT = "id long, notebook_execution_id long, round int, action string, install_name string, version string, command string, outcome string, llm_model string, prompt_strategy string, run_id string, created_at timestamp"


def _reruns(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], RERUN).withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("notebook_execution_id")))


RUNS = [
    (101, 1, "a", "FAILED", "E1", "first of a"), (102, 101, "a", "FAILED", "E2", "second of a"), (103, 1, "b", "SUCCESS", None, None), (104, 101, "b", "FAILED", "EX", "other run"), (105, 1, "a", "FAILED", "E1b", "again"),
    (106, 105, "a", "SUCCESS", None, None), (107, 999, "a", "FAILED", "EL", "lost"), (108, 102, "a", "FAILED", "E3", "third"), (109, 2, "a", "FAILED", "E4", "of 2"),
]


def test_chains_follow_parents_within_a_run(spark):
    failures = spark.createDataFrame([(1,), (2,), (3,)], "notebook_execution_id long")
    got = {(r.notebook_execution_id, r.run_id, r.round): r.execution_id for r in L.rerun_chain(failures, _reruns(spark, RUNS), rounds=3).collect()}
    assert got == {(1, "a", 1): 105, (1, "a", 2): 106, (1, "a", 3): 108, (1, "b", 1): 103, (2, "a", 1): 109}
    assert (1, "a", 3) not in {(r.notebook_execution_id, r.run_id, r.round) for r in L.rerun_chain(failures, _reruns(spark, RUNS)).collect()}
    assert {r.notebook_execution_id for r in L.lost_reruns(failures, _reruns(spark, RUNS)).collect()} == {107}
    assert L.rerun_chain(failures, _reruns(spark, RUNS).where("false")).count() == 0


@pytest.fixture
def facts(spark):
    attempts = [
        (11, 1, 1, "install", "x", None, "pip install x", "still_failing", "m", "few_shot", "a"), (12, 1, 2, "pin_version", "x", "1", "pip install x==1", "fixed", "m", "few_shot", "a"), (13, 1, 1, "none", None, None, None, "fixed", "m", "few_shot", "b"),
        (21, 2, 1, "install", "y", None, "pip install y", "still_failing", "m", "zero_shot", "a"), (31, 3, 1, "install", "z", None, "pip install z", "apply_error", "m", "zero_shot", "a"), (41, 4, 1, "install", "q", None, "pip install q", "still_failing", "m", "zero_shot", "a"),
    ]
    attempts = spark.createDataFrame([(*a, None) for a in attempts], ATTEMPT)
    failures = spark.createDataFrame([(i, f"mod{i}", "missing_package", "ModuleNotFoundError", "the first error") for i in (1, 2, 3)], "notebook_execution_id long, failing_module string, subtype string, error_type string, error_message string")
    fixes = spark.createDataFrame([(11, '{"rationale":"","rationale":"why 11","pypi_evidence":{"b":1,"a":null}}'), (12, "no json"), (21, '{"rationale":"why 21"}')], "attempt_id long, fix string")
    told = spark.createDataFrame([(1, "told")], "notebook_execution_id long, explanation string")
    return A.attempt_facts(attempts, failures, told, fixes, L.rerun_chain(failures, _reruns(spark, RUNS)))


def test_attempts_have_the_error_they_caused(facts):
    got = {r.id: r for r in facts.collect()}
    assert (got[11].new_error_type, got[11].new_error_message) == ("E1b", "again") and got[12].new_error_type is None
    assert (got[21].new_error_type, got[21].new_error_message) == ("E4", "of 2") and got[41].new_error_type is None
    assert (got[11].rationale, got[11].pypi_evidence) == ("why 11", '{"a":null,"b":1}') and got[12].rationale is None and (got[21].rationale, got[21].pypi_evidence) == ("why 21", None)
    assert len(got) == 6 and got[41].failing_module is None and got[11].explanation == "told"


def test_next_round_starts_from_the_new_error(spark, facts):
    work = {r.id: r for r in A.second_round_worklist(facts).collect()}
    assert set(work) == {21, 41} and work[21].round == 2 and work[41].failing_module is None and work[41].subtype is None
    assert (work[21].new_error_message, work[21].subtype, work[21].scope_status) == ("of 2", "out_of_scope", "excluded")
    assert {r.id for r in A.second_round_worklist(facts, most_rounds=1).collect()} == set()
    module = facts.withColumns({"new_error_type": F.lit("ModuleNotFoundError"), "new_error_message": F.lit("No module named 'dep.core'")})
    assert {(r.failing_module, r.subtype, r.scope_status) for r in A.second_round_worklist(module).collect()} == {("dep", "missing_package", "usable")}


def test_prior_attempt_is_the_latest_before(spark, facts):
    asked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 3), (1, "b", 2), (2, "b", 2), (9, "a", 2)], "notebook_execution_id long, run_id string, round int")
    got = {(r.notebook_execution_id, r.run_id, r.round): r.prior.id if r.prior else None for r in L.with_prior_attempt(asked, facts).collect()}
    assert got == {(1, "a", 1): None, (1, "a", 2): 11, (1, "a", 3): 12, (1, "b", 2): 13, (2, "b", 2): None, (9, "a", 2): None}


def test_repair_prompt_slots(spark):
    kind = "error_type string, error_message string, failing_module string, traceback string, dependency_files array<struct<path:string,fetched:boolean,ref:string,content:string>>, import_cells array<struct<cell_index:bigint,source:string>>, releases string, prior struct<id:bigint,round:int,action:string,command:string,rationale:string,outcome:string,new_error_type:string,new_error_message:string>"
    full = ("E", "m {{prior_attempt}}", "mod", "T", [("r.txt", True, "main", "a==1"), ("s.py", False, None, None)], [(1, "x = 1\nimport a\n  from b import c"), (2, "import d")], "R", (1, 1, "install", "pip install a", "why", "still_failing", "E2", None))
    rows = spark.createDataFrame([full, (None, None, None, None, None, None, None, None)], kind)
    filled, empty = P.render(rows, "{{error_context}}|{{current_requirements}}|{{notebook_imports}}|{{pypi_versions}}|{{prior_attempt}}", P.repair_values()).collect()
    assert filled.prompt == "E: m {{prior_attempt}}\nfailing module: mod\ntraceback:\nT|# r.txt\na==1|import a\n  from b import c\nimport d|R|round 1: install, command: pip install a, outcome: still_failing\nnew error: E2: none"
    assert empty.prompt == "|".join([P.NOT_AVAILABLE] * 5)


def test_templates_are_rows(spark):
    """A new row needs no code, values that look like placeholders stay, and unknown names and missing templates are errors."""
    records = spark.createDataFrame([(1, "s1", "A {{b}} \\1 $1"), (2, "s2", None), (3, "s3", "x"), (4, "nope", "x"), (5, None, "x"), (6, "plain", "x"), (7, "empty", "x")], "id int, strategy string, a string")
    templates = [("s1", "{{a}}{{b}}\n{{a}} {a} {{ a }}"), ("s2", "only {{b}}"), ("s3", "{{c}} and {{a}}"), ("plain", "nothing"), ("empty", "")]
    values = {"a": F.coalesce("a", F.lit("gap")), "b": F.lit("B{{a}}"), "unused": F.raise_error(F.lit("must not be worked out"))}
    table = spark.createDataFrame(templates, "strategy string, template string")
    for most in (P.TEMPLATE_BYTES, 0):
        got = {r.id: (r.prompt, r.error) for r in P.render_from_table(records, table, values, ["strategy"], most_bytes=most).collect()}
        assert got == {
            1: ("A {{b}} \\1 $1B{{a}}\nA {{b}} \\1 $1 {a} {{ a }}", None), 2: ("only B{{a}}", None), 3: (None, "KeyError: Unknown template placeholder: c"), 4: (None, "no template for nope"), 5: (None, "no template for null"),
            6: ("nothing", None), 7: ("", None),
        }
    for name, text in templates[:2]:
        compiled = P.render(records.where(F.col("strategy") == name), text, {k: values[k] for k in "ab"}).first().prompt
        assert compiled == got[int(name[1])][0]


# records


@pytest.mark.parametrize("seed", range(3))
def test_records_as_their_single_joins(spark, seed):
    """One lookup and one aggregation give what the joins of hints, sources and files give by themselves."""
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    rows = [(i, pick(1, 2, 3, 4, None), pick(10, 11, 12, None), pick("nb", "nc", None), "u", pick("ModuleNotFoundError", "ImportError", None), pick("No module named 'a'", "cannot import name 'b' from 'a'", None), pick(0, 1, None), pick("a", "b", "", None), "s", "r", "c", "h") for i in range(60)]
    kind = "notebook_execution_id long, repository_id long, notebook_id long, notebook_name string, repository_url string, error_type string, error_message string, error_cell_index long, failing_module string, subtype string, refined_subtype string, confidence string, root_cause_hint string"
    data = spark.createDataFrame(rows, kind)
    legacy = spark.createDataFrame([(k, pick(10, 11, 13, None), pick("x No module named 'a' y", "a cannot import name 'b' from 'a'", "a only", "", None)) for k in range(40)], "id long, notebook_id long, msg string")
    repositories = spark.createDataFrame([(1, "r1", "c", "a.txt; b.txt;a.txt", "s.py", None, ";"), (2, "r2", None, "a.txt", None, "p", None), (3, "", "c", "a.txt", None, None, None), (5, "r5", "c", None, None, None, None)], "id long, repository string, commit_ref string, requirements string, setups string, pipfiles string, pipfile_locks string")
    shots = [(r, ref, path, pick("", "x" * 5000, '{"cells":[{"cell_type":"code","source":"import a"}]}', None)) for r in ("r1", "r2", "") for ref in ("c", "main", "master") for path in ("nb", "nc", "a.txt", "b.txt", "s.py", "p") if rng.random() < 0.4]
    snapshot = spark.createDataFrame(shots, "repository string, ref string, path string, content string").where("content is not null")
    got = {r.notebook_execution_id: r for r in C.gather(data, legacy, repositories, snapshot).collect()}
    assert len(got) == len(rows)
    own = C.join_repository(data, repositories)
    hints = {r.notebook_execution_id: (r.legacy_traceback_hint, r.legacy_hint_rejected) for r in C.join_legacy_hint(data, legacy).collect()}
    sources = {r.notebook_execution_id: r.content for r in C.join_source_snapshot(own, snapshot).collect()}
    files = {r.notebook_execution_id: r.dependency_files for r in C.collect_files(C.join_dependency_files(own, snapshot)).collect()}
    for i, r in got.items():
        assert (r.legacy_traceback_hint, r.legacy_hint_rejected) == hints[i] and r.content == sources[i] and r.dependency_files == files.get(i, []), i
        assert tuple(r[c] for c in data.columns) == rows[i]


# triples


def _solutions(triples, patterns, optional=()):
    """All ways to match by plain backtracking."""

    def grow(found, pattern, keep):
        out = []
        for have in found:
            hits = []
            for t in triples:
                new = dict(have)
                if all((new.setdefault(p[1:], v) == v) if p.startswith("?") else p == v for p, v in zip(pattern, t)):
                    hits.append(new)
            out += hits or ([have] if keep else [])
        return out

    found = [{}]
    for p in patterns:
        found = grow(found, p, False)
    for p in optional:
        found = grow(found, p, True)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_patterns_as_backtracking(spark, seed):
    rng = random.Random(seed)
    triples = sorted({(rng.choice("abcd"), rng.choice(["p", "q", "r"]), rng.choice("abcd")) for _ in range(25)})
    table = spark.createDataFrame(triples * 2, "s string, p string, o string")
    cases = [
        ([("?x", "p", "?y"), ("?y", "q", "?z")], []), ([("?x", "p", "?y"), ("?y", "q", "?z"), ("?z", "r", "?x")], []), ([("?x", "p", "?x")], [("?x", "r", "?w")]), ([("a", "p", "?y"), ("?z", "q", "?y"), ("?z", "?any", "b"), ("?y", "r", "?w")], []),
        ([("?x", "p", "?y")], [("?y", "q", "?z"), ("?x", "r", "?w")]),
    ]
    for patterns, optional in cases:
        found = G.match(table, patterns, optional, repeated=True)
        names = found.columns
        expected = sorted((tuple(s.get(n) for n in names) for s in _solutions(triples, patterns, optional)), key=repr)
        assert sorted(map(tuple, found.collect()), key=repr) == expected, (patterns, optional)


def test_patterns_without_a_link_are_refused(spark):
    table = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    with pytest.raises(ValueError, match="links"):
        G.match(table, [("?x", "p", "?y"), ("?z", "p", "?w")])
    with pytest.raises(ValueError, match="optional"):
        G.match(table, [("?x", "p", "?y")], [("?z", "p", "?w")])


def test_triples_are_read_as_written(spark, tmp_path):
    odd = ['a "quoted" word', "line\nfeed\r\ttab", "back\\slash \\n \\u0041", "é 日本 😀", "", "x" * 50_000 + "\n" * 5_000, '" . # "', "<not> <an> <iri> ."]
    rows = [(i, i, "m", t, "fixed", t, "gemma2:9b x") for i, t in enumerate(odd)] + [(99, 99, None, None, "fixed", None, "m")]
    facts = spark.createDataFrame(rows, "id long, notebook_execution_id long, failing_module string, command string, outcome string, new_error_type string, llm_model string")
    triples = G.repair_triples(facts.withColumn("created_at", F.lit("2025-01-02 03:04:05").cast("timestamp")))
    G.write_triples(triples, str(tmp_path / "t"))
    back = G.read_triples(spark.read.text(str(tmp_path / "t")), "value").collect()
    assert sorted(tuple(r)[:3] for r in back) == sorted(map(tuple, triples.select("s", "p", "o").collect())) and {r.error for r in back} == {None}


def test_lines_of_others(spark):
    good = {
        "<http://x/a>  <http://x/b>\t<http://x/c> . # note": ("<http://x/a>", "<http://x/b>", "<http://x/c>"), '<urn:notebook-repair:a><urn:notebook-repair:b>"v".': ("repr:a", "repr:b", '"v"'),
        '<a:a> <a:b> "\\u00e9\\U0001F600\\\'"@en-GB .': ("<a:a>", "<a:b>", '"é😀\'"@en-GB'), '<a:a> <a:b> "1"^^<http://www.w3.org/2001/XMLSchema#int> .': ("<a:a>", "<a:b>", '"1"^^xsd:int'), '<a:a> <a:b> "say \\"x\\" ." . # "y" .': ("<a:a>", "<a:b>", '"say \\"x\\" ."'),
    }
    bad = ["<a:a> <a:b> .", "<a:a> <a:b> <c d> .", '<a:a> <a:b> "x', '<a:a> <a:b> "x" ', '<a:a> "b" <a:c> .', '<a:a> <a:b> "\\q" .', "_:b <a:b> <a:c> .", '<a:a> <a:b> "x"^^int .', "text"]
    lines = [*good, *bad, "", "   ", "# comment", None]
    got = G.read_triples(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert sorted(tuple(r)[:3] for r in got if r.error is None) == sorted(good.values())
    assert sorted(r.error for r in got if r.error is not None) == sorted(bad)


# runs


def test_a_run_is_written_again(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = lambda rows: spark.createDataFrame(rows, "run_id string, round int, x long")
    read = lambda: sorted(map(tuple, S.read_runs(spark, path, frame([]).schema).collect()))
    S.commit_runs(frame([("007", 1, 1), ("007", 2, 2), ("b", 1, 3)]), path, by=("round",))
    S.commit_runs(frame([("b", 1, 4), ("b", 1, 4)]), path, by=("round",))
    assert read() == [("007", 1, 1), ("007", 2, 2), ("b", 1, 4), ("b", 1, 4)]
    torn = frame([("007", 1, 50), ("c", 1, 51)]).withColumn("version", F.lit("torn"))
    torn.write.mode("append").partitionBy("version", "run_id", "round").parquet(f"{path}/data")  # the manifest is never written
    assert read() == [("007", 1, 1), ("007", 2, 2), ("b", 1, 4), ("b", 1, 4)]
    S.commit_runs(frame([]), path, runs=["007"], by=("round",))
    assert read() == [("b", 1, 4), ("b", 1, 4)]
    assert "torn" in S.drop_old_versions(spark, path) and read() == [("b", 1, 4), ("b", 1, 4)]
    assert {(r.run_id, r.rows) for r in S.committed_versions(spark, path).collect()} == {("007", 0), ("b", 2)}


def test_margins_and_nulls_are_told_apart(spark):
    rows = [(s, m, r, o) for (s, m, r), o in zip(itertools.product(["s", None], ["a", "b"], [1, 2]), ["fixed", "x"] * 4)] * 2
    found = A.success_rate_cube(spark.createDataFrame(rows, "subtype string, llm_model string, round int, outcome string"), "subtype", "llm_model", "round").collect()
    expected = {}
    for row in rows:
        for level in range(8):
            key = tuple(None if level >> (2 - k) & 1 else row[k] for k in range(3))
            n, fixed = expected.get((level, key), (0, 0))
            expected[level, key] = (n + 1, fixed + (row[3] == "fixed"))
    assert {(r.level, (r.subtype, r.llm_model, r.round)): (r.attempted, r.fixed) for r in found} == expected and len(found) == len(expected)
    assert expected[4, (None, "a", 1)] != expected[0, (None, "a", 1)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replies_and_fixes_are_dealt_out_before_they_are_parsed(spark):
    from faultsieve.plans.catalog import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert _plan(t.facts).count("RepartitionByExpression") == 2
    assert "Generate" not in _plan(t.outcomes).split("RepartitionByExpression", 1)[1]


def test_facts_are_made_once_for_all_commits(spark, monkeypatch):
    from faultsieve.plans import catalog
    from faultsieve.sources import storage

    plans, commit = [], storage.commit_runs
    monkeypatch.setattr(storage, "commit_runs", lambda rows, *a, **k: plans.append(_plan(rows)) or commit(rows, *a, **k))
    catalog.QUERIES["sink_repair_attempts"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Generate" in p or "Join" in p for p in plans)
