"""Rules, text, JSON and version functions on small tables with known results."""

import json

import pytest
from pyspark.sql import functions as F

from faultsieve.functions import jsontext as J
from faultsieve.functions import text as X
from faultsieve.functions import versions as V
from faultsieve.operators import dataset as D
from faultsieve.operators import rules as R

# id, error type, message, then module, first subtype, refined subtype, confidence, hint (fixed values)
GOLDEN = [
    (8, "ModuleNotFoundError", "No module named 'sklearn'", "sklearn", "missing_package", "missing_package", "high", "import_distribution_name_mismatch"),
    (10, "ImportError", 'matplotlib is required for plotting when the default backend "matplotlib" is selected.', "matplotlib", "missing_package", "missing_package", "medium", "direct_missing_package"),
    (17, "ImportError", "You need to install `seaborn` to be able to use this feature. It can be installed with `pip install seaborn`.", "seaborn", "missing_package", "missing_package", "medium", "direct_missing_package"),
    (19, "ModuleNotFoundError", "No module named 'pyrosm'", "pyrosm", "missing_package", "missing_package", "high", "direct_missing_package"),
    (15, "ImportError", "libxcb.so.1: cannot open shared object file: No such file or directory", "libxcb.so.1", "system_library", "system_library", "high", "system_level_dependency"),
    (157, "ImportError", "cannot import name 'isshape' from 'scipy.sparse.sputils' (/tmp/x.py)", "scipy", "wrong_version", "wrong_version", "high", "version_or_api_incompatibility"),
    (244, "ImportError", "cannot import name 'dataloader' from 'utils' (/tmp/x.py)", "utils", "mapping_unknown", "mapping_unknown", "low", "local_import_or_path_issue"),
    (249, "ModuleNotFoundError", "No module named 'utils.image_processor'", "utils", "mapping_unknown", "mapping_unknown", "low", "local_import_or_path_issue"),
    (277, "ImportError", "cannot import name 'NormalDist' from 'statistics' (/tmp/x.py)", "statistics", "mapping_unknown", "mapping_unknown", "low", "local_import_or_path_issue"),
    # traps: the two passes differ in case, order and the local set
    (1, "ImportError", "DLL load failed while importing x", "", "out_of_scope", "wrong_version", "medium", "transitive_dependency"),
    (2, "ImportError", "no module named 'foo'", "foo", "out_of_scope", "missing_package", "high", "direct_missing_package"),
    (3, "ModuleNotFoundError", "No module named 'foo.solver'", "foo", "system_library", "system_library", "high", "system_level_dependency"),
    (4, "ModuleNotFoundError", "cannot import name 'a' from 'b'", "b", "missing_package", "wrong_version", "high", "version_or_api_incompatibility"),
    (5, "ImportError", "please install .foo", "", "missing_package", "mapping_unknown", "low", "insufficient_context"),
    (6, None, None, "", "out_of_scope", "out_of_scope", "low", "insufficient_context"),
    (7, "ImportError", 'Missing optional dependency "Utils"', "Utils", "out_of_scope", "out_of_scope", "low", "local_import_or_path_issue"),
    (9, "OtherError", "'cv2' must be installed", "cv2", "missing_package", "missing_package", "medium", "import_distribution_name_mismatch"),
]


def classified(spark):
    rows = spark.createDataFrame([g[:3] for g in GOLDEN], "notebook_execution_id long, error_type string, error_message string")
    rows = rows.withColumn("failing_module", R.extract_failing_module(F.col("error_message")))
    rows = rows.withColumn("c", R.classify_subtype(F.col("error_type"), F.col("error_message"), F.col("failing_module"))).select("*", "c.*")
    return D.refined(rows.drop("c"))


def test_golden_rows(spark):
    got = {r.notebook_execution_id: r for r in classified(spark).collect()}
    for g in GOLDEN:
        r = got[g[0]]
        assert (r.failing_module, r.subtype, r.refined_subtype, r.confidence, r.root_cause_hint) == g[3:], g


def test_splits(spark):
    rows = spark.createDataFrame([(8, "usable"), (8, "excluded"), (9, "usable")], "id long, scope string")
    assert [r.s for r in rows.select(R.assign_split(F.col("id"), F.col("scope")).alias("s")).collect()] == ["dev", "excluded", "evaluation"]


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_first_rows_do_not_depend_on_partitions(spark, parts):
    rows = classified(spark).repartition(parts)
    top = [(r.failing_module, r["count"], r.first_id) for r in D.top_failing_modules(rows, 4).collect()]
    assert top == [("", 3, 1), ("foo", 2, 2), ("utils", 2, 244), ("b", 1, 4)]
    sample = D.stratified_sample(rows, {"missing_package": 2, "mapping_unknown": 0})
    assert sorted(r.notebook_execution_id for r in sample.where("refined_subtype = 'missing_package'").collect()) == [2, 8]
    assert sample.where("refined_subtype = 'mapping_unknown'").count() == 0 and sample.where("refined_subtype = 'out_of_scope'").count() == 2


def test_text_functions(spark):
    rows = spark.createDataFrame([(None,), ("",), ("\n a \t",), (" b c",), ("x" * 20,)], "t string")
    got = rows.select(X.strip(F.col("t")), X.collapse(F.col("t")), X.truncate_with_marker(F.col("t"), 10), X.or_missing(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, "", "a", "b c", "x" * 20]
    assert [r[1] for r in got[3:4]] == [" b c"]
    assert [r[2] for r in got] == ["", "", "\n a \t", " b c", "x" * 10 + "\n...[truncated]"]
    assert [r[3] for r in got] == ["Not available", "Not available", "a", "b c", "x" * 20]
    paths = spark.range(1).select(X.split_paths(F.lit("requirements.txt; env/dev.txt ; ;")).alias("p"), X.split_paths(F.lit(None).cast("string")).alias("n"), X.normalize_distribution(F.lit("A.._-b")).alias("d")).first()
    assert (paths.p, paths.n, paths.d) == (["requirements.txt", "env/dev.txt"], [], "a-b")


JSON_TEXTS = ['{"a":1}', '{"a":1} x', "[1,2]", "1", '"s"', "", "x", '{"a":1}{"b":2}', "1,2", '{"a":[1,{"b":"}"}]}', "{", "null", '{"a":', '{"a":1}]', '[1],[2]', '1}, "w":{', '{"v":1},"w":2']


def test_strict_json_agrees_with_python(spark):
    got = spark.createDataFrame([(t,) for t in JSON_TEXTS], "t string").select("t", J.strict(F.col("t")).isNotNull().alias("ok")).collect()

    def parses(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    for r in got:
        assert r.ok == parses(r.t), r.t


def test_fences_and_first_objects(spark):
    cases = [
        ('a ```json\n{"x": 1}\n``` b', '{"x": 1}', '{"x": 1}'), ("no fence", None, None), ("```", None, None), ("```json\nopen", None, None), ('t {"a": "}", "b": {}} {', None, '{"a": "}", "b": {}}'),
        ('{"a": "\\"}"} z', None, '{"a": "\\"}"}'), ("{open only", None, None), (r"x {\} } y", None, r"{\} }"), ("é {é} é", None, "{é}"),
    ]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", J.fenced(F.col("t")).alias("f"), J.first_object(F.col("t")).alias("o")).collect()
    for r, c in zip(rows, cases):
        assert (r.f, r.o) == c[1:], c


def test_version_order(spark):
    ordered = ["0.9", "1.0.dev1", "1.0a2", "1.0a10", "1.0b2.dev3", "1.0b2", "1.0.b10", "1.0rc1", "1.0rc2", "1.0-rc.10", "1.0", "1.0.post1.dev1", "1.0.post1", "1.0.post2", "1.0.0.0.0.0.0.0.1", "1.0.0.0.0.0.0.0.2", "1.9", "1.10", "2.0.0", "1!0.1"]
    rows = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r.v for r in rows.orderBy(V.version_key(F.col("v"))).collect()] == ordered
    flags = spark.createDataFrame([("1.0b1",), ("1.0.dev2",), ("1.0.post1",), ("x",), ("1.0",)], "v string").select(V.is_version(F.col("v")).alias("ok"), V.is_pre_release(F.col("v")).alias("pre")).collect()
    assert [(r.ok, r.pre) for r in flags] == [(True, True), (True, True), (True, False), (False, False), (True, False)]


def test_python_requirements(spark):
    cases = [
        (">=3.9", "3.10", "compatible"), (">=3.9", "3.8", "incompatible"), (None, "3.10", "unknown"), ("", "3.10", "unknown"), (">=3.8", None, "unknown"), (">=3.8,<3.12", "3.12", "incompatible"), ("<3.7", "3.13", "incompatible"),
        ("~=3.8", "3.13", "compatible"), ("~=3.8.1", "3.9", "incompatible"), ("==3.*", "3.11", "compatible"), ("!=3.11.*", "3.11.2", "incompatible"), ("==3.10", "3.10.0", "compatible"), (">3.10", "3.10", "incompatible"), ("<=3.10", "3.10.0", "compatible"), ("===3.10", "3.10", "compatible"), ("==3.0.*", "3", "compatible"), ("~=3.8.0", "3.8", "compatible"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, r string, p string")
    for r in rows.select("i", V.python_compatibility(F.col("r"), F.col("p")).alias("c")).collect():
        assert r.c == cases[r.i][2], cases[r.i]
