"""Plans of the queries that join most: how often they read a table and move rows."""

import re

import pytest

from faultsieve.operators import context as C
from faultsieve.operators import releases as V
from faultsieve.plans import catalog

TABLES = {
    "rows": "notebook_execution_id long, repository_id long, notebook_id long, notebook_name string, repository_url string, error_type string, error_message string, error_cell_index long, failing_module string, subtype string, refined_subtype string, confidence string, root_cause_hint string",
    "legacy": "id long, notebook_id long, msg string", "repositories": "id long, repository string, commit_ref string, requirements string, setups string, pipfiles string, pipfile_locks string",
    "snapshot": "repository string, ref string, path string, content string", "files": "distribution_name string, filename string, version string, requires_python string, yanked boolean, yanked_reason string",
    "lookups": "distribution_name string, http_status int, parse_ok boolean, retrieved_at string",
}


@pytest.fixture
def stored(spark, tmp_path):
    """Empty tables as files, so that scans show in plans; nothing is small enough to be broadcast."""

    def read(name):
        path = str(tmp_path / name)
        spark.createDataFrame([], TABLES[name]).write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLES[name]).parquet(path)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield read
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text, len(re.findall(r"FileScan parquet", text)), len(re.findall(r"Exchange hashpartitioning", text))


def test_records_read_each_table_once(stored):
    rows, legacy, repositories, snapshot = (stored(n) for n in ("rows", "legacy", "repositories", "snapshot"))
    _, scans, exchanges = _plan(C.enrich(rows, legacy, repositories, snapshot))
    assert scans == 4 and exchanges <= 5
    _, scans, exchanges = _plan(C.enrich(rows, legacy, repositories, snapshot, fetch=False))
    assert scans == 2 and exchanges <= 3


def test_release_keys_are_worked_out_once(spark, stored):
    names = spark.createDataFrame([("sklearn",)], "import_name string")
    text, scans, _ = _plan(V.retrieval_results(names, stored("lookups"), stored("files"), "3.11"))
    assert scans <= 3 and text.count("UDF") == 0 and len(text) < 130_000


def test_triples_are_read_by_predicate(spark):
    plan = catalog.QUERIES["graph_pattern_fixes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(p#") == 5 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
