"""Registered queries against DuckDB on the smallest tables, and the entry module without the subpackage llm."""

import glob
import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

from faultsieve.plans import catalog  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "part", "labels"]
CHOSEN = [
    "scan_dependency_errors", "scan_csv_dataset", "scan_jsonl_records", "classify_subtype", "classify_refined", "quarantine_bad_rows", "join_legacy_hint", "join_source_snapshot", "join_dependency_files",
    "legacy_coverage", "split_manifest", "top_failing_modules", "validation_sample_projection", "prompt_context", "template_values", "render_prompts", "parse_and_validate", "reduce_attempts",
    "retrieval_results", "retrieval_context_text", "attempt_fact_table", "repair_triples", "label_agreement", "dataset_order", "sink_triples",
    "version_order", "latest_version", "release_grouping", "excluded_releases", "python_compatibility", "second_round_worklist", "repair_success_rate", "model_strategy_comparison", "explanation_outcomes", "dependency_file_counts",
]


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="no test data")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_without_llm(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "faultsieve.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES) == set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="no test data")
def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
