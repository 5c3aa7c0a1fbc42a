"""Failure tables derived from the given tables; the SQL text is the same for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MODULE_CASE = """CASE user_id % 12 WHEN 0 THEN 'sklearn' WHEN 1 THEN 'pkg_resources' WHEN 2 THEN 'scipy.integrate' WHEN 3 THEN 'numpy'
    WHEN 4 THEN 'utils.io' WHEN 5 THEN 'umap' WHEN 6 THEN 'cv2' WHEN 7 THEN 'dms_variants' WHEN 8 THEN 'Bio'
    WHEN 9 THEN 'statistics' WHEN 10 THEN 'openslide-bin' ELSE 'keras' END"""

FIXTURES = {
    "f_executions": f"""
SELECT event_id AS notebook_execution_id, user_id AS notebook_id, user_id % 40 AS repository_id,
  user_id % 40 + 1000 AS repository_run_id, 'nb/n' || CAST(user_id AS VARCHAR(20)) || '.ipynb' AS notebook_name,
  'https://host.example/org/repo' || CAST(user_id % 40 AS VARCHAR(20)) AS repository_url, 'FAILED' AS execution_status,
  CASE WHEN event_id % 13 IN (0,1,2,3,4,5) THEN 'ModuleNotFoundError' WHEN event_id % 13 = 12 THEN 'NameError' ELSE 'ImportError' END AS error_type,
  CASE WHEN event_id % 13 = 12 THEN 'OTHER' ELSE 'DEPENDENCY_ERROR' END AS error_category,
  CASE WHEN event_id % 13 IN (0,1,2,3,4,5) THEN 'No module named ' || chr(39) || m || chr(39)
       WHEN event_id % 13 IN (6,7) THEN 'cannot import name ' || chr(39) || 'foo' || chr(39) || ' from ' || chr(39) || m || chr(39) || ' (/tmp/x.py)'
       WHEN event_id % 13 = 8 THEN 'libxcb.so.1: cannot open shared object file: No such file or directory'
       WHEN event_id % 13 = 9 THEN m || ' is required for plotting'
       WHEN event_id % 13 = 10 THEN 'You need to install `' || m || '` to be able to use this feature.'
       WHEN event_id % 13 = 11 THEN 'DLL load failed while importing x'
       ELSE 'name x is not defined' END AS error_message,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 7 END AS error_cell_index, 1 AS error_count,
  20 AS total_code_cells, event_id % 20 AS executed_cells, ts AS created_at
FROM (SELECT event_id, user_id, ts, {MODULE_CASE} AS m FROM events WHERE event_type = 'error') b""",
    "f_legacy": f"""
SELECT event_id AS id, user_id AS notebook_id,
  'An error occurred while executing the following cell:' || chr(10) || '------' || chr(10) || 'import os' || chr(10) || 'import ' || m || chr(10) || '------' || chr(10) ||
  CASE event_id % 3 WHEN 0 THEN 'ModuleNotFoundError: No module named ' || chr(39) || m || chr(39)
    WHEN 1 THEN 'ModuleNotFoundError: No module named ' || chr(39) || 'pandas' || chr(39) ELSE 'NameError: x' END AS msg
FROM (SELECT event_id, user_id, {MODULE_CASE} AS m FROM events WHERE event_type = 'click' AND user_id % 4 <> 3) b""",
    "f_repositories": """
SELECT DISTINCT user_id % 40 AS id, CASE WHEN user_id % 40 = 13 THEN '' WHEN user_id % 40 = 14 THEN NULL ELSE 'org/repo' || CAST(user_id % 40 AS VARCHAR(20)) END AS repository,
  CASE WHEN (user_id % 40) % 5 = 0 THEN NULL ELSE 'c' || CAST(user_id % 40 AS VARCHAR(20)) END AS commit_ref,
  CASE WHEN (user_id % 40) % 4 = 0 THEN NULL ELSE 'requirements.txt; env/dev.txt ;' END AS requirements,
  CASE WHEN (user_id % 40) % 3 = 0 THEN 'setup.py' ELSE NULL END AS setups,
  CAST(NULL AS VARCHAR(20)) AS pipfiles, CAST(NULL AS VARCHAR(20)) AS pipfile_locks
FROM events""",
    "f_snapshot": """
SELECT DISTINCT 'org/repo' || CAST(user_id % 40 AS VARCHAR(20)) AS repository,
  CASE user_id % 3 WHEN 0 THEN 'c' || CAST(user_id % 40 AS VARCHAR(20)) WHEN 1 THEN 'main' ELSE 'master' END AS ref,
  'nb/n' || CAST(user_id AS VARCHAR(20)) || '.ipynb' AS path,
  CASE WHEN user_id % 11 = 0 THEN 'not a notebook' WHEN user_id % 11 = 1 THEN '{"cells":[]}' ELSE
  '{"cells":[{"cell_type":"markdown","source":["import nothing"]},{"cell_type":"code","source":["import os' || chr(92) || 'n","import a' || CAST(user_id AS VARCHAR(20)) || '"]},{"cell_type":"code","source":"x = 1"},{"cell_type":"code","source":"  from b import c"},{"cell_type":"code"}]}' END AS content
FROM events WHERE user_id % 6 <> 5
UNION
SELECT DISTINCT 'org/repo' || CAST(user_id % 40 AS VARCHAR(20)), CASE user_id % 40 % 2 WHEN 0 THEN 'main' ELSE 'master' END,
  CASE event_id % 2 WHEN 0 THEN 'requirements.txt' ELSE 'setup.py' END, 'numpy==1.' || CAST(user_id % 40 AS VARCHAR(20))
FROM events WHERE user_id % 40 % 7 <> 0""",
    "f_responses": """
SELECT event_id AS notebook_execution_id, a AS attempt,
  CASE WHEN k = 9 THEN 'timeout' WHEN k = 10 THEN 'model_unavailable' WHEN k = 11 THEN 'runtime_error' ELSE 'reply' END AS kind,
  CASE k WHEN 0 THEN j || lim || '}' WHEN 1 THEN 'Answer:' || chr(10) || repeat(chr(96), 3) || 'json' || chr(10) || j || lim || '}' || chr(10) || repeat(chr(96), 3) || chr(10) || 'Done.'
    WHEN 2 THEN 'Here is the result: ' || j || lim || '} Done.' WHEN 3 THEN 'not json' WHEN 4 THEN '[1, 2, 3]' WHEN 5 THEN j || '}'
    WHEN 6 THEN j || lim || ',"suggested_fix":"pip install x"}' WHEN 7 THEN j || ',"limitations":""}' WHEN 8 THEN 'Text with {open only'
    WHEN 12 THEN '{"summary":"","limitations":"old",' || substr(j, 2) || lim || '}' WHEN 13 THEN 'So: ' || replace(j, '["e"]', '["e",NaN,-Infinity]') || lim || ',"extra":{"a":1,"a":Infinity}}'
    WHEN 14 THEN replace(j, 'high', 'sure') || lim || '}' ELSE NULL END AS raw_response,
  CASE WHEN k IN (9, 10, 11) THEN NULL ELSE 1000 + event_id % 90 END AS tokens_input,
  CASE WHEN k IN (9, 10, 11) THEN NULL ELSE 130 + event_id % 40 END AS tokens_output,
  40000 + event_id % 9000 AS latency_ms
FROM (SELECT event_id, a, (event_id + a) % 15 AS k, '{"summary":"s {x}","root_cause":"r","evidence":["e"],"failing_module":"m' || CAST(user_id % 12 AS VARCHAR(20)) || '","explanation_confidence":"high"' AS j, ',"limitations":"l"' AS lim
  FROM events CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2 AS a) t WHERE event_type = 'error') b""",
    "f_releases": """
SELECT CASE p_partkey % 5 WHEN 0 THEN 'scikit-learn' WHEN 1 THEN 'setuptools' WHEN 2 THEN 'scipy' WHEN 3 THEN 'numpy' ELSE 'umap-learn' END AS distribution_name,
  CAST(p_partkey AS VARCHAR(20)) || '.whl' AS filename,
  CAST(p_size % 3 AS VARCHAR(20)) || '.' || CAST(p_partkey % 23 AS VARCHAR(20)) || CASE p_partkey % 9 WHEN 0 THEN 'b1' WHEN 1 THEN '.dev2' WHEN 2 THEN '.post1' WHEN 3 THEN 'rc2' WHEN 4 THEN 'b10' WHEN 5 THEN '.post1.dev3' WHEN 6 THEN 'rc10' ELSE '.0' END AS version,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '>=3.8,<3.12' WHEN 2 THEN '>=3.12' ELSE '>=3.10' END AS requires_python,
  p_partkey % 8 = 0 AS yanked, CASE WHEN p_partkey % 8 = 0 THEN 'security' ELSE NULL END AS yanked_reason
FROM part""",
    "f_lookups": """
SELECT *, '2025-03-01T12:00:00Z' AS retrieved_at FROM (SELECT 'scikit-learn' AS distribution_name, 200 AS http_status, true AS parse_ok
UNION ALL SELECT 'setuptools', 200, true UNION ALL SELECT 'scipy', 200, true UNION ALL SELECT 'numpy', 200, false
UNION ALL SELECT 'umap-learn', 503, false UNION ALL SELECT 'biopython', 404, false) t""",
}

ATTEMPTS = """
SELECT event_id * 10 + r AS id, event_id AS notebook_execution_id, r AS round,
  CASE event_id % 4 WHEN 0 THEN 'install' WHEN 1 THEN 'pin_version' WHEN 2 THEN 'none' ELSE 'install' END AS action,
  CASE WHEN event_id % 4 = 2 THEN NULL ELSE 'scipy' END AS install_name, CASE WHEN event_id % 4 = 1 THEN '1.13.1' ELSE NULL END AS version,
  CASE event_id % 4 WHEN 0 THEN 'pip install scipy' WHEN 1 THEN 'pip install scipy==1.13.1' WHEN 2 THEN NULL ELSE 'conda install scipy' END AS command,
  CASE WHEN (event_id + r) % 5 IN (0,1) THEN 'fixed' WHEN (event_id + r) % 5 = 2 THEN 'apply_error' ELSE 'still_failing' END AS outcome,
  CASE event_id % 2 WHEN 0 THEN 'model_a' ELSE 'model_b' END AS llm_model,
  CASE event_id % 3 WHEN 0 THEN 'zero_shot' ELSE 'few_shot' END AS prompt_strategy,
  'run' || CAST(event_id % 6 AS VARCHAR(20)) AS run_id, ts AS created_at
FROM events CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 AS r) t
WHERE event_type = 'error' AND (r = 1 OR (event_id + 1) % 5 IN (3,4))"""
#: A re-execution has this added to the id of the attempt that caused it.
RERUN = 1_000_000_000_000
_text = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"

FIXTURES |= {
    "f_attempts": ATTEMPTS,
    "f_plan": "SELECT event_id AS notebook_execution_id, CASE event_id % 5 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot' WHEN 2 THEN 'brief' WHEN 3 THEN 'broken' ELSE 'none' END AS prompt_strategy FROM events WHERE event_type = 'error'",
    # the proposals as the model wrote them: most are right, some lack evidence, have a number for a text, a field too many, or a key twice
    "f_fixes": f"""
SELECT id AS attempt_id, notebook_execution_id % 7 AS flaw, '{{"action":"' || action || '","import_name":"scipy","install_name":' || {_text("install_name")} || ',"version":' || {_text("version")} || ',"command":' || {_text("command")}
  || CASE notebook_execution_id % 7 WHEN 5 THEN ',"note":"n"' WHEN 6 THEN ',"rationale":""' ELSE '' END || ',"rationale":"because of ' || CAST(id AS VARCHAR(20)) || '","pypi_evidence":{{"latest_version":"1.14.0","chosen_version":'
  || CASE WHEN notebook_execution_id % 7 = 4 THEN '1.5' ELSE {_text("version")} END || CASE WHEN notebook_execution_id % 7 = 3 THEN '' ELSE ',"requires_python":">=3.10"' END || '}}}}' AS fix
FROM ({ATTEMPTS}) a""",
    # what running again showed; the second round runs what the first one left, some runs are of no known execution, some are repeated
    "f_reruns": f"""
SELECT id + {RERUN} + n AS notebook_execution_id, CASE WHEN id % 19 = 0 THEN -1 WHEN round = 1 THEN notebook_execution_id ELSE notebook_execution_id * 10 + 1 + {RERUN} END AS parent_execution_id, run_id,
  CASE outcome WHEN 'fixed' THEN 'SUCCESS' ELSE 'FAILED' END AS execution_status,
  CASE WHEN outcome = 'fixed' THEN NULL WHEN n <> 0 THEN 'TimeoutError' WHEN (id + round) % 3 = 0 THEN 'ModuleNotFoundError' WHEN (id + round) % 3 = 1 THEN 'ImportError' ELSE 'NameError' END AS error_type,
  CASE WHEN outcome = 'fixed' THEN NULL WHEN n <> 0 THEN 'too slow' WHEN (id + round) % 3 = 0 THEN 'No module named ' || chr(39) || 'dep' || CAST(round AS VARCHAR(20)) || '.core' || chr(39)
    WHEN (id + round) % 3 = 1 THEN 'cannot import name ' || chr(39) || 'bar' || chr(39) || ' from ' || chr(39) || 'lib' || CAST(round AS VARCHAR(20)) || chr(39) || ' (/tmp/y.py)' ELSE 'name y is not "known"' || chr(10) || 'at all' END AS error_message, created_at
FROM (SELECT a.*, 0 AS n FROM ({ATTEMPTS}) a UNION ALL SELECT b.*, -{RERUN // 2} AS n FROM ({ATTEMPTS}) b WHERE id % 5 = 0) c WHERE outcome <> 'apply_error'""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables in sf_dir, or one of those tables themselves."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(re.sub(r"\bFROM (events|part)\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", FIXTURES[name]))


def prefix(*names: str) -> str:
    """The derived tables as common table expressions for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in names)
