"""SQL building blocks for DuckDB: the derived tables and the classified failures as common table expressions."""

from __future__ import annotations

from ..operators import rules as R
from ..sources.fixtures import FIXTURES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values) + ")"


def module_sql(m: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({m}, {quoted(p)}, 'i') THEN split_part(regexp_extract({m}, {quoted(p)}, 1, 'i'), '.', 1)" for p in R.MODULE_PATTERNS)
    return f"CASE {whens} ELSE regexp_extract({m}, {quoted(R.LIBRARY_PATTERN)}, 1) END"


DATASET = {
    "d1": f"""SELECT notebook_execution_id, repository_run_id, repository_id, notebook_id, notebook_name, repository_url, execution_status, error_type, error_category, error_message,
  error_cell_index, error_count, created_at, {module_sql("coalesce(error_message, '')")} AS failing_module FROM f_executions WHERE error_category = 'DEPENDENCY_ERROR'""",
    "d2": f"""SELECT *, CASE WHEN contains(error_message, '.so') OR contains(error_message, 'shared object file') THEN 'system_library' WHEN failing_module IN {among(R.LOCAL_MODULES)} THEN 'mapping_unknown'
  WHEN error_type = 'ModuleNotFoundError' OR contains(error_message, 'No module named') THEN 'missing_package' WHEN contains(error_message, 'cannot import name') THEN 'wrong_version'
  WHEN contains(lower(error_message), 'install') OR contains(lower(error_message), 'required') THEN 'missing_package' ELSE 'out_of_scope' END AS subtype FROM d1""",
    "ds": f"""SELECT *, CASE WHEN subtype IN ('missing_package', 'wrong_version') THEN 'usable' ELSE 'excluded' END AS scope_status,
  CASE subtype WHEN 'system_library' THEN 'requires system library, outside pip-only scope' WHEN 'mapping_unknown' THEN 'ambiguous local/module-path import'
    WHEN 'out_of_scope' THEN 'unsupported dependency-error pattern' ELSE '' END AS exclusion_reason,
  CASE WHEN subtype NOT IN ('missing_package', 'wrong_version') THEN 'excluded' WHEN notebook_execution_id IN {among(R.DEV_IDS)} THEN 'dev' ELSE 'evaluation' END AS split FROM d2""",
}
REFINED = {
    "r1": f"""SELECT *, lower(trim(failing_module)) AS lm, lower(error_message) AS low, CASE WHEN lower(trim(failing_module)) IN {among(R.MISMATCHES)} THEN 'import_distribution_name_mismatch' ELSE 'direct_missing_package' END AS direct FROM ds""",
    "r2": f"""SELECT *, CASE WHEN contains(error_message, '.so') OR contains(low, 'shared object file') THEN 1 WHEN lm IN {among(R.LOCAL_MODULES)} THEN 2 WHEN contains(low, 'cannot import name') THEN 3
  WHEN (error_type = 'ModuleNotFoundError' OR contains(low, 'no module named')) THEN CASE WHEN lm = '' THEN 4 ELSE 5 END
  WHEN contains(low, 'install') OR contains(low, 'required') THEN CASE WHEN lm = '' THEN 4 ELSE 6 END WHEN error_type = 'ImportError' THEN 7 ELSE 8 END AS rule FROM r1""",
    "rf": """SELECT *, CASE rule WHEN 1 THEN 'system_library' WHEN 2 THEN CASE WHEN subtype IN ('mapping_unknown', 'out_of_scope') THEN subtype ELSE 'mapping_unknown' END WHEN 3 THEN 'wrong_version' WHEN 4 THEN 'mapping_unknown'
    WHEN 5 THEN 'missing_package' WHEN 6 THEN 'missing_package' WHEN 7 THEN 'wrong_version' ELSE 'out_of_scope' END AS refined_subtype,
  CASE WHEN rule IN (1, 3, 5) THEN 'high' WHEN rule IN (6, 7) THEN 'medium' ELSE 'low' END AS confidence,
  CASE rule WHEN 1 THEN 'system_level_dependency' WHEN 2 THEN 'local_import_or_path_issue' WHEN 3 THEN 'version_or_api_incompatibility' WHEN 5 THEN direct WHEN 6 THEN direct WHEN 7 THEN 'transitive_dependency' ELSE 'insufficient_context' END AS root_cause_hint FROM r2""",
}
PHRASE = "regexp_extract(error_message, " + quoted(R.CANNOT_IMPORT) + ", 0, 'i')"
LEGACY = {
    "h1": f"""SELECT r.notebook_execution_id, l.id AS legacy_id, l.msg, CASE WHEN error_message <> '' AND contains(l.msg, error_message) THEN true
  WHEN error_type = 'ModuleNotFoundError' OR contains(low, 'no module named') THEN trim(failing_module) <> '' AND (contains(l.msg, 'No module named ' || chr(39) || trim(failing_module) || chr(39)) OR contains(l.msg, 'No module named "' || trim(failing_module) || '"'))
  WHEN contains(low, 'cannot import name') THEN {PHRASE} <> '' AND contains(l.msg, {PHRASE}) ELSE false END AS ok
  FROM rf r JOIN f_legacy l ON l.notebook_id = r.notebook_id WHERE r.failing_module <> '' AND contains(l.msg, r.failing_module)""",
    "h2": "SELECT notebook_execution_id, min(legacy_id) FILTER (WHERE ok) AS legacy_id, true AS seen FROM h1 GROUP BY 1",
    "h3": """SELECT r.*, h.legacy_id, l.msg AS legacy_msg, coalesce(h.seen, false) AND h.legacy_id IS NULL AS legacy_hint_rejected,
  CASE WHEN regexp_matches(l.msg, '(?s)executing the following cell:\\s*\\n-+\\n(.*?)\\n-+\\n') THEN trim(regexp_extract(l.msg, '(?s)executing the following cell:\\s*\\n-+\\n(.*?)\\n-+\\n', 1), chr(10) || chr(32) || chr(9)) END AS legacy_cell
  FROM rf r LEFT JOIN h2 h USING (notebook_execution_id) LEFT JOIN f_legacy l ON l.id = h.legacy_id""",
}
REFS = "SELECT 0 AS rank, 'commit' AS kind UNION ALL SELECT 1, 'main' UNION ALL SELECT 2, 'master'"
SOURCES = {
    "refs": REFS,
    "s1": """SELECT e.*, p.repository, p.commit_ref, p.requirements, p.setups, p.pipfiles, p.pipfile_locks FROM h3 e LEFT JOIN f_repositories p ON p.id = e.repository_id""",
    "s2": """SELECT s1.notebook_execution_id, arg_min(s.content, k.rank) AS content, arg_min(s.ref, k.rank) AS ref FROM s1 CROSS JOIN refs k
  JOIN f_snapshot s ON s.repository = s1.repository AND s.path = s1.notebook_name AND s.ref = CASE k.kind WHEN 'commit' THEN s1.commit_ref ELSE k.kind END GROUP BY 1""",
    "s3": """SELECT s1.*, s2.content, s2.ref FROM s1 LEFT JOIN s2 USING (notebook_execution_id)""",
    "p1": """SELECT notebook_execution_id, repository, commit_ref, field_no, unnest(string_split(paths, ';')) AS raw, unnest(range(len(string_split(paths, ';')))) AS place FROM s1,
  LATERAL (SELECT 0 AS field_no, requirements AS paths UNION ALL SELECT 1, setups UNION ALL SELECT 2, pipfiles UNION ALL SELECT 3, pipfile_locks) f WHERE paths IS NOT NULL AND repository <> ''""",
    "p2": """SELECT *, trim(raw) AS path, row_number() OVER (PARTITION BY notebook_execution_id, field_no ORDER BY place) - 1 AS pos FROM p1 WHERE trim(raw) <> ''""",
    "p3": """SELECT p2.notebook_execution_id, p2.field_no, p2.pos, p2.path, arg_min(s.ref, k.rank) AS ref, arg_min(s.content, k.rank) AS content FROM p2 CROSS JOIN refs k
  LEFT JOIN f_snapshot s ON s.repository = p2.repository AND s.path = p2.path AND s.ref = CASE k.kind WHEN 'commit' THEN p2.commit_ref ELSE k.kind END GROUP BY 1, 2, 3, 4""",
    "c1": """SELECT notebook_execution_id, error_cell_index, content, CAST(CASE WHEN json_valid(content) THEN json_array_length(content, '$.cells') END AS BIGINT) AS n FROM s3""",
    "c2": """SELECT *, unnest(range(n)) AS cell_index, unnest(json_extract(content, '$.cells[*]')) AS cell FROM c1 WHERE n > 0""",
    "c3": """SELECT *, json_extract_string(cell, '$.cell_type') AS cell_type, CASE WHEN json_type(cell, '$.source') = 'ARRAY' THEN array_to_string(from_json(json_extract(cell, '$.source'), '["VARCHAR"]'), '')
    ELSE coalesce(json_extract_string(cell, '$.source'), '') END AS source FROM c2""",
    "c4": """SELECT *, cell_type = 'code' AND regexp_matches(source, '(?m)^\\s*(import|from)\\s+\\S+') AS imports FROM c3""",
    "c5": """SELECT notebook_execution_id, max(source) FILTER (WHERE cell_index = error_cell_index) AS failing_cell,
  string_agg(cell_index || ':' || source, '|' ORDER BY cell_index) FILTER (WHERE imports) AS import_cells, string_agg(cell_index || ':' || source, '|' ORDER BY cell_index) FILTER (WHERE abs(cell_index - error_cell_index) <= 2) AS surrounding_cells
  FROM c4 GROUP BY 1""",
    "ctx": """SELECT s3.*, c5.failing_cell, coalesce(c5.import_cells, '') AS import_cells, coalesce(c5.surrounding_cells, '') AS surrounding_cells, c5.notebook_execution_id IS NOT NULL AS remote,
  CASE WHEN c5.notebook_execution_id IS NOT NULL THEN 'remote_fetched' WHEN s3.legacy_id IS NOT NULL THEN 'legacy_execution_hint' ELSE 'source_not_found' END AS context_status FROM s3 LEFT JOIN c5 USING (notebook_execution_id)""",
}
FENCE = "repeat(chr(96), 3)"
RESPONSES = {
    # NaN and the like are numbers, which nothing here asks the value of
    "a0": """SELECT *, regexp_replace(trim(coalesce(raw_response, '')), 'NaN|-?Infinity', '0', 'g') AS t FROM f_responses""",
    "a1": f"""SELECT *, CASE WHEN strpos(t, {FENCE}) > 0 THEN split_part(substr(t, strpos(t, {FENCE})), {FENCE}, 2) END AS block FROM a0""",
    "a2": """SELECT *, CASE WHEN block IS NOT NULL THEN trim(substr(block, strpos(block, chr(10)) + 1), chr(10) || ' ') END AS fence, regexp_extract(t, '(?s)\\{.*\\}', 0) AS span FROM a1""",
    "a3": """SELECT *, CASE WHEN t <> '' AND json_valid(t) THEN t WHEN fence IS NOT NULL AND json_valid(fence) THEN fence WHEN span <> '' AND json_valid(span) THEN span END AS payload,
  CASE WHEN t <> '' AND json_valid(t) THEN 'whole' WHEN fence IS NOT NULL AND json_valid(fence) THEN 'fenced' WHEN span <> '' AND json_valid(span) THEN 'embedded' END AS shape FROM a2""",
    "a4": """SELECT *, CASE WHEN payload IS NULL THEN 'invalid_json: no JSON object found in model response' WHEN json_type(payload) <> 'OBJECT' THEN 'non_object_json: model response must be a JSON object' END AS parse_error FROM a3""",
    "a5": """SELECT *, CASE WHEN parse_error IS NOT NULL THEN parse_error ELSE concat_ws('; ', CASE WHEN json_exists(payload, '$.extra') THEN '<root>: additional extra; evidence/1: type; evidence/2: type' END, CASE WHEN json_exists(payload, '$.suggested_fix') THEN '<root>: additional suggested_fix' END,
    CASE WHEN NOT json_exists(payload, '$.limitations') THEN '<root>: required limitations' END, CASE WHEN json_extract_string(payload, '$.explanation_confidence') = 'sure' THEN 'explanation_confidence: enum' END, CASE WHEN json_extract_string(payload, '$.limitations') = '' THEN 'limitations: minLength' END) END AS errors FROM a4""",
    "a6": """SELECT *, kind = 'reply' AND errors = '' AS valid, CASE WHEN kind <> 'reply' THEN kind WHEN errors = '' THEN NULL WHEN errors LIKE 'invalid_json%' THEN 'invalid_json' ELSE 'schema_validation_error' END AS category FROM a5""",
    "a7": """SELECT *, valid OR category = 'runtime_error' OR attempt > 1 AS stops FROM a6""",
    "a8": """SELECT *, min(attempt) FILTER (WHERE stops) OVER (PARTITION BY notebook_execution_id) AS stop_at FROM a7""",
    "oc": """SELECT notebook_execution_id, CASE WHEN arg_max(valid, attempt) THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT arg_max(valid, attempt) THEN arg_max(category, attempt) END AS failure_category,
  max(attempt) AS attempts, arg_max(raw_response, attempt) FILTER (WHERE kind = 'reply') AS raw, arg_max_null(tokens_input, attempt) AS tokens_input, arg_max_null(tokens_output, attempt) AS tokens_output, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
  arg_max(payload, attempt) AS payload FROM a8 WHERE attempt <= stop_at GROUP BY 1""",
}
VERSION_KEY = """SELECT *, CAST(split_part(version, '.', 1) AS BIGINT) AS v1, CAST(regexp_extract(version, '^\\d+\\.(\\d+)', 1) AS BIGINT) AS v2, CASE WHEN contains(version, 'rc') THEN 3 WHEN regexp_matches(version, 'b\\d') THEN 2 WHEN contains(version, 'dev') AND NOT contains(version, 'post') THEN 0 ELSE 4 END AS phase,
  coalesce(TRY_CAST(regexp_extract(version, '(?:b|rc)(\\d+)', 1) AS BIGINT), 0) AS number, CASE WHEN contains(version, 'post') THEN 1 ELSE -1 END AS post, coalesce(TRY_CAST(regexp_extract(version, 'dev(\\d+)', 1) AS BIGINT), 99) AS dev FROM g1"""
PYTHON = "3.11"
RELEASES = {
    "g1": "SELECT distribution_name, version, bool_and(yanked) AS yanked, arg_min_null(requires_python, struct_pack(y := yanked, i := coalesce(requires_python = '>=3.12', false), n := requires_python IS NULL, f := filename)) AS requires_python, max(yanked_reason) FILTER (WHERE yanked) AS yanked_reason, count(*) AS files FROM f_releases GROUP BY 1, 2",
    "g2": VERSION_KEY,
    # of the requirements that occur, 3.11 is against >=3.12 alone
    "g3": """SELECT *, CASE WHEN yanked THEN 'yanked' WHEN phase < 4 OR dev < 99 THEN 'pre-release' WHEN requires_python = '>=3.12' THEN 'incompatible requires-python' END AS excluded, CASE WHEN requires_python IS NULL THEN 'unknown' WHEN requires_python = '>=3.12' THEN 'incompatible' ELSE 'compatible' END AS python_compatibility,
  row_number() OVER (PARTITION BY distribution_name ORDER BY v1 DESC, v2 DESC, phase DESC, number DESC, post DESC, dev DESC, version DESC) AS position FROM g2""",
    "g4": "SELECT *, row_number() OVER (PARTITION BY distribution_name ORDER BY position) AS rank FROM g3 WHERE excluded IS NULL QUALIFY rank <= 5",
    "names": "SELECT * FROM (VALUES ('sklearn', 'scikit-learn'), ('umap', 'umap-learn'), ('pkg_resources', 'setuptools'), ('scipy', 'scipy'), ('numpy', 'numpy'), ('pandas', 'pandas'), ('Bio', 'biopython')) n(import_name, distribution_name)",
    "k1": "SELECT DISTINCT failing_module AS import_name FROM ds",
    "k2": """SELECT k1.import_name, n.distribution_name, l.http_status, l.parse_ok, l.retrieved_at, (SELECT count(*) FROM g4 WHERE g4.distribution_name = n.distribution_name) AS found, (SELECT arg_min(version, position) FROM g3 WHERE g3.distribution_name = n.distribution_name) AS latest
  FROM k1 LEFT JOIN names n USING (import_name) LEFT JOIN f_lookups l ON l.distribution_name = n.distribution_name""",
    "k3": """SELECT *, CASE WHEN distribution_name IS NULL THEN 'mapping_unknown' WHEN http_status = 404 THEN 'package_not_found' WHEN http_status IS NULL OR http_status <> 200 THEN 'network_error' WHEN NOT parse_ok THEN 'invalid_response'
  WHEN found = 0 THEN 'no_compatible_release' ELSE 'resolved' END AS status FROM k2""",
}
RELEASES["kc"] = """SELECT import_name, CASE WHEN status = 'resolved' THEN 'PyPI retrieval status: resolved' || chr(10) || 'Python import name: ' || import_name || chr(10) || 'Resolved distribution name: ' || distribution_name || chr(10) || 'Notebook Python version: 3.11' || chr(10)
  || 'Latest available version: ' || coalesce(latest, 'Not available') || chr(10) || chr(10) || 'Candidate versions:' || chr(10) || (SELECT string_agg('- ' || version || ' | requires_python: ' || coalesce(requires_python, 'Not available') || ' | python_compatibility: ' || python_compatibility || ' | yanked: ' || yanked, chr(10) ORDER BY rank)
    FROM g4 WHERE g4.distribution_name = k3.distribution_name)
  ELSE 'PyPI retrieval status: ' || status || chr(10) || 'Python import name: ' || import_name || chr(10) || 'Resolved distribution name: ' || coalesce(distribution_name, 'Not available') || chr(10) || CASE WHEN status = 'mapping_unknown' THEN 'PyPI query: Not performed' ELSE 'PyPI query: Completed' END || chr(10) || 'Reason: ' ||
    CASE status WHEN 'package_not_found' THEN 'The resolved distribution was not found on PyPI.' WHEN 'no_compatible_release' THEN 'No stable release that is not yanked fits the notebook.' WHEN 'network_error' THEN 'PyPI could not be reached.'
      WHEN 'invalid_response' THEN 'The response could not be read.' ELSE 'No verified import-to-distribution mapping is available.' END || chr(10) || chr(10) || 'Candidate versions:' || chr(10) || 'Not available' END
  || chr(10) || chr(10) || 'API-level compatibility evidence:' || chr(10) || 'Not available' AS context FROM k3"""
_REPAIR_MODULE = module_sql("new_error_message")
REPAIRS = {
    "y1": "SELECT r.*, e.notebook_execution_id AS root, 1 AS round FROM f_reruns r JOIN f_executions e ON e.notebook_execution_id = r.parent_execution_id",
    "y2": "SELECT r.*, y1.root, 2 AS round FROM f_reruns r JOIN y1 ON r.parent_execution_id = y1.notebook_execution_id AND r.run_id = y1.run_id",
    "ch": """SELECT root AS notebook_execution_id, run_id, round, notebook_execution_id AS execution_id, execution_status, error_type, error_message FROM (SELECT * FROM y1 UNION ALL SELECT * FROM y2)
  QUALIFY row_number() OVER (PARTITION BY root, run_id, round ORDER BY created_at DESC, notebook_execution_id DESC) = 1""",
    "ft": """SELECT a.id, a.notebook_execution_id, d.failing_module, d.subtype, CASE WHEN oc.status = 'success' THEN 's {x}' END AS explanation, a.action, a.install_name, a.version, a.command, 'because of ' || a.id AS rationale,
  '{"chosen_version":' || CASE WHEN x.flaw = 4 THEN '1.5' ELSE coalesce('"' || a.version || '"', 'null') END || ',"latest_version":"1.14.0"' || CASE WHEN x.flaw = 3 THEN '' ELSE ',"requires_python":">=3.10"' END || '}' AS pypi_evidence, a.outcome,
  CASE WHEN a.outcome = 'still_failing' THEN ch.error_type END AS new_error_type, CASE WHEN a.outcome = 'still_failing' THEN ch.error_message END AS new_error_message, a.llm_model, a.prompt_strategy, a.round, a.run_id, a.created_at
  FROM f_attempts a JOIN f_fixes x ON x.attempt_id = a.id LEFT JOIN ds d USING (notebook_execution_id) LEFT JOIN oc USING (notebook_execution_id) LEFT JOIN ch ON ch.notebook_execution_id = a.notebook_execution_id AND ch.run_id = a.run_id AND ch.round = a.round""",
    "wl": f"""SELECT notebook_execution_id, id, run_id, 2 AS round, new_error_type, new_error_message, CASE WHEN new_error_message IS NOT NULL THEN {_REPAIR_MODULE} END AS failing_module,
  CASE new_error_type WHEN 'ModuleNotFoundError' THEN 'missing_package' WHEN 'ImportError' THEN 'wrong_version' WHEN 'NameError' THEN 'out_of_scope' END AS subtype, CASE WHEN new_error_type = 'NameError' THEN 'excluded' WHEN new_error_type IS NOT NULL THEN 'usable' END AS scope_status
  FROM ft WHERE round = 1 AND outcome = 'still_failing' AND NOT EXISTS (SELECT 1 FROM ft b WHERE b.round = 2 AND b.notebook_execution_id = ft.notebook_execution_id AND b.run_id = ft.run_id AND b.id % 7 <> 0)""",
    "im": """SELECT notebook_execution_id, string_agg(line, chr(10) ORDER BY cell_index, k) AS imports FROM (SELECT notebook_execution_id, cell_index, unnest(string_split(source, chr(10))) AS line, unnest(range(len(string_split(source, chr(10))))) AS k FROM c4 WHERE imports)
  WHERE regexp_matches(line, '^\\s*(import|from)\\s+\\S+') GROUP BY 1""",
    "rq": """SELECT notebook_execution_id, string_agg('# ' || path || chr(10) || content, chr(10) ORDER BY field_no, pos) AS requirements FROM p3 WHERE content <> '' GROUP BY 1""",
    "pr": """SELECT a.notebook_execution_id, a.run_id, 1 AS round, c.error_type, c.error_message, c.failing_module, c.legacy_msg AS traceback, NULL AS prior FROM f_attempts a JOIN ctx c USING (notebook_execution_id) WHERE a.round = 1
  UNION ALL SELECT w.notebook_execution_id, w.run_id, 2, w.new_error_type, w.new_error_message, w.failing_module, NULL, 'round 1: ' || f.action || ', command: ' || coalesce(f.command, 'none') || ', outcome: ' || f.outcome || coalesce(chr(10) || 'new error: ' || f.new_error_type || ': ' || f.new_error_message, '')
  FROM wl w JOIN ft f ON f.id = w.id JOIN ds ON ds.notebook_execution_id = w.notebook_execution_id""",
}

BLOCKS = {**{k: v for k, v in FIXTURES.items()}, **DATASET, **REFINED, **LEGACY, **SOURCES, **RESPONSES, **RELEASES, **REPAIRS}


def with_blocks(body: str) -> str:
    """The body behind those blocks that it needs."""
    import re

    names, queue = set(), [body]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        new = [n for n in BLOCKS if n in words and n not in names]
        names.update(new)
        queue += [BLOCKS[n] for n in new]
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in BLOCKS if n in names) + "\n" + body if names else body
