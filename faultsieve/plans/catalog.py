"""Every operator as a query over the given tables, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.frames import positions
from ..functions.versions import python_compatibility
from ..operators import attempts as A
from ..operators import context as C
from ..operators import dataset as D
from ..operators import graph as G
from ..operators import lineage as L
from ..operators import prompts as P
from ..operators import releases as V
from ..operators import responses as Q
from ..operators import rules as R
from ..sources import storage as S
from ..sources.fixtures import table
from .oracle import PYTHON, quoted, with_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RUN_ID = "run-fixed"
MODEL = ("model_a", "few_shot", "dependency_explanation", "v1")


class Tables:
    """Tables of a folder and the stages that most queries begin with."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def dataset(self) -> DataFrame:
        return D.dataset(self.f_executions)

    @property
    def refined(self) -> DataFrame:
        return D.refined(self.dataset)

    @property
    def records(self) -> DataFrame:
        return C.enrich(self.refined, self.f_legacy, self.f_repositories, self.f_snapshot)

    @property
    def local_records(self) -> DataFrame:
        return C.enrich(self.refined, self.f_legacy, self.f_repositories, self.f_snapshot, fetch=False)

    @property
    def outcomes(self) -> DataFrame:
        return Q.reduce_attempts(self.f_responses)

    @property
    def judged(self) -> DataFrame:
        return V.judged_releases(V.release_grouping(self.f_releases, PYTHON), PYTHON)

    @property
    def results(self) -> DataFrame:
        return V.retrieval_results(self.dataset.select(F.col("failing_module").alias("import_name")), self.f_lookups, self.f_releases, PYTHON)

    @property
    def facts(self) -> DataFrame:
        told = self.outcomes.select("notebook_execution_id", F.col("explanation.summary").alias("explanation"))
        return A.attempt_facts(self.f_attempts, self.dataset, told, self.f_fixes, self.chain)

    @property
    def chain(self) -> DataFrame:
        return L.rerun_chain(self.f_executions, self.f_reruns)

    @property
    def pending(self) -> DataFrame:
        """Facts of a run that is not over: some second rounds are still to come."""
        return self.facts.where("round = 1 or id % 7 <> 0")

    @property
    def graph(self) -> DataFrame:
        """The triples of all attempts as a table with a partition for each predicate."""
        path = S.new_path(self.spark, "graph")
        triples = G.repair_triples(self.facts)
        triples.write.partitionBy("p").parquet(path)
        return self.spark.read.schema(triples.schema).parquet(path)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_blocks(sql)
        return f

    return add


# scans, sources, sinks

SCAN = "notebook_execution_id, repository_run_id, repository_id, notebook_id, notebook_name, repository_url, execution_status, error_type, error_category, error_message, error_cell_index, error_count"


@query("scan_dependency_errors", f"SELECT {SCAN}, created_at FROM f_executions WHERE error_category = 'DEPENDENCY_ERROR'")
def _(t):
    return S.scan_dependency_errors(t.f_executions)


@query("scan_legacy_executions", "SELECT id, notebook_id, msg FROM f_legacy")
def _(t):
    return S.scan_legacy_executions(t.f_legacy)


@query("scan_repositories", "SELECT * FROM f_repositories")
def _(t):
    return t.f_repositories


FLAT = "notebook_execution_id, error_message, error_cell_index, failing_module, subtype, scope_status, exclusion_reason, split"


@query("scan_csv_dataset", f"SELECT {FLAT} FROM ds")
def _(t):
    path = S.new_path(t.spark, "dataset-csv")
    S.write_csv(t.dataset.withColumn("created_at", F.col("created_at").cast("string")), path)
    return S.scan_csv(t.spark, path).select(*FLAT.split(", "))


@query("sink_csv_dataset", "SELECT split, subtype, count(*) AS rows, CAST(count(error_cell_index) AS BIGINT) AS with_cell FROM ds GROUP BY 1, 2")
def _(t):
    path = S.new_path(t.spark, "dataset-csv")
    S.write_csv(t.dataset.withColumn("created_at", F.col("created_at").cast("string")), path)
    return S.scan_csv(t.spark, path).groupBy("split", "subtype").agg(F.count("*").alias("rows"), F.count("error_cell_index").alias("with_cell"))


@query("scan_jsonl_records", "SELECT repository, ref, path, CASE WHEN NOT json_valid(content) THEN 'malformed JSON' END AS error FROM f_snapshot WHERE trim(content) <> ''")
def _(t):
    return S.scan_jsonl(t.f_snapshot, "content").select("repository", "ref", "path", "error")


@query("sink_jsonl_contexts", "SELECT notebook_execution_id, root_cause_hint, context_status, legacy_cell FROM ctx")
def _(t):
    path = S.new_path(t.spark, "contexts-json")
    records = t.records
    S.write_json(records, path)
    back = t.spark.read.schema(records.schema).json(path)
    return back.select("notebook_execution_id", "root_cause_hint", "context_status", F.col("legacy_traceback_hint.cell_source").alias("legacy_cell"))


@query("sink_results_append", f"SELECT '{RUN_ID}' AS run_id, status, count(*) AS rows FROM oc GROUP BY 2")
def _(t):
    path = S.new_path(t.spark, "results")
    rows = t.outcomes.select(F.lit(RUN_ID).alias("run_id"), "notebook_execution_id", "status", "failure_category")
    for part in (rows.where("status = 'failed'"), rows):  # the run is repeated, and counts once
        S.commit_runs(part, path)
    return S.read_runs(t.spark, path, rows.schema).groupBy("run_id", "status").agg(F.count("*").alias("rows"))


COUNTS = ["split", "subtype", "error_type", "scope_status"]
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS metric, {c} AS key, count(*) AS count FROM ds GROUP BY {c}" for c in COUNTS)


@query("sink_summary", COUNTS_SQL)
def _(t):
    path = S.new_path(t.spark, "summary")
    counts = D.value_counts(t.dataset, *COUNTS)
    counts.write.mode("overwrite").json(path)
    return t.spark.read.schema(counts.schema).json(path)


@query("sink_repair_attempts", "SELECT run_id, round, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids, count(new_error_type) AS new_errors FROM ft GROUP BY 1, 2")
def _(t):
    path = S.new_path(t.spark, "attempts")
    kept = S.new_path(t.spark, "facts")
    t.facts.write.parquet(kept)  # replies and fixes are parsed once for both commits
    facts = t.spark.read.parquet(kept)
    for part in (facts, facts.where("run_id in ('run1', 'run4')")):  # two runs are repeated, and replace what they wrote
        S.commit_runs(part, path, by=("round",))
    return S.read_runs(t.spark, path, facts.schema).groupBy("run_id", "round").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"), F.count("new_error_type").alias("new_errors"))


TRIPLES = """SELECT 'repr:notebook_' || a.notebook_execution_id AS s, 'repr:hadRepairAttempt' AS p, 'repr:repairattempt_' || a.id AS o FROM f_attempts a
UNION ALL SELECT 'repr:repairattempt_' || id, 'rdf:type', 'prov:Activity' FROM f_attempts UNION ALL SELECT 'repr:repairattempt_' || id, 'rdf:type', 'repr:RepairAttempt' FROM f_attempts
UNION ALL SELECT 'repr:repairattempt_' || a.id, 'repr:failingModule', '"' || d.failing_module || '"' FROM f_attempts a JOIN ds d USING (notebook_execution_id)
UNION ALL SELECT 'repr:repairattempt_' || id, 'repr:appliedFix', '"' || command || '"' FROM f_attempts WHERE command IS NOT NULL
UNION ALL SELECT 'repr:repairattempt_' || id, 'repr:fixOutcome', '"' || outcome || '"' FROM f_attempts
UNION ALL SELECT 'repr:repairattempt_' || id, 'repr:exception', '"' || new_error_type || '"' FROM ft WHERE new_error_type IS NOT NULL
UNION ALL SELECT 'repr:repairattempt_' || id, 'prov:wasAssociatedWith', 'repr:' || llm_model FROM f_attempts
UNION ALL SELECT 'repr:repairattempt_' || id, 'prov:endedAtTime', '"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || 'Z"^^xsd:dateTime' FROM f_attempts"""


def _iri_sql(c: str) -> str:
    names = " ".join(f"WHEN starts_with({c}, '{k}:') THEN '<{v}' || substr({c}, {len(k) + 2}) || '>'" for k, v in G.PREFIXES.items())
    return f"CASE WHEN {c} LIKE '\"%^^xsd:dateTime' THEN replace({c}, '^^xsd:dateTime', '^^<{G.PREFIXES['xsd']}dateTime>') {names} ELSE {c} END"


@query("sink_triples", f"SELECT {_iri_sql('s')} || ' ' || {_iri_sql('p')} || ' ' || {_iri_sql('o')} || ' .' AS line FROM ({TRIPLES})")
def _(t):
    path = S.new_path(t.spark, "triples")
    G.write_triples(G.repair_triples(t.facts), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("scan_triples", f"SELECT s, p, o, CAST(NULL AS VARCHAR) AS error FROM ({TRIPLES}) UNION ALL SELECT NULL, NULL, NULL, '<a> <b> \"' || outcome || '\" .x' FROM f_attempts WHERE id % 11 = 0")
def _(t):
    path = S.new_path(t.spark, "triples")
    broken = t.f_attempts.where("id % 11 = 0").select(F.concat(F.lit('<a> <b> "'), "outcome", F.lit('" .x')).alias("line"))
    G.triple_lines(G.repair_triples(t.facts)).union(broken).write.text(path)
    return G.read_triples(t.spark.read.text(path), "value")


# classification rules


@query("extract_failing_module", "SELECT notebook_execution_id, error_message, failing_module FROM d1")
def _(t):
    return S.scan_dependency_errors(t.f_executions).select("notebook_execution_id", "error_message", R.extract_failing_module(F.col("error_message")).alias("failing_module"))


@query("classify_subtype", "SELECT notebook_execution_id, subtype, scope_status, exclusion_reason FROM ds")
def _(t):
    return t.dataset.select("notebook_execution_id", "subtype", "scope_status", "exclusion_reason")


@query("scope_filter", "SELECT notebook_execution_id, subtype FROM ds WHERE scope_status = 'usable'")
def _(t):
    return t.dataset.where("scope_status = 'usable'").select("notebook_execution_id", "subtype")


@query("assign_split", "SELECT notebook_execution_id, split FROM ds")
def _(t):
    return t.dataset.select("notebook_execution_id", "split")


@query("normalize_error_fields", "SELECT notebook_execution_id, trim(error_type) AS error_type_normalized, trim(regexp_replace(error_message, '\\s+', ' ', 'g')) AS error_message_normalized, lower(trim(failing_module)) AS failing_module_normalized FROM ds")
def _(t):
    return t.dataset.select("notebook_execution_id", *R.normalized_fields(F.col("error_type"), F.col("error_message"), F.col("failing_module")))


@query("classify_refined", "SELECT notebook_execution_id, refined_subtype, confidence, root_cause_hint FROM rf")
def _(t):
    return t.refined.select("notebook_execution_id", "refined_subtype", "confidence", "root_cause_hint")


@query("import_name_mismatch", "SELECT failing_module, CASE lm WHEN 'sklearn' THEN 'scikit-learn' WHEN 'cv2' THEN 'opencv-python' END AS distribution, count(*) AS count FROM rf WHERE direct = 'import_distribution_name_mismatch' GROUP BY 1, 2")
def _(t):
    names = F.create_map(*[F.lit(x) for kv in R.MISMATCHES.items() for x in kv])
    rows = t.dataset.where(R.is_mismatch(F.col("failing_module")))
    return rows.groupBy("failing_module", names[F.lower("failing_module")].alias("distribution")).agg(F.count("*").alias("count"))


@query("local_module_filter", "SELECT notebook_execution_id, failing_module FROM rf WHERE lm IN ('utils', 'statistics', 'config', 'helpers', 'src')")
def _(t):
    return t.dataset.where(R.is_local(F.col("failing_module"))).select("notebook_execution_id", "failing_module")


@query("context_status", "SELECT notebook_execution_id, context_status FROM ctx")
def _(t):
    return t.records.select("notebook_execution_id", "context_status")


BAD = "notebook_execution_id % 5 = 0"


@query("quarantine_bad_rows", f"""SELECT CASE WHEN {BAD} THEN NULL ELSE notebook_execution_id END AS notebook_execution_id, notebook_id, repository_id, error_type, failing_module, subtype AS original_subtype,
  CASE WHEN {BAD} THEN subtype ELSE refined_subtype END AS refined_subtype, CASE WHEN {BAD} THEN 'low' ELSE confidence END AS confidence, CASE WHEN {BAD} THEN 'insufficient_context' ELSE root_cause_hint END AS root_cause_hint,
  CASE WHEN {BAD} THEN 'metadata_only' END AS context_status, {BAD} AS rejected FROM rf""")
def _(t):
    text = F.when(F.expr(BAD), F.concat(F.lit("x"), "notebook_execution_id")).otherwise(F.col("notebook_execution_id").cast("string"))
    return C.quarantine_bad_rows(t.refined.withColumn("notebook_execution_id", text))


@query("input_metadata_projection", "SELECT notebook_execution_id, error_type, error_message, failing_module, subtype AS original_subtype, refined_subtype, confidence AS classifier_confidence, root_cause_hint, context_status, error_cell_index FROM ctx")
def _(t):
    return t.records.select(Q.input_metadata().alias("i")).select("i.*")


@query("llm_metadata_projection", "SELECT notebook_execution_id, 'model_a' AS llm_model, 'few_shot' AS prompt_strategy, 'dependency_explanation' AS prompt_template, 'v1' AS prompt_version FROM ds")
def _(t):
    return t.dataset.select("notebook_execution_id", Q.llm_metadata(*MODEL).alias("l")).select("notebook_execution_id", "l.*")


ENDPOINT = "CASE WHEN distribution_name IS NOT NULL THEN '/simple/' || distribution_name || '/' END"
RETRIEVED = "CASE WHEN distribution_name IS NOT NULL THEN retrieved_at END"
FAILED = "CASE WHEN status IN ('network_error', 'invalid_response') THEN status END"
LISTED = "CASE WHEN status = 'resolved' THEN coalesce((SELECT string_agg(version || '|' || coalesce(requires_python, '') || '|' || python_compatibility, ';' ORDER BY rank) FROM g4 WHERE g4.distribution_name = k3.distribution_name), '') ELSE '' END"


def _flat(column: str = "candidate_versions"):
    return F.array_join(F.transform(column, lambda c: F.concat_ws("|", c.version, F.coalesce(c.requires_python, F.lit("")), c.python_compatibility)), ";")


@query("pypi_provenance_projection", f"SELECT import_name, distribution_name, status, '{PYTHON}' AS python_version, {ENDPOINT} AS source_endpoint, {LISTED} AS candidates, {FAILED} AS error, {RETRIEVED} AS retrieved_at FROM k3")
def _(t):
    return V.provenance(t.results).withColumn("candidates", _flat()).drop("candidate_versions")


@query("dependency_trigger", "SELECT error_type, CASE WHEN error_type IN ('ModuleNotFoundError', 'ImportError') THEN 'DEPENDENCY_ERROR' ELSE 'OTHER' END AS category, count(*) AS count FROM f_executions GROUP BY 1, 2")
def _(t):
    return t.f_executions.groupBy("error_type", R.dependency_category(F.col("error_type")).alias("category")).agg(F.count("*").alias("count"))


# joins


@query("join_legacy_hint", "SELECT notebook_execution_id, legacy_hint_rejected, CASE WHEN legacy_id IS NOT NULL THEN failing_module END AS matched_module, legacy_cell AS cell_source, substr(legacy_msg, 1, 4000) AS raw_traceback FROM h3")
def _(t):
    return C.join_legacy_hint(t.dataset, t.f_legacy).select("notebook_execution_id", "legacy_hint_rejected", "legacy_traceback_hint.*")


@query("legacy_match_predicate", "SELECT notebook_execution_id, legacy_id, ok FROM h1")
def _(t):
    rows = t.dataset.where("failing_module <> ''").join(t.f_legacy.select(F.col("id").alias("legacy_id"), "notebook_id", "msg"), "notebook_id").where(F.contains("msg", "failing_module"))
    return rows.select("notebook_execution_id", "legacy_id", R.legacy_matches(F.col("error_type"), F.col("error_message"), F.col("failing_module"), F.col("msg")).alias("ok"))


@query("join_repository", "SELECT notebook_execution_id, repository_id, repository, commit_ref, requirements FROM s1")
def _(t):
    return C.join_repository(t.dataset, t.f_repositories).select("notebook_execution_id", "repository_id", "repository", "commit_ref", "requirements")


@query("join_source_snapshot", "SELECT notebook_execution_id, ref, content FROM s3")
def _(t):
    return C.join_source_snapshot(C.join_repository(t.dataset, t.f_repositories), t.f_snapshot).select("notebook_execution_id", "ref", "content")


@query("join_dependency_files", "SELECT notebook_execution_id, field_no, pos, path, content IS NOT NULL AS fetched, ref, content FROM p3")
def _(t):
    return C.join_dependency_files(C.join_repository(t.dataset, t.f_repositories), t.f_snapshot)


@query("resolve_distribution", "SELECT failing_module AS import_name, n.distribution_name, CASE WHEN n.distribution_name IS NULL THEN 'mapping_unknown' ELSE 'mapped' END AS mapping_status, count(*) AS count FROM ds LEFT JOIN names n ON n.import_name = failing_module GROUP BY 1, 2, 3")
def _(t):
    return V.resolve_distribution(t.dataset.select(F.col("failing_module").alias("import_name"))).groupBy("import_name", "distribution_name", "mapping_status").agg(F.count("*").alias("count"))


@query("join_release_metadata", "SELECT l.distribution_name, l.http_status, f.filename, f.version FROM f_lookups l JOIN f_releases f USING (distribution_name)")
def _(t):
    return t.f_lookups.join(t.f_releases, "distribution_name").select("distribution_name", "http_status", "filename", "version")


@query("exclude_few_shot_rows", "SELECT notebook_execution_id FROM ds WHERE split <> 'dev' AND notebook_execution_id NOT IN (SELECT min(notebook_execution_id) FROM ds GROUP BY subtype)")
def _(t):
    shown = t.dataset.groupBy("subtype").agg(F.min("notebook_execution_id").alias("notebook_execution_id"))
    return t.dataset.where("split <> 'dev'").join(shown, "notebook_execution_id", "left_anti").select("notebook_execution_id")


@query("holdout_leak_check", "SELECT notebook_execution_id FROM ds WHERE split = 'evaluation' AND notebook_execution_id IN (8, 10, 17, 19, 43, 45, 49, 50, 60, 61, 157, 174, 188)")
def _(t):
    return D.holdout_leaks(t.dataset)


@query("stdlib_exclusion", "SELECT notebook_execution_id, failing_module FROM ds WHERE failing_module NOT IN ('statistics', 'json', 'os', 'sys', 're', 'math')")
def _(t):
    import sys

    names = t.spark.createDataFrame([(n,) for n in sorted(sys.stdlib_module_names)], "failing_module string")
    return t.dataset.join(F.broadcast(names), "failing_module", "left_anti").select("notebook_execution_id", "failing_module")


@query("legacy_coverage", """SELECT count(*) AS rows, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM f_legacy l WHERE l.notebook_id = ds.notebook_id)) AS with_legacy,
  count(*) FILTER (WHERE failing_module <> '' AND EXISTS (SELECT 1 FROM f_legacy l WHERE l.notebook_id = ds.notebook_id AND contains(l.msg, ds.failing_module))) AS mentioned FROM ds""")
def _(t):
    return C.legacy_coverage(t.dataset, t.f_legacy)


@query("join_attempts_to_failure", "SELECT a.id, a.round, a.outcome, d.failing_module, d.subtype FROM f_attempts a JOIN ds d USING (notebook_execution_id)")
def _(t):
    return t.f_attempts.join(t.dataset.select("notebook_execution_id", "failing_module", "subtype"), "notebook_execution_id").select("id", "round", "outcome", "failing_module", "subtype")


# aggregations


@query("dataset_counts", COUNTS_SQL)
def _(t):
    return D.value_counts(t.dataset, *COUNTS)


for _name in COUNTS:

    @query(f"{_name}_counts", f"SELECT {_name}, count(*) AS count FROM ds GROUP BY 1")
    def _(t, c=_name):
        return t.dataset.groupBy(c).agg(F.count("*").alias("count"))


@query("exclusion_reason_counts", "SELECT exclusion_reason, count(*) AS count FROM ds WHERE exclusion_reason <> '' GROUP BY 1")
def _(t):
    return D.exclusion_reason_counts(t.dataset)


@query("split_manifest", """SELECT s.split, d.notebook_execution_id AS id, CASE WHEN d.notebook_execution_id IS NOT NULL THEN row_number() OVER (PARTITION BY s.split ORDER BY d.notebook_execution_id) END AS position
  FROM (VALUES ('dev'), ('evaluation'), ('excluded')) s(split) LEFT JOIN ds d ON d.split = s.split""")
def _(t):
    return D.split_manifest(t.dataset)


@query("refinement_shift", "SELECT subtype AS original_subtype, refined_subtype, count(*) AS count FROM rf GROUP BY 1, 2")
def _(t):
    return D.refinement_shift(t.refined)


for _name, _column in (("confidence_distribution", "confidence"), ("root_cause_hint_counts", "root_cause_hint")):

    @query(_name, f"SELECT {_column}, count(*) AS count FROM rf GROUP BY 1")
    def _(t, c=_column):
        return t.refined.groupBy(c).agg(F.count("*").alias("count"))


@query("context_status_counts", "SELECT context_status, count(*) AS count FROM ctx GROUP BY 1")
def _(t):
    return t.records.groupBy("context_status").agg(F.count("*").alias("count"))


@query("hint_coverage", "SELECT count(legacy_id) AS with_hint, count(*) FILTER (WHERE legacy_hint_rejected) AS with_rejected_hint, count(*) FILTER (WHERE context_status = 'remote_fetched') AS remote_fetched, count(*) FILTER (WHERE context_status = 'metadata_only') AS metadata_only FROM ctx")
def _(t):
    return C.hint_coverage(t.records)


@query("dependency_file_counts", "SELECT count(*) AS attempted, count(content) AS fetched FROM p3")
def _(t):
    return C.dependency_file_counts(C.join_dependency_files(C.join_repository(t.dataset, t.f_repositories), t.f_snapshot))


@query("reason_share", "SELECT error_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM f_executions GROUP BY 1")
def _(t):
    return D.reason_share(t.f_executions)


@query("release_grouping", "SELECT * FROM g1")
def _(t):
    return V.release_grouping(t.f_releases, PYTHON)


@query("retrieval_status_counts", "SELECT status, count(*) AS count FROM k3 GROUP BY 1")
def _(t):
    return t.results.groupBy("status").agg(F.count("*").alias("count"))


@query("explanation_outcomes", "SELECT 'model_a' AS llm_model, 'few_shot' AS prompt_strategy, 'v1' AS prompt_version, context_status, status, failure_category, count(*) AS count, CAST(sum(attempts) AS BIGINT) AS attempts FROM oc JOIN ctx USING (notebook_execution_id) GROUP BY ALL")
def _(t):
    rows = t.outcomes.join(t.records.select("notebook_execution_id", "context_status"), "notebook_execution_id").select("*", Q.llm_metadata(*MODEL).alias("llm")).select("*", "llm.*")
    return Q.explanation_outcomes(rows, "llm_model", "prompt_strategy", "prompt_version", "context_status")


@query("latency_token_profile", "SELECT round(avg(latency_ms), 6) AS mean_ms, quantile_cont(latency_ms, 0.5) AS median_ms, max(latency_ms) AS max_ms, CAST(sum(tokens_input) AS BIGINT) AS tokens_input, CAST(sum(tokens_output) AS BIGINT) AS tokens_output FROM oc")
def _(t):
    return Q.latency_token_profile(t.outcomes)


RATE = "count(*) AS attempted, count(*) FILTER (WHERE outcome = 'fixed') AS fixed, round(count(*) FILTER (WHERE outcome = 'fixed') / count(*), 6) AS rate"


@query("repair_success_rate", f"SELECT subtype, llm_model, prompt_strategy, round, run_id, {RATE} FROM f_attempts LEFT JOIN ds USING (notebook_execution_id) GROUP BY 1, 2, 3, 4, 5")
def _(t):
    rows = t.f_attempts.join(t.dataset.select("notebook_execution_id", "subtype"), "notebook_execution_id", "left")
    return A.success_rate(rows, "subtype", "llm_model", "prompt_strategy", "round", "run_id")


DIMENSIONS = ["subtype", "llm_model", "prompt_strategy", "round", "run_id"]


@query("repair_rate_margins", f"""SELECT {', '.join(DIMENSIONS)}, CAST(GROUPING({', '.join(DIMENSIONS)}) AS BIGINT) AS level, count(*) AS attempted, count(*) FILTER (WHERE outcome = 'fixed') AS fixed,
  round(count(*) FILTER (WHERE outcome = 'fixed') / count(*), 6) AS rate FROM f_attempts LEFT JOIN ds USING (notebook_execution_id) GROUP BY CUBE ({', '.join(DIMENSIONS)})""")
def _(t):
    rows = t.f_attempts.join(t.dataset.select("notebook_execution_id", "subtype"), "notebook_execution_id", "left")
    return A.success_rate_cube(rows, *DIMENSIONS)


@query("ablation_rounds", """SELECT one_round, all_rounds, count(*) AS failures FROM (SELECT arg_max(outcome, id) FILTER (WHERE round = 1) AS one_round, arg_max(outcome, round) AS all_rounds FROM f_attempts GROUP BY notebook_execution_id) GROUP BY 1, 2""")
def _(t):
    return A.ablation_rounds(t.f_attempts)


@query("multi_granularity_rates", """, m AS (SELECT e.*, executed_cells / total_code_cells AS p, b.fixed FROM f_executions e JOIN (SELECT notebook_execution_id, max(CASE WHEN outcome = 'fixed' THEN 1 ELSE 0 END) AS fixed FROM f_attempts GROUP BY 1) b USING (notebook_execution_id))
SELECT 'notebook' AS level, CAST(notebook_id AS VARCHAR) AS key, count(*) AS failures, CAST(sum(fixed) AS BIGINT) AS fixed, round(avg(p), 6) AS progress FROM m GROUP BY 2
UNION ALL SELECT 'error_type', error_type, count(*), CAST(sum(fixed) AS BIGINT), round(avg(p), 6) FROM m GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), CAST(sum(fixed) AS BIGINT), round(avg(p), 6) FROM m""")
def _(t):
    return A.multi_granularity_rates(t.f_attempts, t.f_executions)


@query("label_agreement", """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), s AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE a = b) AS same FROM c),
e AS (SELECT sum(x.n * y.n) AS chance FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1) x JOIN (SELECT b, sum(n) AS n FROM c GROUP BY 1) y ON x.a = y.b)
SELECT CAST(t AS BIGINT) AS n, round(same / t, 6) AS observed, round((same / t - chance / (t * t)) / (1 - chance / (t * t)), 6) AS kappa FROM s, e""")
def _(t):
    return D.label_agreement(t.labels, "quality", "toxic")


# windows, top-k, samples

SAMPLE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY refined_subtype ORDER BY notebook_execution_id) AS k, min(notebook_execution_id) OVER (PARTITION BY refined_subtype) AS bucket FROM ctx)
  WHERE k <= CASE refined_subtype WHEN 'missing_package' THEN 10 WHEN 'wrong_version' THEN 10 WHEN 'system_library' THEN 5 ELSE k END"""


@query("stratified_sample", f"SELECT notebook_execution_id, refined_subtype FROM ({SAMPLE})")
def _(t):
    return D.stratified_sample(t.refined).select("notebook_execution_id", "refined_subtype")


@query("validation_sample_projection", f"SELECT notebook_execution_id, error_type, error_message, failing_module, subtype AS original_subtype, refined_subtype, confidence, root_cause_hint, context_status, '' AS manual_label, '' AS notes, bucket FROM ({SAMPLE})")
def _(t):
    return D.validation_sample(t.records.withColumnRenamed("original_subtype", "subtype"))


@query("top_failing_modules", "SELECT failing_module, count(*) AS count, min(notebook_execution_id) AS first_id FROM ds GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 20")
def _(t):
    return D.top_failing_modules(t.dataset)


@query("dataset_order", "SELECT notebook_execution_id, row_number() OVER (ORDER BY notebook_execution_id) AS position FROM ds")
def _(t):
    return positions(t.dataset.select("notebook_execution_id"), "notebook_execution_id")


@query("record_slice", "SELECT notebook_execution_id, failing_module FROM (SELECT *, row_number() OVER (ORDER BY notebook_execution_id) AS k FROM ds WHERE notebook_execution_id >= 100) WHERE k <= 50")
def _(t):
    return P.record_slice(t.dataset, "notebook_execution_id", start=100, limit=50).select("notebook_execution_id", "failing_module")


@query("release_top5", "SELECT distribution_name, version, rank FROM g4")
def _(t):
    return V.release_top5(t.judged).select("distribution_name", "version", "rank")


@query("latest_version", "SELECT distribution_name, arg_min(version, position) AS latest_version FROM g3 GROUP BY 1")
def _(t):
    return V.latest_version(t.judged)


@query("first_n_import_cells", "SELECT repository, ref, path, coalesce(string_agg(i || ':' || s, '|' ORDER BY i) FILTER (WHERE k <= 5), '') AS cells FROM (SELECT *, row_number() OVER (PARTITION BY repository, ref, path ORDER BY i) AS k FROM (" "SELECT repository, ref, path, unnest(range(5)) AS i, unnest(['import nothing', 'import os' || chr(10) || 'import a' || regexp_extract(path, 'n(\\d+)\\.ipynb', 1), 'x = 1', '  from b import c', '']) AS s FROM f_snapshot WHERE content LIKE '{\"cells\":[{%') WHERE i IN (1, 3)) GROUP BY 1, 2, 3")
def _(t):
    rows = t.f_snapshot.withColumn("c", C.notebook_context(F.col("content"), F.lit(0))).where("c is not null")
    return rows.select("repository", "ref", "path", F.array_join(F.transform("c.import_cells", lambda x: F.concat_ws(":", x.cell_index, x.source)), "|").alias("cells"))


@query("surrounding_cells", "SELECT notebook_execution_id, failing_cell, import_cells, surrounding_cells FROM ctx WHERE remote")
def _(t):
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.cell_index, x.source)), "|")
    rows = C.join_source_snapshot(C.join_repository(t.dataset, t.f_repositories), t.f_snapshot).withColumn("c", C.notebook_context(F.col("content"), F.col("error_cell_index"))).where("c is not null")
    return rows.select("notebook_execution_id", F.col("c.failing_cell_source").alias("failing_cell"), flat("c.import_cells").alias("import_cells"), flat("c.surrounding_cells").alias("surrounding_cells"))


@query("top_missing_modules_legacy", "SELECT module, count(*) AS count, min(id) AS first_id FROM (SELECT id, split_part(regexp_extract(msg, 'No module named ''([^'']+)''', 1), '.', 1) AS module FROM f_legacy) WHERE module <> '' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 20")
def _(t):
    module = F.split_part(F.regexp_extract("msg", "No module named ['\"]([^'\"]+)['\"]", 1), F.lit("."), F.lit(1))
    rows = t.f_legacy.select("id", module.alias("module")).where("module <> ''")
    return rows.groupBy("module").agg(F.count("*").alias("count"), F.min("id").alias("first_id")).orderBy(F.desc("count"), "first_id").limit(20)


# set operations and text functions


@query("merge_result_rows", "SELECT notebook_execution_id, status, failure_category FROM oc UNION ALL SELECT notebook_execution_id, 'render_failed', 'render_failed' FROM ds WHERE split = 'excluded'")
def _(t):
    lost = P.render(t.dataset.where("split = 'excluded'"), "bad={{unknown_field}}", {})
    return Q.merge_result_rows(t.outcomes, lost).select("notebook_execution_id", "status", "failure_category")


@query("extract_cell_source", "SELECT id, trim(regexp_extract(msg, '(?s)executing the following cell:\\s*\\n-+\\n(.*?)\\n-+\\n', 1), chr(10) || ' ') AS cell_source FROM f_legacy")
def _(t):
    return t.f_legacy.select("id", C.cell_source(F.col("msg")).alias("cell_source"))


@query("truncate_with_marker", "SELECT notebook_execution_id, attempt, CASE WHEN raw_response IS NULL THEN '' WHEN length(raw_response) <= 100 THEN raw_response ELSE substr(raw_response, 1, 100) || chr(10) || '...[truncated]' END AS text FROM f_responses")
def _(t):
    return t.f_responses.select("notebook_execution_id", "attempt", X.truncate_with_marker(F.col("raw_response"), 100).alias("text"))


@query("notebook_cells", """SELECT repository, ref, path, i AS cell_index, k AS cell_type, s AS source FROM (SELECT repository, ref, path, unnest(range(5)) AS i, unnest(['markdown', 'code', 'code', 'code', 'code']) AS k,
  unnest(['import nothing', 'import os' || chr(10) || 'import a' || regexp_extract(path, 'n(\\d+)\\.ipynb', 1), 'x = 1', '  from b import c', '']) AS s FROM f_snapshot WHERE content LIKE '{"cells":[{%')""")
def _(t):
    return C.notebook_cells(t.f_snapshot)


@query("notebook_context", "SELECT notebook_execution_id, remote, failing_cell FROM ctx")
def _(t):
    rows = C.join_source_snapshot(C.join_repository(t.dataset, t.f_repositories), t.f_snapshot).withColumn("c", C.notebook_context(F.col("content"), F.col("error_cell_index")))
    return rows.select("notebook_execution_id", F.col("c").isNotNull().alias("remote"), F.col("c.failing_cell_source").alias("failing_cell"))


@query("prompt_context", """SELECT notebook_execution_id, refined_subtype AS subtype, coalesce(nullif(failing_cell, ''), legacy_cell) AS failing_cell_source, import_cells, surrounding_cells, context_status,
  coalesce((SELECT string_agg(path || ':' || (content IS NOT NULL) || ':' || coalesce(ref, '') || ':' || coalesce(content, ''), '|' ORDER BY field_no, pos) FROM p3 WHERE p3.notebook_execution_id = ctx.notebook_execution_id), '') AS dependency_files FROM ctx""")
def _(t):
    cells = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.cell_index, x.source)), "|")
    files = F.array_join(F.transform("p.dependency_files", lambda f: F.concat(f.path, F.lit(":"), f.fetched.cast("string"), F.lit(":"), F.coalesce(f.ref, F.lit("")), F.lit(":"), F.coalesce(f.content, F.lit("")))), "|")
    rows = t.records.select("notebook_execution_id", F.col("prompt_context").alias("p"))
    return rows.select("notebook_execution_id", "p.subtype", "p.failing_cell_source", cells("p.import_cells").alias("import_cells"), cells("p.surrounding_cells").alias("surrounding_cells"), "p.context_status", files.alias("dependency_files"))


def _cells_json(column: str, keep: str) -> str:
    item = "'  {' || chr(10) || '    \"cell_index\": ' || cell_index || ',' || chr(10) || '    \"source\": ' || to_json(source) || chr(10) || '  }'"
    return f"coalesce((SELECT '[' || chr(10) || string_agg({item}, ',' || chr(10) ORDER BY cell_index) || chr(10) || ']' FROM c4 WHERE c4.notebook_execution_id = ctx.notebook_execution_id AND {keep}), 'Not available') AS {column}"


@query("template_values", f"""SELECT notebook_execution_id, confidence AS classifier_confidence, coalesce(CAST(error_cell_index AS VARCHAR), 'Not available') AS error_cell_index, coalesce(nullif(failing_module, ''), 'Not available') AS failing_module,
  coalesce(nullif(trim(coalesce(nullif(failing_cell, ''), legacy_cell)), ''), 'Not available') AS failing_cell_source, {_cells_json("import_cells", "imports")}, {_cells_json("surrounding_cells", "abs(c4.cell_index - c4.error_cell_index) <= 2")}, coalesce(trim(legacy_msg), 'Not available') AS legacy_traceback_hint FROM ctx""")
def _(t):
    values = P.template_values()
    return t.records.select(F.col("notebook_execution_id"), *[values[n].alias(n) for n in ("classifier_confidence", "error_cell_index", "failing_module", "failing_cell_source", "import_cells", "surrounding_cells", "legacy_traceback_hint")])


def _fill_sql(template: str, values: dict[str, str]) -> str:
    parts = P.PLACEHOLDER.split(template)
    return " || ".join(values[p] if i % 2 else quoted(p) for i, p in enumerate(parts))


_gap = lambda c: f"coalesce(nullif(trim(CAST({c} AS VARCHAR)), ''), 'Not available')"
LOCAL_VALUES = {n: _gap(n) for n in ("notebook_execution_id", "error_type", "error_message", "refined_subtype", "root_cause_hint", "failing_module", "error_cell_index")} | {
    "original_subtype": "subtype", "classifier_confidence": "confidence", "context_status": "CASE WHEN legacy_id IS NULL THEN 'metadata_only' ELSE 'legacy_execution_hint' END", "failing_cell_source": _gap("legacy_cell"),
    "import_cells": "'Not available'", "surrounding_cells": "'Not available'", "dependency_files": "'Not available'", "legacy_traceback_hint": _gap("legacy_msg"),
}


@query("render_prompts", f"SELECT notebook_execution_id, {_fill_sql(P.with_strategy(P.EXPLANATION_TEMPLATE, 'zero_shot'), LOCAL_VALUES)} AS prompt FROM h3")
def _(t):
    return P.render(t.local_records, P.with_strategy(P.EXPLANATION_TEMPLATE, "zero_shot"), P.template_values()).select("notebook_execution_id", "prompt")


@query("retry_prompt", """SELECT notebook_execution_id, 'The previous response was invalid.' || chr(10) || chr(10) || 'Validation errors:' || chr(10) || '- ' || replace(errors, '; ', chr(10) || '- ') || chr(10) || chr(10) || 'Previous response:' || chr(10) || raw_response
  || chr(10) || chr(10) || 'Return the corrected answer as one valid JSON object and nothing else, after this original prompt:' || chr(10) || 'P' || notebook_execution_id || chr(10) AS prompt FROM a6 WHERE kind = 'reply' AND NOT valid AND attempt = 1""")
def _(t):
    rows = Q.judged(t.f_responses).where("kind = 'reply' and not valid and attempt = 1")
    return rows.select("notebook_execution_id", P.retry_prompt(F.concat(F.lit("P"), "notebook_execution_id"), F.col("raw_response"), F.col("errors")).alias("prompt"))


@query("unwrap_legacy_hint", "SELECT notebook_execution_id, legacy_msg AS hint FROM h3")
def _(t):
    return C.join_legacy_hint(t.dataset, t.f_legacy).select("notebook_execution_id", F.col("legacy_traceback_hint.raw_traceback").alias("hint"))


_UNKNOWN = "'PyPI retrieval status: mapping_unknown' || chr(10) || 'Python import name: ' || r.failing_module || chr(10) || 'Resolved distribution name: Not available' || chr(10) || 'PyPI query: Not performed' || chr(10) || 'Reason: No verified import-to-distribution mapping is available.' || chr(10) || chr(10) || 'Candidate versions:' || chr(10) || 'Not available' || chr(10) || chr(10) || 'API-level compatibility evidence:' || chr(10) || 'Not available'"
REPAIR_VALUES = {
    "error_context": "coalesce(nullif(concat_ws(chr(10), nullif(concat_ws(': ', r.error_type, r.error_message), ''), 'failing module: ' || nullif(r.failing_module, ''), 'traceback:' || chr(10) || substr(r.traceback, 1, 4000)), ''), 'Not available')",
    "current_requirements": "coalesce(q.requirements, 'Not available')", "notebook_imports": "coalesce(trim(i.imports), 'Not available')",
    "pypi_versions": f"coalesce(k.context, {_UNKNOWN}, 'Not available')", "prior_attempt": "coalesce(r.prior, 'Not available')",
}


@query("render_repair_prompts", f"SELECT r.notebook_execution_id, r.run_id, r.round, {_fill_sql(P.with_strategy(P.REPAIR_TEMPLATE, 'zero_shot'), REPAIR_VALUES)} AS prompt FROM pr r LEFT JOIN rq q USING (notebook_execution_id) LEFT JOIN im i USING (notebook_execution_id) LEFT JOIN kc k ON k.import_name = r.failing_module")
def _(t):
    facts = S.settled(t.pending, "facts")
    work = S.settled(A.second_round_worklist(facts), "worklist")
    names = t.dataset.select("failing_module").union(work.select("failing_module")).where("failing_module is not null").select(F.col("failing_module").alias("import_name"))
    releases = V.retrieval_context_text(V.retrieval_results(names, t.f_lookups, t.f_releases, PYTHON))
    asked = P.repair_requests(t.records, work, releases, facts, t.f_attempts.where("round = 1"))
    return P.render(asked, P.with_strategy(P.REPAIR_TEMPLATE, "zero_shot"), P.repair_values()).select("notebook_execution_id", "run_id", "round", "prompt")


#: Strategies and their templates as rows; the last names a value that is not there.
TEMPLATES = [(s, P.with_strategy(P.EXPLANATION_TEMPLATE, s)) for s in ("zero_shot", "few_shot")] + [("brief", "{{failing_module}} of {{notebook_execution_id}}: {{error_message}}"), ("broken", "{{error_type}} {{cause}}")]
_strategy_sql = " ".join(f"WHEN '{s}' THEN {_fill_sql(text, LOCAL_VALUES)}" for s, text in TEMPLATES[:3])


@query("few_shot_assembly", f"""SELECT notebook_execution_id, CASE prompt_strategy {_strategy_sql} END AS prompt,
  CASE prompt_strategy WHEN 'broken' THEN 'KeyError: Unknown template placeholder: cause' WHEN 'none' THEN 'no template for none' END AS error FROM h3 JOIN f_plan USING (notebook_execution_id)""")
def _(t):
    templates = t.spark.createDataFrame(TEMPLATES, "prompt_strategy string, template string")
    records = t.local_records.join(t.f_plan, "notebook_execution_id")
    return P.render_from_table(records, templates, P.template_values(), ["prompt_strategy"]).select("notebook_execution_id", "prompt", "error")


@query("retrieval_context_text", "SELECT import_name, context FROM kc")
def _(t):
    return V.retrieval_context_text(t.results)


@query("normalize_distribution", "SELECT failing_module, regexp_replace(lower(failing_module), '[-_.]+', '-', 'g') AS normalized, count(*) AS count FROM ds GROUP BY 1, 2")
def _(t):
    return t.dataset.groupBy("failing_module", X.normalize_distribution(F.col("failing_module")).alias("normalized")).agg(F.count("*").alias("count"))


@query("distinct_requirements_paths", "SELECT DISTINCT path FROM p3")
def _(t):
    return t.f_repositories.select(F.explode(X.split_paths(F.col("requirements"))).alias("path")).union(t.f_repositories.select(F.explode(X.split_paths(F.col("setups"))))).distinct()


# responses


@query("extract_json_payload", "SELECT notebook_execution_id, attempt, shape, parse_error FROM a4 WHERE kind = 'reply'")
def _(t):
    return Q.extract_json(t.f_responses.where("kind = 'reply'")).select("notebook_execution_id", "attempt", "shape", "parse_error")


@query("reject_non_object", "SELECT notebook_execution_id, attempt FROM a4 WHERE kind = 'reply' AND parse_error LIKE 'non_object%'")
def _(t):
    return Q.extract_json(t.f_responses.where("kind = 'reply'")).where("parse_error like 'non_object%'").select("notebook_execution_id", "attempt")


@query("validate_explanations", "SELECT notebook_execution_id, attempt, errors FROM a5 WHERE kind = 'reply' AND parse_error IS NULL")
def _(t):
    return Q.parse_and_validate(t.f_responses.where("kind = 'reply'")).where("parse_error is null").select("notebook_execution_id", "attempt", F.array_join("errors", "; ").alias("errors"))


@query("parse_and_validate", "SELECT notebook_execution_id, attempt, valid, errors, CASE WHEN parse_error IS NULL THEN json_extract_string(payload, '$.failing_module') END AS module FROM a6 WHERE kind = 'reply'")
def _(t):
    return Q.parse_and_validate(t.f_responses.where("kind = 'reply'")).select("notebook_execution_id", "attempt", "valid", F.array_join("errors", "; ").alias("errors"), F.col("explanation.failing_module").alias("module"))


@query("violation_report", "SELECT split_part(e, ': ', 1) AS path, split_part(e, ': ', 2) AS rule, count(*) AS count FROM (SELECT unnest(string_split(errors, '; ')) AS e FROM a5 WHERE kind = 'reply' AND parse_error IS NULL AND errors <> '') GROUP BY 1, 2")
def _(t):
    return Q.violation_report(Q.parse_and_validate(t.f_responses.where("kind = 'reply'")))


@query("classify_failure", "SELECT notebook_execution_id, attempt, category FROM a6 WHERE kind = 'reply' AND NOT valid")
def _(t):
    return Q.judged(t.f_responses).where("kind = 'reply' and not valid").select("notebook_execution_id", "attempt", "category")


@query("retry_worklist", "SELECT notebook_execution_id, attempt, category FROM a6 WHERE attempt = 1 AND NOT valid AND category <> 'runtime_error'")
def _(t):
    return Q.retry_worklist(t.f_responses.where("attempt = 1"))


@query("reduce_attempts", "SELECT notebook_execution_id, status, failure_category, attempts, coalesce(raw, '') AS raw_response, tokens_input, tokens_output, latency_ms FROM oc")
def _(t):
    return t.outcomes.select("notebook_execution_id", "status", "failure_category", "attempts", "raw_response", "tokens_input", "tokens_output", "latency_ms")


@query("result_rows", f"SELECT '{RUN_ID}' AS run_id, ctx.notebook_execution_id, ctx.confidence AS classifier_confidence, ctx.context_status, 'model_a' AS llm_model, oc.status, oc.attempts FROM oc JOIN ctx USING (notebook_execution_id)")
def _(t):
    rows = Q.result_rows(t.records, t.outcomes, Q.llm_metadata(*MODEL), RUN_ID)
    return rows.select("run_id", "input.notebook_execution_id", "input.classifier_confidence", "input.context_status", "llm.llm_model", "explanation_result.status", "explanation_result.attempts")


@query("grounding_check", "SELECT notebook_execution_id, json_extract_string(payload, '$.failing_module') IS NOT DISTINCT FROM nullif(d.failing_module, '') AS module_ok, true AS text_ok FROM oc JOIN ds d USING (notebook_execution_id) WHERE status = 'success'")
def _(t):
    return Q.grounding_check(t.dataset, t.outcomes)


# package releases


@query("release_filter", "SELECT distribution_name, version, python_compatibility FROM g3 WHERE excluded IS NULL")
def _(t):
    return t.judged.where("excluded is null").select("distribution_name", "version", "python_compatibility")


@query("excluded_releases", "SELECT distribution_name, version, excluded AS reason FROM g3 WHERE excluded IS NOT NULL")
def _(t):
    return t.judged.where("excluded is not null").select("distribution_name", "version", F.col("excluded").alias("reason"))


@query("python_compatibility", """SELECT distribution_name, version, python, CASE WHEN python IS NULL OR requires_python IS NULL THEN 'unknown' WHEN requires_python = '>=3.10' THEN CASE WHEN python IN ('3.10', '3.13') THEN 'compatible' ELSE 'incompatible' END WHEN requires_python = '>=3.12' THEN CASE python WHEN '3.13' THEN 'compatible' ELSE 'incompatible' END
  ELSE CASE WHEN python IN ('3.8', '3.10') THEN 'compatible' ELSE 'incompatible' END END AS compatibility FROM g1 CROSS JOIN (VALUES ('3.7'), ('3.8'), ('3.10'), ('3.13'), (NULL)) v(python)""")
def _(t):
    pythons = F.explode(F.array(*[F.lit(v).cast("string") for v in ("3.7", "3.8", "3.10", "3.13", None)])).alias("python")
    rows = V.release_grouping(t.f_releases, PYTHON).select("distribution_name", "version", "requires_python", pythons)
    return rows.select("distribution_name", "version", "python", python_compatibility(F.col("requires_python"), F.col("python")).alias("compatibility"))


@query("version_order", "SELECT distribution_name, version, position FROM g3")
def _(t):
    return V.version_order(t.judged)


@query("retrieval_input_check", "SELECT notebook_execution_id, CASE WHEN failing_module = '' THEN 'import_name' ELSE '' END AS missing, failing_module <> '' AS accepted FROM ds")
def _(t):
    rows = t.dataset.select("notebook_execution_id", F.col("failing_module").alias("import_name"), "error_type", F.col("error_message").alias("traceback"))
    return V.retrieval_input_check(rows).select("notebook_execution_id", "missing", "accepted")


@query("retrieval_status", "SELECT import_name, distribution_name, status FROM k3")
def _(t):
    return t.results.select("import_name", "distribution_name", "status")


@query("retrieval_results", f"SELECT status, import_name, distribution_name, CASE WHEN http_status IN (200, 404) THEN http_status = 200 END AS package_found, '{PYTHON}' AS python_version, CASE WHEN status IN ('resolved', 'no_compatible_release') THEN latest END AS latest_version, {LISTED} AS candidates, {ENDPOINT} AS source_endpoint, {FAILED} AS error, {RETRIEVED} AS retrieved_at FROM k3")
def _(t):
    return t.results.withColumn("candidates", _flat()).drop("candidate_versions")


@query("safe_action_gate", "SELECT import_name, status, CASE WHEN status = 'resolved' THEN least(found, 5) ELSE 0 END AS candidates, CASE WHEN status = 'resolved' THEN 'install,pin_version,none' ELSE 'none' END AS allowed_actions FROM k3")
def _(t):
    return V.safe_action_gate(t.results)


# repair attempts


@query("validate_fix_objects", """SELECT id, concat_ws('; ', CASE WHEN x.flaw = 5 THEN '<root>: additional note' END, CASE WHEN command LIKE 'conda%' THEN 'command: exact; command: pattern' END,
  CASE x.flaw WHEN 3 THEN 'pypi_evidence: required requires_python' WHEN 4 THEN 'pypi_evidence/chosen_version: type' END) AS violations FROM f_attempts JOIN f_fixes x ON x.attempt_id = id""")
def _(t):
    texts = F.transform("violations", lambda v: F.concat(v.path, F.lit(": "), v.rule))
    return A.fix_violations(t.f_fixes).select(F.col("attempt_id").alias("id"), F.array_join(texts, "; ").alias("violations"))


@query("pin_supported_by_evidence", "SELECT id, version, EXISTS (SELECT 1 FROM g4 WHERE g4.distribution_name = install_name AND g4.version = f_attempts.version) AS supported FROM f_attempts WHERE action = 'pin_version'")
def _(t):
    return A.pin_support(t.f_attempts, V.release_top5(t.judged)).select("id", "version", "supported")


@query("fix_command_render", "SELECT id, CASE action WHEN 'install' THEN 'pip install ' || install_name WHEN 'pin_version' THEN 'pip install ' || install_name || '==' || version END AS command FROM f_attempts")
def _(t):
    return t.f_attempts.select("id", A.fix_command(F.col("action"), F.col("install_name"), F.col("version")).alias("command"))


@query("attempt_fact_table", "SELECT * FROM ft")
def _(t):
    return t.facts


@query("second_round_worklist", "SELECT * FROM wl")
def _(t):
    return A.second_round_worklist(t.pending)


@query("rerun_chain", "SELECT * FROM ch")
def _(t):
    return t.chain


@query("lost_reruns", "SELECT notebook_execution_id, parent_execution_id FROM f_reruns WHERE parent_execution_id NOT IN (SELECT notebook_execution_id FROM f_executions UNION ALL SELECT notebook_execution_id FROM f_reruns)")
def _(t):
    return L.lost_reruns(t.f_executions, t.f_reruns)


@query("judged_outcome", """SELECT a.id, a.notebook_execution_id, a.run_id, a.round, a.outcome, CASE ch.execution_status WHEN 'SUCCESS' THEN 'fixed' WHEN 'FAILED' THEN 'still_failing' ELSE 'apply_error' END AS judged_outcome
  FROM f_attempts a LEFT JOIN ch ON ch.notebook_execution_id = a.notebook_execution_id AND ch.run_id = a.run_id AND ch.round = a.round""")
def _(t):
    return L.judged_outcome(t.chain, t.f_attempts)


@query("outcome_domain_check", "SELECT id, outcome FROM f_attempts WHERE outcome IS NULL OR outcome NOT IN ('fixed', 'still_failing', 'apply_error')")
def _(t):
    return A.outside_domain(t.f_attempts).select("id", "outcome")


@query("repair_triples", TRIPLES)
def _(t):
    return G.repair_triples(t.facts)


@query("repair_history_query", "SELECT 'repr:notebook_' || notebook_execution_id AS notebook, 'repr:repairattempt_' || id AS attempt, '\"' || outcome || '\"' AS outcome FROM f_attempts")
def _(t):
    return A.repair_history(t.graph)


@query("graph_pattern_fixes", f"""SELECT h.s AS notebook, h.o AS attempt, x.o AS command, m.o AS module, w.o AS model FROM ({TRIPLES}) h JOIN ({TRIPLES}) f ON f.s = h.o AND f.p = 'repr:fixOutcome' AND f.o = '"fixed"' JOIN ({TRIPLES}) x ON x.s = h.o AND x.p = 'repr:appliedFix'
  JOIN ({TRIPLES}) m ON m.s = h.o AND m.p = 'repr:failingModule' JOIN ({TRIPLES}) w ON w.s = h.o AND w.p = 'prov:wasAssociatedWith' WHERE h.p = 'repr:hadRepairAttempt'""")
def _(t):
    patterns = [("?notebook", "repr:hadRepairAttempt", "?attempt"), ("?attempt", "repr:fixOutcome", '"fixed"'), ("?attempt", "repr:appliedFix", "?command"), ("?attempt", "repr:failingModule", "?module"), ("?attempt", "prov:wasAssociatedWith", "?model")]
    return G.match(t.graph, patterns).select("notebook", "attempt", "command", "module", "model")


@query("graph_pattern_two_attempts", f"""SELECT h.s AS notebook, h.o AS failed, g.o AS other, e.o AS exception, x.o AS command FROM ({TRIPLES}) h JOIN ({TRIPLES}) f ON f.s = h.o AND f.p = 'repr:fixOutcome' AND f.o = '"still_failing"'
  JOIN ({TRIPLES}) g ON g.s = h.s AND g.p = 'repr:hadRepairAttempt' LEFT JOIN ({TRIPLES}) e ON e.s = h.o AND e.p = 'repr:exception' LEFT JOIN ({TRIPLES}) x ON x.s = g.o AND x.p = 'repr:appliedFix' WHERE h.p = 'repr:hadRepairAttempt'""")
def _(t):
    patterns = [("?notebook", "repr:hadRepairAttempt", "?failed"), ("?failed", "repr:fixOutcome", '"still_failing"'), ("?notebook", "repr:hadRepairAttempt", "?other")]
    return G.match(t.graph, patterns, [("?failed", "repr:exception", "?exception"), ("?other", "repr:appliedFix", "?command")]).select("notebook", "failed", "other", "exception", "command")


@query("model_strategy_comparison", "SELECT run_id, llm_model, round, count(*) FILTER (WHERE prompt_strategy = 'zero_shot' AND outcome = 'fixed') AS fixed_zero_shot, count(*) FILTER (WHERE prompt_strategy = 'few_shot' AND outcome = 'fixed') AS fixed_few_shot, count(*) AS attempted FROM (SELECT run_id, llm_model, round, prompt_strategy, outcome FROM f_attempts UNION ALL SELECT 'external', 'model_x', round, prompt_strategy, outcome FROM f_attempts WHERE id % 3 = 0) GROUP BY 1, 2, 3")
def _(t):
    external = t.f_attempts.where("id % 3 = 0").withColumns({"run_id": F.lit("external"), "llm_model": F.lit("model_x")})
    return A.model_strategy_comparison(t.f_attempts, external)
