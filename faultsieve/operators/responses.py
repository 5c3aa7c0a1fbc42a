"""Triage of model responses: the JSON in a reply, the rules of its schema, and attempts reduced to outcomes."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import schema as J
from ..functions.jsontext import fenced, first_object, loads
from ..functions.text import filled, kept, once, strip, truncate_with_marker
from .contracts import EXPLANATION_SCHEMA

# Which failures are tried again, and which fields of a record are told of with its result.
RETRY_ON = ["invalid_json", "schema_validation_error", "timeout", "model_unavailable"]
INPUT_FIELDS = ["notebook_execution_id", "error_type", "error_message", "failing_module", "original_subtype", "refined_subtype", "confidence", "root_cause_hint", "context_status", "error_cell_index"]


def extract_json(responses: DataFrame, column: str = "raw_response") -> DataFrame:
    """Adds payload (variant), shape (whole, fenced, embedded) and parse_error.

    The whole text, the first fenced block and the first balanced object are tried in order, the first that parses decides;
    the scan by pieces runs only on rows that the cheaper ones left open. A repeated key has its last value, and NaN and
    Infinity are numbers (`jsontext.loads`).
    """
    text, still = F.col("_text"), lambda *done: reduce(lambda a, b: a & b, [F.col(c).isNull() for c in done])
    out = once(responses, "_text", strip(filled(F.col(column))))
    parsed = lambda c: kept(responses, ("loads", c), lambda: loads(F.col(c)))
    out = once(out, "_whole", parsed("_text"))
    out = once(out, "_block", F.when(still("_whole"), fenced(text)))
    out = once(out, "_fenced", parsed("_block"))
    out = once(out, "_span", F.when(still("_whole", "_fenced"), first_object(text)))
    out = once(out, "_inner", parsed("_span"))
    payload = F.coalesce("_whole", "_fenced", "_inner")
    shape = F.when(F.col("_whole").isNotNull(), "whole").when(F.col("_fenced").isNotNull(), "fenced").when(F.col("_inner").isNotNull(), "embedded")
    out = out.withColumns({"payload": payload, "shape": shape}).drop("_text", "_whole", "_block", "_fenced", "_span", "_inner")
    kind = F.schema_of_variant("payload")
    error = F.when(F.col("payload").isNull(), "invalid_json: no JSON object found in model response").when(~kind.startswith("OBJECT"), "non_object_json: model response must be a JSON object")
    return once(out, "parse_error", error)


def violations(rows: DataFrame, payload: Column, schema: str | dict = EXPLANATION_SCHEMA) -> DataFrame:
    """Adds violations, what a schema finds wrong with a payload: structs of path and rule, by path; null without a payload."""
    text = schema if isinstance(schema, str) else json.dumps(schema)
    found = kept(rows, ("violations", text), lambda: J.violations(F.col("_judged"), text))
    return once(once(rows, "_judged", payload), "violations", found).drop("_judged")


def explained(payload: Column, schema: str | dict = EXPLANATION_SCHEMA) -> Column:
    """A payload in the type of its schema."""
    return F.from_json(F.to_json(payload), J.ddl(schema))


def parse_and_validate(responses: DataFrame, column: str = "raw_response", schema: str | dict = EXPLANATION_SCHEMA) -> DataFrame:
    """Adds shape, parse_error, violations, errors (texts), valid and explanation (kept where only the rules are broken); its type is the schema's."""
    out = extract_json(responses, column)
    is_object = F.col("parse_error").isNull()
    out = violations(out, F.when(is_object, F.col("payload")), schema)
    errors = F.when(~is_object, F.array("parse_error")).otherwise(F.transform("violations", lambda v: F.concat(v.path, F.lit(": "), v.rule)))
    explanation = F.when(is_object, explained(F.col("payload"), schema))
    return out.withColumns({"errors": errors, "explanation": explanation}).withColumn("valid", F.size("errors") == 0)


def classify_failure(errors: Column) -> Column:
    """invalid_json if the first error says so, else schema_validation_error, also for JSON that is no object."""
    return F.when(F.coalesce(F.try_element_at(errors, F.lit(1)), F.lit("")).startswith("invalid_json"), "invalid_json").otherwise("schema_validation_error")


def violation_report(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("v")).groupBy("v.path", "v.rule").agg(F.count("*").alias("count"))


def judged(attempts: DataFrame) -> DataFrame:
    """Attempts with valid, errors and category; replies are parsed, other kinds are their own category."""
    out = parse_and_validate(attempts)
    reply = F.col("kind") == "reply"
    valid = reply & F.col("valid")
    errors = F.when(reply, F.col("errors")).otherwise(F.array(F.concat("kind", F.lit(": no response"))))
    return out.withColumns({"errors": errors, "explanation": F.when(reply, F.col("explanation"))}).withColumn("category", F.when(reply, F.when(~F.col("valid"), classify_failure(F.col("errors")))).otherwise(F.col("kind"))).withColumn("valid", valid)


def _stop(max_retries: int, retry_on: list[str]) -> Column:
    return F.col("valid") | ~F.col("category").isin(retry_on) | (F.col("attempt") > max_retries)


def reduce_attempts(attempts: DataFrame, max_retries: int = 1, retry_on: list[str] = RETRY_ON) -> DataFrame:
    """One outcome for each record: the first attempt that is valid, not to be tried again, or the last allowed.

    Attempts behind it don't count. A timeout or missing model keeps the raw response before it and has no token counts.
    Attempts are dealt out by their record before they are parsed: so the texts alone are shuffled, all cores parse however few
    files or row groups hold the texts, and only the explanation of a valid outcome is built.
    """
    w = W.partitionBy("notebook_execution_id")
    rows = judged(attempts.repartition("notebook_execution_id")).withColumn("stop", F.min(F.when(_stop(max_retries, retry_on), F.col("attempt"))).over(w)).where(F.col("attempt") <= F.coalesce("stop", F.lit(1 << 30)))
    last = lambda c: F.max_by(c, "attempt")
    out = rows.groupBy("notebook_execution_id").agg(
        last("valid").alias("valid"), last("category").alias("category"), last("payload").alias("payload"), last("errors").alias("errors"), F.max("attempt").alias("attempts"),
        F.max_by("raw_response", F.when(F.col("kind") == "reply", F.col("attempt"))).alias("raw"), last("tokens_input").alias("tokens_input"), last("tokens_output").alias("tokens_output"), F.sum("latency_ms").alias("latency_ms"),
    )
    return out.select(
        "notebook_execution_id", F.when(F.col("valid"), "success").otherwise("failed").alias("status"), F.when(~F.col("valid"), F.col("category")).alias("failure_category"),
        F.when(F.col("valid"), explained(F.col("payload"))).alias("explanation"), truncate_with_marker(F.col("raw")).alias("raw_response"), "errors", "attempts", "latency_ms", "tokens_input", "tokens_output",
        F.when(~F.col("valid"), F.array_join("errors", "; ")).alias("error"),
    )


def retry_worklist(attempts: DataFrame, max_retries: int = 1, retry_on: list[str] = RETRY_ON) -> DataFrame:
    """Records whose latest attempt failed in a way to be tried again, while attempts remain."""
    w = W.partitionBy("notebook_execution_id").orderBy(F.desc("attempt"))
    latest = judged(attempts).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return latest.where(~_stop(max_retries, retry_on)).select("notebook_execution_id", "attempt", "category")


def input_metadata() -> Column:
    return F.struct(*[F.col(c).alias("classifier_confidence" if c == "confidence" else c) for c in INPUT_FIELDS])


def llm_metadata(model: str, strategy: str, template: str, version: str) -> Column:
    return F.struct(F.lit(model).alias("llm_model"), F.lit(strategy).alias("prompt_strategy"), F.lit(template).alias("prompt_template"), F.lit(version).alias("prompt_version"))


def merge_result_rows(done: DataFrame, unrendered: DataFrame) -> DataFrame:
    """Outcomes and records whose prompt could not be rendered, in one log."""
    failed = unrendered.select("notebook_execution_id", F.lit("render_failed").alias("status"), F.lit("render_failed").alias("failure_category"), "error")
    return done.unionByName(failed, allowMissingColumns=True)


def result_rows(records: DataFrame, outcomes: DataFrame, llm: Column, run_id: str) -> DataFrame:
    """Nested log rows: run_id, input, llm, explanation_result."""
    result = outcomes.select("notebook_execution_id", F.struct(*[c for c in outcomes.columns if c != "notebook_execution_id"]).alias("explanation_result"))
    return records.join(result, "notebook_execution_id").select(F.lit(run_id).alias("run_id"), input_metadata().alias("input"), llm.alias("llm"), "explanation_result")


def grounding_check(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Valid explanations with module_ok (the input's module, null for a missing one) and text_ok (no install command)."""
    e = F.col("explanation")
    words = F.concat_ws(" ", e.summary, e.root_cause, e.limitations, F.array_join(e.evidence, " "))
    rows = outcomes.where("status = 'success'").select("notebook_execution_id", "explanation").join(records.select("notebook_execution_id", "failing_module"), "notebook_execution_id")
    module = F.when(F.col("failing_module") != "", F.col("failing_module"))
    return rows.select("notebook_execution_id", e.failing_module.eqNullSafe(module).alias("module_ok"), (~words.rlike(r"(?i)\b(pip3?|conda|apt(-get)?)\s+install\b")).alias("text_ok"))


def explanation_outcomes(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by, "status", "failure_category").agg(F.count("*").alias("count"), F.sum("attempts").alias("attempts"))


def latency_token_profile(results: DataFrame) -> DataFrame:
    return results.agg(
        F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.percentile("latency_ms", 0.5).alias("median_ms"), F.max("latency_ms").alias("max_ms"), F.sum("tokens_input").alias("tokens_input"), F.sum("tokens_output").alias("tokens_output"),
    )
