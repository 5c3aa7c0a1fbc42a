"""Repair attempts: fix objects checked, one fact row an attempt, rates and work lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import schema as J
from ..functions.jsontext import loads
from ..functions.text import filled, kept, once
from .contracts import FIX_SCHEMA
from .graph import match
from .lineage import ROUNDS
from .rules import classify_subtype, extract_failing_module

OUTCOMES = ["fixed", "still_failing", "apply_error"]
FACTS = [
    "id", "notebook_execution_id", "failing_module", "subtype", "explanation", "action", "install_name", "version", "command", "rationale",
    "pypi_evidence", "outcome", "new_error_type", "new_error_message", "llm_model", "prompt_strategy", "round", "run_id", "created_at",
]


def fix_command(action: Column, name: Column, version: Column) -> Column:
    return F.when(action == "install", F.concat(F.lit("pip install "), name)).when(action == "pin_version", F.concat(F.lit("pip install "), name, F.lit("=="), version))


def read_fixes(fixes: DataFrame, column: str = "fix") -> DataFrame:
    """Adds proposal (variant) and the fields of a fix as texts: what a model wrote, as JSON is read from replies; null if it is no JSON."""
    out = once(fixes, "_fix", filled(F.col(column)))
    out = once(out, "proposal", kept(fixes, ("loads", "_fix"), lambda: loads(F.col("_fix")))).drop("_fix")
    text = lambda n: F.try_variant_get("proposal", f"$.{n}", "string")
    evidence = F.to_json(F.try_variant_get("proposal", "$.pypi_evidence", "variant"))
    return out.withColumns({n: text(n) for n in ("action", "install_name", "version", "command", "rationale")} | {"pypi_evidence": evidence})


def fix_violations(fixes: DataFrame, column: str = "fix", schema: str | dict = FIX_SCHEMA) -> DataFrame:
    """Adds violations: what the schema finds wrong with a fix, and a command other than the one that its fields say."""
    out = read_fixes(fixes, column)
    text = schema if isinstance(schema, str) else json.dumps(schema)
    found = once(out, "_found", kept(fixes, ("violations of a proposal", text), lambda: J.violations(F.col("proposal"), text)))
    want = fix_command(F.col("action"), F.col("install_name"), F.col("version"))
    exact = F.when(want.isNotNull() & ~want.eqNullSafe(F.col("command")), F.array(F.struct(F.lit("command").alias("path"), F.lit("exact").alias("rule")))).otherwise(F.array().cast(J.VIOLATIONS))
    no_json = F.array(F.struct(F.lit(J.ROOT).alias("path"), F.lit("invalid_json").alias("rule")))
    return found.withColumn("violations", F.coalesce(F.sort_array(F.concat("_found", exact)), no_json)).drop("_found", "proposal")


def pin_support(fixes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pinned fixes with supported: whether the version is among the candidates (distribution_name, version)."""
    pins = fixes.where("action = 'pin_version'")
    known = candidates.select(F.col("distribution_name").alias("install_name"), "version").distinct().withColumn("_known", F.lit(True))
    return pins.join(known, ["install_name", "version"], "left").withColumn("supported", F.coalesce("_known", F.lit(False))).drop("_known")


def attempt_facts(attempts: DataFrame, failures: DataFrame, explanations: DataFrame, fixes: DataFrame, chain: DataFrame) -> DataFrame:
    """One row of 19 columns for each attempt.

    rationale and pypi_evidence (JSON) are those of the proposal, and an attempt that still fails has the error of the
    execution that it caused (`lineage.rerun_chain`), so later rounds start from another error than the first. Of several
    proposals of one attempt the one with the last text counts.
    """
    known = failures.select("notebook_execution_id", "failing_module", "subtype")
    told = explanations.select("notebook_execution_id", "explanation")
    proposed = read_fixes(fixes.repartition("attempt_id")).groupBy(F.col("attempt_id").alias("id")).agg(F.max_by(F.struct("rationale", "pypi_evidence"), "fix").alias("f")).select("id", "f.*")
    shown = chain.select("notebook_execution_id", "run_id", "round", F.col("error_type").alias("_type"), F.col("error_message").alias("_message"))
    rows = attempts.join(shown, ["notebook_execution_id", "run_id", "round"], "left").join(known, "notebook_execution_id", "left").join(told, "notebook_execution_id", "left").join(proposed, "id", "left")
    failing = F.col("outcome") == "still_failing"
    return rows.withColumns({"new_error_type": F.when(failing, F.col("_type")), "new_error_message": F.when(failing, F.col("_message"))}).select(*FACTS)


def success_rate_cube(attempts: DataFrame, *by: str) -> DataFrame:
    """Rates for every combination of the dimensions `by`, the margins included.

    level is the number of the grouping: bit k (from the left) is 1 where dimension k is summed over, so a null of the data is
    told from a margin. Attempts are counted by all dimensions first, and only those counts are summed for the margins.
    """
    counts = attempts.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(F.col("outcome") == "fixed").alias("_fixed"))
    cube = counts.cube(*by).agg(F.grouping_id().alias("level"), F.sum("_n").alias("attempted"), F.sum("_fixed").alias("fixed"))
    return cube.withColumn("rate", F.round(F.col("fixed") / F.col("attempted"), 6))


def success_rate(attempts: DataFrame, *by: str) -> DataFrame:
    return attempts.groupBy(*by).agg(F.count("*").alias("attempted"), F.count_if(F.col("outcome") == "fixed").alias("fixed"), F.round(F.count_if(F.col("outcome") == "fixed") / F.count("*"), 6).alias("rate"))


def ablation_rounds(attempts: DataFrame) -> DataFrame:
    """Failures by their outcome after one round and after all rounds."""
    last = attempts.groupBy("notebook_execution_id").agg(F.max_by("outcome", F.when(F.col("round") == 1, F.col("id"))).alias("one_round"), F.max_by("outcome", F.struct("round", "id")).alias("all_rounds"))
    return last.groupBy("one_round", "all_rounds").agg(F.count("*").alias("failures"))


def second_round_worklist(facts: DataFrame, most_rounds: int = ROUNDS) -> DataFrame:
    """Attempts (facts) that still fail in the last round of their failure and run, while rounds remain, with the error that the next round starts from.

    failing_module, subtype and scope_status are those of the new error, by the rules of the first pass; where the attempt's execution is
    not known there is no error to classify, and all are null.
    """
    w = W.partitionBy("notebook_execution_id", "run_id").orderBy(F.desc("round"), F.desc("id"))
    last = facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").where((F.col("outcome") == "still_failing") & (F.col("round") < most_rounds))
    module = F.when(F.col("new_error_message").isNotNull(), extract_failing_module(F.col("new_error_message")))
    rows = last.withColumn("failing_module", module).withColumn("_c", F.when(F.col("new_error_type").isNotNull(), classify_subtype(F.col("new_error_type"), F.col("new_error_message"), F.col("failing_module"))))
    return rows.select("notebook_execution_id", "id", "run_id", (F.col("round") + 1).alias("round"), "new_error_type", "new_error_message", "failing_module", F.col("_c.subtype").alias("subtype"), F.col("_c.scope_status").alias("scope_status"))


def outside_domain(attempts: DataFrame) -> DataFrame:
    """Attempts whose outcome is none of the three; there must be none."""
    return attempts.where(~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False)))


#: The pattern "notebook, its attempts, their outcomes".
HISTORY = [("?notebook", "repr:hadRepairAttempt", "?attempt"), ("?attempt", "repr:fixOutcome", "?outcome")]


def repair_history(triples: DataFrame) -> DataFrame:
    """Notebooks, their attempts and outcomes, by a pattern over the triples."""
    return match(triples, HISTORY).select("notebook", "attempt", "outcome")


def model_strategy_comparison(attempts: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Fixed attempts by run, model and round, a column for each prompt strategy; external attempts are further runs."""
    columns = ["run_id", "llm_model", "round", "prompt_strategy", "outcome"]
    rows = attempts.select(*columns) if external is None else attempts.select(*columns).unionByName(external.select(*columns))
    return rows.groupBy("run_id", "llm_model", "round").agg(*[F.count_if((F.col("prompt_strategy") == s) & (F.col("outcome") == "fixed")).alias(f"fixed_{s}") for s in ("zero_shot", "few_shot")], F.count("*").alias("attempted"))


def multi_granularity_rates(attempts: DataFrame, executions: DataFrame) -> DataFrame:
    """Success and progress of executions by level: notebook, error type, all."""
    progress = executions.select("notebook_execution_id", "notebook_id", "error_type", (F.col("executed_cells") / F.col("total_code_cells")).alias("progress"))
    best = attempts.groupBy("notebook_execution_id").agg(F.max(F.when(F.col("outcome") == "fixed", 1).otherwise(0)).alias("fixed"))
    rows = progress.join(best, "notebook_execution_id")
    measures = [F.count("*").alias("failures"), F.sum("fixed").alias("fixed"), F.round(F.avg("progress"), 6).alias("progress")]
    levels = {"notebook": F.col("notebook_id").cast("string"), "error_type": F.col("error_type"), "all": F.lit("all")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("key")) for k, c in levels.items()]))
    return rows.select("fixed", "progress", pairs.alias("k")).groupBy("k.level", "k.key").agg(*measures)
