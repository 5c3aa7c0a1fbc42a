"""Lineage of repairs: which execution an attempt caused, and what it failed on.

An applied fix is judged by running the notebook again. That execution names the one it repeats as its parent: the failure
itself in the first round, the execution of the round before in each later one. `rerun_chain` follows parents from failures
on, one join a round, so an attempt's new error is that of its own execution and not the failure that all rounds began with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of a repair; a parameter of each operator that follows them.
ROUNDS = 2


def rerun_chain(failures: DataFrame, reruns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each failure, run and round that was executed: notebook_execution_id (of the failure), run_id, round, execution_id, execution_status, error_type, error_message.

    `reruns` has notebook_execution_id, parent_execution_id, run_id, execution_status, error_type, error_message, created_at. A
    later round only follows executions of its own run. Of several executions of one round the last by time, then by id,
    counts, and the next round may repeat any of them; executions whose parent is not known are in no chain (`lost_reruns`).
    """
    edges = reruns.select(F.col("notebook_execution_id").alias("execution_id"), "parent_execution_id", "run_id", "execution_status", "error_type", "error_message", "created_at")
    at = failures.select(F.col("notebook_execution_id").alias("parent_execution_id"), F.col("notebook_execution_id").alias("root")).distinct()
    levels = []
    for k in range(1, rounds + 1):
        level = edges.join(at, ["parent_execution_id"] if k == 1 else ["parent_execution_id", "run_id"]).withColumn("round", F.lit(k))
        levels.append(level)
        at = level.select(F.col("execution_id").alias("parent_execution_id"), "run_id", "root")
    rows = reduce(DataFrame.unionByName, levels)
    last = F.max_by(F.struct("execution_id", "execution_status", "error_type", "error_message"), F.struct("created_at", "execution_id"))
    return rows.groupBy(F.col("root").alias("notebook_execution_id"), "run_id", "round").agg(last.alias("e")).select("notebook_execution_id", "run_id", "round", "e.*")


def lost_reruns(failures: DataFrame, reruns: DataFrame) -> DataFrame:
    """Executions whose parent is neither a failure nor an execution."""
    known = failures.select(F.col("notebook_execution_id").alias("parent_execution_id")).union(reruns.select("notebook_execution_id"))
    return reruns.join(known, "parent_execution_id", "left_anti").select("notebook_execution_id", "parent_execution_id")


def judged_outcome(chain: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts with the outcome that their execution shows: fixed, still_failing, or apply_error where nothing was executed."""
    shown = chain.select("notebook_execution_id", "run_id", "round", "execution_status")
    rows = attempts.join(shown, ["notebook_execution_id", "run_id", "round"], "left")
    judged = F.when(F.col("execution_status").isNull(), "apply_error").when(F.col("execution_status") == "SUCCESS", "fixed").otherwise("still_failing")
    return rows.select("id", "notebook_execution_id", "run_id", "round", "outcome", judged.alias("judged_outcome"))


def with_prior_attempt(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Requests for a fix (notebook_execution_id, run_id, round, ...) with prior, the latest attempt of the same failure and run before their round, or null.

    Only keys and rounds meet before one attempt is chosen for each request.
    """
    keys = ["notebook_execution_id", "run_id"]
    prior = F.struct(*[c for c in ("id", "round", "action", "command", "rationale", "outcome", "new_error_type", "new_error_message")])
    earlier = facts.select(*keys, F.col("round").alias("_of"), F.col("id").alias("_id"), prior.alias("prior"))
    asked = requests.select(*keys, "round").distinct()
    best = asked.join(earlier, keys).where(F.col("_of") < F.col("round")).groupBy(*keys, "round").agg(F.max_by("prior", F.struct("_of", "_id")).alias("prior"))
    return requests.join(best, [*keys, "round"], "left")
