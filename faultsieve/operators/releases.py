"""Package-release candidates: names resolved, releases filtered and ranked, a status for every lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import kept, normalize_distribution, once
from ..functions.versions import is_pre_release, is_version, python_compatibility, version_key

# The verified names; no other import name is taken as a distribution name.
VERIFIED = {"sklearn": "scikit-learn", "umap": "umap-learn", "pkg_resources": "setuptools", "scipy": "scipy", "numpy": "numpy", "pandas": "pandas", "Bio": "biopython"}
MOST_CANDIDATES = 5
MISSING = "Not available"


def verified_names(spark) -> DataFrame:
    return spark.createDataFrame(list(VERIFIED.items()), "import_name string, distribution_name string")


def resolve_distribution(failures: DataFrame) -> DataFrame:
    """Adds distribution_name and mapping_status to rows with import_name."""
    names = F.broadcast(verified_names(failures.sparkSession))  # seven rows
    return failures.join(names, "import_name", "left").withColumn("mapping_status", F.when(F.col("distribution_name").isNull(), "mapping_unknown").otherwise("mapped"))


def _fit(df: DataFrame, python: str | None) -> Column:
    return kept(df, ("python_compatibility", python), lambda: python_compatibility(F.col("requires_python"), F.lit(python)))


def release_grouping(files: DataFrame, python: str | None = None) -> DataFrame:
    """One row for each distribution and version; it is yanked if all its files are.

    requires_python is that of the file that serves best: not yanked, then not against python, then with a requirement, then by name.
    """
    fit = _fit(files, python)
    rank = F.struct("yanked", F.col("_against"), F.col("requires_python").isNull(), "filename")
    return once(files, "_against", fit == "incompatible").groupBy("distribution_name", "version").agg(F.bool_and("yanked").alias("yanked"), F.min_by("requires_python", rank).alias("requires_python"), F.max(F.when(F.col("yanked"), F.col("yanked_reason"))).alias("yanked_reason"), F.count("*").alias("files"))


def judged_releases(releases: DataFrame, python: str | None) -> DataFrame:
    """Adds key, python_compatibility and excluded, the first reason that holds."""
    version = F.col("version")
    fit = _fit(releases, python)
    reason = F.when(~is_version(version), "invalid_version").when(F.col("yanked"), "yanked").when(is_pre_release(version), "pre-release").when(F.col("python_compatibility") == "incompatible", "incompatible requires-python")
    return once(once(once(releases, "key", kept(releases, ("version_key",), lambda: version_key(version))), "python_compatibility", fit), "excluded", reason)


def release_top5(judged: DataFrame, n: int = MOST_CANDIDATES) -> DataFrame:
    """The newest releases that are not excluded, at most n for each distribution, with their rank."""
    w = W.partitionBy("distribution_name").orderBy(F.desc("key"), F.desc("version"))
    return judged.where("excluded is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_version(judged: DataFrame) -> DataFrame:
    return judged.where("coalesce(excluded, '') <> 'invalid_version'").groupBy("distribution_name").agg(F.max_by("version", F.struct("key", "version")).alias("latest_version"))


def version_order(judged: DataFrame) -> DataFrame:
    w = W.partitionBy("distribution_name").orderBy(F.desc("key"), F.desc("version"))
    return judged.select("distribution_name", "version", F.row_number().over(w).alias("position"))


def retrieval_status(distribution: Column, http_status: Column, parsed: Column, candidates: Column) -> Column:
    return (
        F.when(distribution.isNull(), "mapping_unknown").when(http_status == 404, "package_not_found").when(http_status.isNull() | (http_status != 200), "network_error")
        .when(~F.coalesce(parsed, F.lit(False)), "invalid_response").when(candidates == 0, "no_compatible_release").otherwise("resolved")
    )


def retrieval_results(failures: DataFrame, lookups: DataFrame, files: DataFrame, python: str | None) -> DataFrame:
    """One result for each import name of failures, with at most five candidates and only if the status is resolved."""
    judged = judged_releases(release_grouping(files, python), python)
    best = release_top5(judged).groupBy("distribution_name").agg(F.sort_array(F.collect_list(F.struct("rank", "version", "requires_python", "python_compatibility", "yanked", "yanked_reason"))).alias("candidates"))
    facts = latest_version(judged).join(best, "distribution_name", "left")
    names = resolve_distribution(failures.select("import_name").distinct())
    rows = names.join(lookups, "distribution_name", "left").join(facts, "distribution_name", "left")
    rows = rows.withColumn("status", retrieval_status(F.col("distribution_name"), F.col("http_status"), F.col("parse_ok"), F.coalesce(F.size("candidates"), F.lit(0))))
    resolved, asked = F.col("status") == "resolved", F.col("distribution_name").isNotNull()
    found = F.transform("candidates", lambda c: F.struct(c.version.alias("version"), c.requires_python.alias("requires_python"), c.python_compatibility.alias("python_compatibility"), c.yanked.alias("yanked"), c.yanked_reason.alias("yanked_reason")))
    kind = "array<struct<version:string,requires_python:string,python_compatibility:string,yanked:boolean,yanked_reason:string>>"
    return rows.select(
        "status", "import_name", "distribution_name", F.when(asked & F.col("http_status").isin(200, 404), F.col("http_status") == 200).alias("package_found"), F.lit(python).cast("string").alias("python_version"),
        F.when(F.col("status").isin("resolved", "no_compatible_release"), F.col("latest_version")).alias("latest_version"), F.when(resolved, found).otherwise(F.array().cast(kind)).alias("candidate_versions"),
        F.when(asked, F.concat(F.lit("/simple/"), normalize_distribution(F.col("distribution_name")), F.lit("/"))).alias("source_endpoint"), F.when(F.col("status").isin("network_error", "invalid_response"), F.col("status")).alias("error"),
        F.when(asked, F.col("retrieved_at")).alias("retrieved_at"),
    )


def provenance(results: DataFrame) -> DataFrame:
    return results.select("import_name", "distribution_name", "status", "python_version", "source_endpoint", "candidate_versions", "error", "retrieved_at")


def safe_action_gate(results: DataFrame) -> DataFrame:
    """Only resolved results may be acted on; every other status allows the action none alone."""
    return results.select("import_name", "status", F.when(F.col("status") == "resolved", F.size("candidate_versions")).otherwise(0).alias("candidates"), F.when(F.col("status") == "resolved", "install,pin_version,none").otherwise("none").alias("allowed_actions"))


def retrieval_input_check(failures: DataFrame) -> DataFrame:
    """Rows with what is missing of import name, error type and traceback."""
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in ("import_name", "error_type", "traceback")]))
    return failures.withColumn("missing", F.array_join(gaps, ",")).withColumn("accepted", F.size(gaps) == 0)


def retrieval_context_text(results: DataFrame) -> DataFrame:
    """The text block of each result for a repair prompt: a resolved, an unasked and an unsuccessful shape."""
    text = lambda c: F.coalesce(c, F.lit(MISSING))
    line = lambda c: F.concat(F.lit("- "), c.version, F.lit(" | requires_python: "), text(c.requires_python), F.lit(" | python_compatibility: "), c.python_compatibility, F.lit(" | yanked: "), c.yanked.cast("string"))
    head = [F.concat(F.lit("PyPI retrieval status: "), "status"), F.concat(F.lit("Python import name: "), "import_name"), F.concat(F.lit("Resolved distribution name: "), text(F.col("distribution_name")))]
    tail = F.lit("\nAPI-level compatibility evidence:\nNot available")
    resolved = F.concat_ws("\n", *head, F.concat(F.lit("Notebook Python version: "), text(F.col("python_version"))), F.concat(F.lit("Latest available version: "), text(F.col("latest_version"))), F.lit("\nCandidate versions:"), F.array_join(F.transform("candidate_versions", line), "\n"), tail)
    reasons = {
        "package_not_found": "The resolved distribution was not found on PyPI.", "no_compatible_release": "No stable release that is not yanked fits the notebook.",
        "network_error": "PyPI could not be reached.", "invalid_response": "The response could not be read.", "mapping_unknown": "No verified import-to-distribution mapping is available.",
    }
    reason = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in reasons.items()])
    query = F.when(F.col("status") == "mapping_unknown", "PyPI query: Not performed").otherwise("PyPI query: Completed")
    other = F.concat_ws("\n", *head, query, F.concat(F.lit("Reason: "), reason), F.lit("\nCandidate versions:\nNot available"), tail)
    return results.select("import_name", F.when(F.col("status") == "resolved", resolved).otherwise(other).alias("context"))
