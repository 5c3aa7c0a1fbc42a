"""Prompts: templates compiled to one concat, or rows of a table filled at run time; values are put in once and never expanded again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, or_missing, strip
from .lineage import with_prior_attempt

NOT_AVAILABLE = "Not available"
#: Templates are broadcast up to so many bytes of text, and chosen indexes up to so many rows.
TEMPLATE_BYTES, BROADCAST_ROWS = 8 << 20, 1_000_000
PLACEHOLDER = re.compile(r"\{\{([a-zA-Z_][a-zA-Z0-9_]*)\}\}")

EXPLANATION_TEMPLATE = """Explain why this notebook run failed on a dependency. Use only the record below, propose no fix, and answer with one
JSON object of the fields summary, root_cause, evidence, failing_module, explanation_confidence and limitations.
{{few_shot_examples}}
id: {{notebook_execution_id}}
error type: {{error_type}}
error message: {{error_message}}
subtype: {{refined_subtype}} (first pass: {{original_subtype}}, confidence {{classifier_confidence}}, hint {{root_cause_hint}})
failing module: {{failing_module}}
context: {{context_status}}, cell {{error_cell_index}}

failing cell:
{{failing_cell_source}}

cells with imports:
{{import_cells}}

cells around:
{{surrounding_cells}}

dependency files:
{{dependency_files}}

traceback:
{{legacy_traceback_hint}}
"""

REPAIR_TEMPLATE = """Propose one pip-only repair as a JSON object with action (install, pin_version or none), import_name, install_name, version,
command, rationale and pypi_evidence. Use only what is given here.
{{few_shot_examples}}
error:
{{error_context}}

requirements:
{{current_requirements}}

imports:
{{notebook_imports}}

releases:
{{pypi_versions}}

earlier attempt:
{{prior_attempt}}
"""

EXAMPLES = """
example: No module named 'sklearn' -> module sklearn, confidence high, hint import_distribution_name_mismatch
"""


def _indented(array: Column, fields: list[str]) -> Column:
    """An array of structs as JSON with two spaces of indentation; non-ASCII characters stay."""

    def value(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)

    item = lambda x: F.concat(F.lit("  {\n"), *[F.concat(F.lit(f'    "{f}": '), value(x[f]), F.lit(",\n" if f != fields[-1] else "\n")) for f in fields], F.lit("  }"))
    return F.when(F.size(array) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(array, item), ",\n"), F.lit("\n]"))).otherwise(NOT_AVAILABLE)


def template_values() -> dict[str, Column]:
    """The values for templates, by name, as text; gaps read as not available."""
    plain = {n: or_missing(F.col(n)) for n in ("notebook_execution_id", "error_type", "error_message", "original_subtype", "refined_subtype", "root_cause_hint", "failing_module", "context_status", "error_cell_index")}
    cell = ["cell_index", "source"]
    return plain | {
        "classifier_confidence": or_missing(F.col("confidence")),
        "failing_cell_source": or_missing(F.col("prompt_context.failing_cell_source")),
        "import_cells": F.coalesce(_indented(F.col("prompt_context.import_cells"), cell), F.lit(NOT_AVAILABLE)),
        "surrounding_cells": F.coalesce(_indented(F.col("prompt_context.surrounding_cells"), cell), F.lit(NOT_AVAILABLE)),
        "dependency_files": F.coalesce(_indented(F.col("prompt_context.dependency_files"), ["path", "fetched", "ref", "content"]), F.lit(NOT_AVAILABLE)),
        "legacy_traceback_hint": or_missing(F.col("legacy_traceback_hint.raw_traceback")),
    }


def compile_template(template: str, values: dict[str, Column]) -> Column:
    """One concat of the template's literals and values. Raises KeyError for a placeholder without a value."""
    parts = PLACEHOLDER.split(template)
    for name in parts[1::2]:
        if name not in values:
            raise KeyError(f"Unknown template placeholder: {name}")
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def render(records: DataFrame, template: str, values: dict[str, Column]) -> DataFrame:
    """Adds prompt and error; with an unknown placeholder every row gets the error and no prompt."""
    try:
        return records.withColumns({"prompt": compile_template(template, values), "error": F.lit(None).cast("string")})
    except KeyError as e:
        return records.withColumns({"prompt": F.lit(None).cast("string"), "error": F.lit(f"KeyError: {e}")})


def retry_prompt(prompt: Column, response: Column, errors: Column) -> Column:
    """The original prompt behind the faulty response and the list of its errors."""
    listed = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("- "), e)), "\n")
    return F.concat(
        F.lit("The previous response was invalid.\n\nValidation errors:\n"), listed, F.lit("\n\nPrevious response:\n"), response,
        F.lit("\n\nReturn the corrected answer as one valid JSON object and nothing else, after this original prompt:\n"), prompt, F.lit("\n"),
    )


def with_strategy(template: str, strategy: str) -> str:
    """The template with the block of examples for few_shot, or without it."""
    return template.replace("{{few_shot_examples}}\n", EXAMPLES if strategy == "few_shot" else "")


def template_segments(template: Column) -> Column:
    """The parts of a template: structs of the text before a placeholder and the placeholder's name, null behind the last."""
    pattern = F.lit(PLACEHOLDER.pattern)
    return F.transform(F.arrays_zip(F.split(template, PLACEHOLDER.pattern, -1).alias("text"), F.regexp_extract_all(template, pattern, F.lit(1)).alias("slot")), lambda x: F.struct(x["text"].alias("text"), x["slot"].alias("slot")))


def fill(segments: Column, values: Column) -> Column:
    """The parts with each placeholder's value from a map of texts; one pass, so a value that looks like a placeholder stays as it is."""
    piece = lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.when(x["slot"].isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(values, x["slot"]), F.lit(""))))
    return F.array_join(F.transform(segments, piece), "")


def render_from_table(records: DataFrame, templates: DataFrame, values: dict[str, Column], by: list[str], column: str = "template", most_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """Adds prompt and error to records, each by the template row that has its values of the columns `by`.

    Templates are data: a new row needs no code. They fall into parts once a row of the table, and the table is broadcast where
    its texts are at most `most_bytes`, else left to the planner. A record without a template, or whose template
    names a value that is not there, gets an error and no prompt; only the values that some template names are put into the map.
    """
    table = templates.select(*by, template_segments(F.col(column)).alias("_segments"))
    named = templates.select(F.explode(F.regexp_extract_all(column, F.lit(PLACEHOLDER.pattern), F.lit(1))).alias("n")).where(F.col("n").isin(list(values))).distinct()
    used = sorted(r["n"] for r in named.collect())  # at most as many as there are values
    size = templates.agg(F.sum(F.octet_length(column))).first()[0] or 0
    rows = records.withColumn("_values", F.create_map(*[x for n in used for x in (F.lit(n), values[n])]) if used else F.create_map().cast("map<string,string>"))
    rows = rows.join(F.broadcast(table) if size <= most_bytes else table, by, "left")
    unknown = F.array_except(F.filter(F.transform("_segments", lambda x: x["slot"]), lambda n: n.isNotNull()), F.map_keys("_values"))
    error = F.when(F.col("_segments").isNull(), F.concat(F.lit("no template for "), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by]))).when(
        F.size(unknown) > 0, F.concat(F.lit("KeyError: Unknown template placeholder: "), unknown[0])
    )
    rows = rows.withColumn("error", error)
    return rows.withColumn("prompt", F.when(F.col("error").isNull(), fill(F.col("_segments"), F.col("_values")))).drop("_segments", "_values")


def repair_values() -> dict[str, Column]:
    """The values for repair prompts by name, as text.

    Columns: error_type, error_message, failing_module, traceback, dependency_files and import_cells of the record,
    releases (the text of `releases.retrieval_context_text`) and prior (`lineage.with_prior_attempt`).
    """
    part = lambda name, c: F.when(strip(filled(c)) != "", F.concat(F.lit(name), c))
    head = F.concat_ws(": ", F.when(F.col("error_type") != "", F.col("error_type")), F.when(F.col("error_message") != "", F.col("error_message")))
    error = F.concat_ws("\n", head, part("failing module: ", F.col("failing_module")), part("traceback:\n", F.col("traceback")))
    files = F.filter("dependency_files", lambda f: f.content.isNotNull())
    requirements = F.array_join(F.transform(files, lambda f: F.concat(F.lit("# "), f.path, F.lit("\n"), f.content)), "\n")
    imports = F.array_join(F.flatten(F.transform("import_cells", lambda c: F.filter(F.split(c.source, "\n"), lambda line: line.rlike(r"^\s*(import|from)\s+\S+")))), "\n")
    p = F.col("prior")
    gap = lambda c: F.coalesce(c, F.lit("none"))
    prior = F.when(p.isNotNull(), F.concat(
        F.lit("round "), p.round, F.lit(": "), gap(p.action), F.lit(", command: "), gap(p.command), F.lit(", outcome: "), gap(p.outcome),
        F.coalesce(F.concat(F.lit("\nnew error: "), p.new_error_type, F.lit(": "), gap(p.new_error_message)), F.lit("")),
    ))
    return {"error_context": or_missing(error), "current_requirements": or_missing(requirements), "notebook_imports": or_missing(imports), "pypi_versions": or_missing(F.col("releases")), "prior_attempt": or_missing(prior)}


def repair_requests(records: DataFrame, worklist: DataFrame, releases: DataFrame, facts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each fix to ask for, with what `repair_values` needs.

    First rounds are those of `runs` (notebook_execution_id, run_id) over the records of `context.enrich`, with the failure's own
    error; later ones are the rows of `attempts.second_round_worklist` with the new error, and with the earlier attempt. Requirements and
    imports are the notebook's in both. `releases` has import_name and context.
    """
    context = records.select(
        "notebook_execution_id", F.col("error_type").alias("_type"), F.col("error_message").alias("_message"), F.col("failing_module").alias("_module"),
        F.col("legacy_traceback_hint.raw_traceback").alias("_traceback"), F.col("prompt_context.import_cells").alias("import_cells"), F.col("dependency_file_metadata").alias("dependency_files"),
    )
    asked = runs.select("notebook_execution_id", "run_id", F.lit(1).alias("round")).unionByName(
        worklist.select("notebook_execution_id", "run_id", "round", F.col("new_error_type").alias("error_type"), F.col("new_error_message").alias("error_message"), F.col("failing_module").alias("failing_module")), allowMissingColumns=True
    )
    rows = asked.join(context, "notebook_execution_id")
    first = F.col("round") == 1
    rows = rows.withColumns({c: F.when(first, F.col(own)).otherwise(F.col(c)) for c, own in (("error_type", "_type"), ("error_message", "_message"), ("failing_module", "_module"))} | {"traceback": F.when(first, F.col("_traceback"))})
    rows = with_prior_attempt(rows.drop("_type", "_message", "_module", "_traceback"), facts)
    known = releases.select(F.col("import_name").alias("failing_module"), F.col("context").alias("releases"))
    return rows.join(known, "failing_module", "left")


def record_slice(records: DataFrame, index: str, start: int = 0, limit: int = 5) -> DataFrame:
    """The records from index start on, so many at most; only indexes move before the records are rendered."""
    chosen = records.where(F.col(index) >= start).select(index).orderBy(index).limit(limit)
    return records.join(F.broadcast(chosen) if limit <= BROADCAST_ROWS else chosen, index, "left_semi")
