"""Ordered rules that classify error messages, as CASE columns. Null and empty inputs are the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, filled, strip

# The message patterns in order; the module is the first group up to its first dot.
MODULE_PATTERNS = [
    r"No module named ['\"]([^'\"]+)['\"]",
    r"cannot import name ['\"][^'\"]+['\"] from ['\"]([^'\"]+)['\"]",
    r"Missing optional dependency ['\"]([^'\"]+)['\"]",
    r"[Ii]nstall ([A-Za-z0-9_.-]+)",
    r"[Pp]lease install ([A-Za-z0-9_.-]+)",
    r"pip install ([A-Za-z0-9_.-]+)",
    r"['\"]([^'\"]+)['\"] must be installed",
    r"install [`']([^`']+)[`']",
    r"([A-Za-z0-9_.-]+) is required",
]
LIBRARY_PATTERN = r"(lib[A-Za-z0-9_.-]+\.so(?:\.\d+)*)"
CANNOT_IMPORT = r"cannot import name ['\"][^'\"]+['\"] from ['\"][^'\"]+['\"]"

# Module names that are no packages, rows used in design, import names that differ from their distribution.
LOCAL_MODULES = ["utils", "statistics", "config", "helpers", "src"]
DEV_IDS = [8, 10, 17, 19, 43, 45, 49, 50, 60, 61, 157, 174, 188]
MISMATCHES = {
    "sklearn": "scikit-learn", "cv2": "opencv-python", "pil": "Pillow", "yaml": "PyYAML", "bs4": "beautifulsoup4",
    "skimage": "scikit-image", "serial": "pyserial", "openssl": "pyOpenSSL", "usb": "pyusb", "docx": "python-docx",
    "fitz": "PyMuPDF", "dotenv": "python-dotenv", "git": "GitPython",
}
# Why a failure is out of scope, and the subtypes, confidences and hints that the rules give.
REASONS = {
    "system_library": "requires system library, outside pip-only scope",
    "mapping_unknown": "ambiguous local/module-path import",
    "out_of_scope": "unsupported dependency-error pattern",
}
SUBTYPES = ["missing_package", "wrong_version", "system_library", "mapping_unknown", "out_of_scope"]
CONFIDENCES = ["high", "medium", "low"]
HINTS = [
    "direct_missing_package", "import_distribution_name_mismatch", "version_or_api_incompatibility", "transitive_dependency",
    "system_level_dependency", "local_import_or_path_issue", "insufficient_context",
]


def cases(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first rule that holds."""
    (first, value), *rest = rules
    return reduce(lambda c, rule: c.when(*rule), rest, F.when(first, value)).otherwise(default)


def extract_failing_module(message: Column) -> Column:
    m = filled(message)
    rules = [(m.rlike(f"(?iu){p}"), F.split_part(F.regexp_extract(m, f"(?iu){p}", 1), F.lit("."), F.lit(1))) for p in MODULE_PATTERNS]
    return cases(rules, F.regexp_extract(m, LIBRARY_PATTERN, 1))


def _labels(names: tuple[str, ...], *values: str | Column) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, values)])


def classify_subtype(error_type: Column, message: Column, module: Column) -> Column:
    """subtype, scope_status, exclusion_reason: the first pass over a failure, sensitive to case."""
    m, out = filled(message), lambda *v: _labels(("subtype", "scope_status", "exclusion_reason"), *v)
    missing, version, library, unclear, _ = SUBTYPES
    return cases(
        [
            (m.contains(".so") | m.contains("shared object file"), out(library, "excluded", REASONS["system_library"])),
            (filled(module).isin(LOCAL_MODULES), out(unclear, "excluded", REASONS["mapping_unknown"])),
            ((filled(error_type) == "ModuleNotFoundError") | m.contains("No module named"), out(missing, "usable", "")),
            (m.contains("cannot import name"), out(version, "usable", "")),
            (F.lower(m).contains("install") | F.lower(m).contains("required"), out(missing, "usable", "")),
        ],
        out(SUBTYPES[-1], "excluded", REASONS["out_of_scope"]),
    )


def assign_split(execution_id: Column, scope_status: Column) -> Column:
    return F.when(scope_status == "excluded", "excluded").when(execution_id.isin(DEV_IDS), "dev").otherwise("evaluation")


def is_mismatch(module: Column) -> Column:
    return F.lower(strip(filled(module))).isin(list(MISMATCHES))


def is_local(module: Column) -> Column:
    return F.lower(strip(filled(module))).isin(LOCAL_MODULES)


def classify_refined(error_type: Column, message: Column, module: Column, original: Column) -> Column:
    """refined_subtype, confidence, root_cause_hint: the second pass, in other order and mostly blind to case."""
    m, low, kind = filled(message), F.lower(filled(message)), filled(error_type)
    name = strip(filled(module))
    package, version, library, unclear, outside = SUBTYPES
    high, medium, low_confidence = CONFIDENCES
    direct, mismatch, api, transitive, system, local, unknown = HINTS
    out = lambda *v: _labels(("refined_subtype", "confidence", "root_cause_hint"), *v)
    hint = F.when(is_mismatch(module), mismatch).otherwise(direct)
    missing = (kind == "ModuleNotFoundError") | low.contains("no module named")
    asked = low.contains("install") | low.contains("required")
    return cases(
        [
            (m.contains(".so") | low.contains("shared object file"), out(library, high, system)),
            (is_local(module), out(F.when(filled(original).isin(unclear, outside), original).otherwise(unclear), low_confidence, local)),
            (low.contains("cannot import name"), out(version, high, api)),
            ((missing | asked) & (name == ""), out(unclear, low_confidence, unknown)),
            (missing, out(package, high, hint)),
            (asked, out(package, medium, hint)),
            (kind == "ImportError", out(version, medium, transitive)),
        ],
        out(outside, low_confidence, unknown),
    )


def normalized_fields(error_type: Column, message: Column, module: Column) -> list[Column]:
    return [
        strip(filled(error_type)).alias("error_type_normalized"), strip(collapse(filled(message))).alias("error_message_normalized"), F.lower(strip(filled(module))).alias("failing_module_normalized"),
    ]


def legacy_matches(error_type: Column, message: Column, module: Column, text: Column) -> Column:
    """Whether a legacy traceback reports the same failure, and does not merely mention the module."""
    m, low, name = filled(message), F.lower(filled(message)), strip(filled(module))
    quote, phrase = F.lit("'"), F.regexp_extract(m, f"(?iu)({CANNOT_IMPORT})", 1)
    same = (name != "") & (F.contains(text, F.concat(F.lit("No module named "), quote, name, quote)) | F.contains(text, F.concat(F.lit('No module named "'), name, F.lit('"'))))
    return (
        F.when((m != "") & F.contains(text, m), True)
        .when((filled(error_type) == "ModuleNotFoundError") | low.contains("no module named"), same)
        .when(low.contains("cannot import name"), (phrase != "") & F.contains(text, phrase))
        .otherwise(False)
    )


def dependency_category(error_type: Column) -> Column:
    return F.when(error_type.isin("ModuleNotFoundError", "ImportError"), "DEPENDENCY_ERROR").otherwise("OTHER")
