"""Context of failures: legacy tracebacks, repositories, snapshots of sources, notebook cells, and the nested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import one_row
from ..functions.text import filled, kept, once, split_paths, strip
from .rules import legacy_matches, normalized_fields

STORED_CHARS = 4_000
IMPORT_CELLS = 5
AROUND = 2
# The ruler around a failing cell, and the lines that import.
IMPORT_LINE = r"(?md)^\s*(import|from)\s+\S+"
CELL_SOURCE = r"(?s)executing the following cell:\s*\n-+\n(.*?)\n-+\n"
FILE_FIELDS = ["requirements", "setups", "pipfiles", "pipfile_locks"]
FILES = "array<struct<path:string,fetched:boolean,ref:string,content:string>>"


def cell_source(traceback: Column) -> Column:
    """The failing cell that a traceback quotes, or null."""
    return F.when(traceback.rlike(CELL_SOURCE), strip(F.regexp_extract(traceback, CELL_SOURCE, 1)))


def legacy_hints(data: DataFrame, legacy: DataFrame) -> DataFrame:
    """notebook_execution_id, legacy_traceback_hint (struct or null) and legacy_hint_rejected of rows whose notebook has a candidate.

    Candidates are joined on the notebook; only ids are aggregated, so texts of rows that lose are not shuffled again.
    """
    keys = data.where(filled(F.col("failing_module")) != "").select("notebook_execution_id", "notebook_id", "error_type", "error_message", "failing_module")
    found = keys.join(legacy.select(F.col("id").alias("legacy_id"), "notebook_id", "msg"), "notebook_id").where(F.contains("msg", "failing_module"))
    accepted = legacy_matches(F.col("error_type"), F.col("error_message"), F.col("failing_module"), F.col("msg"))
    best = found.groupBy("notebook_execution_id").agg(F.min(F.when(accepted, F.struct("legacy_id", "failing_module"))).alias("best")).select("notebook_execution_id", "best.legacy_id", "best.failing_module")
    hit = best.join(legacy.select(F.col("id").alias("legacy_id"), "msg"), "legacy_id", "left")
    hint = F.when(F.col("legacy_id").isNotNull(), F.struct(F.col("failing_module").alias("matched_module"), cell_source(F.col("msg")).alias("cell_source"), F.substring("msg", 1, STORED_CHARS).alias("raw_traceback")))
    return hit.select("notebook_execution_id", hint.alias("legacy_traceback_hint"), F.col("legacy_id").isNull().alias("legacy_hint_rejected"))


def join_legacy_hint(data: DataFrame, legacy: DataFrame) -> DataFrame:
    """Adds legacy_traceback_hint (struct or null) and legacy_hint_rejected."""
    return data.join(legacy_hints(data, legacy), "notebook_execution_id", "left").withColumn("legacy_hint_rejected", F.coalesce("legacy_hint_rejected", F.lit(False)))


def join_repository(data: DataFrame, repositories: DataFrame) -> DataFrame:
    return data.join(repositories.withColumnRenamed("id", "repository_id"), "repository_id", "left")


def _refs() -> Column:
    """References to look under, in order: the commit, main, master."""
    return F.filter(F.array(F.when(F.col("commit_ref") != "", F.col("commit_ref")), F.lit("main"), F.lit("master")), lambda r: r.isNotNull())


def _first_present(wanted: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """ref and content of the first reference that has the path, for each key of wanted (keys, repository, path, commit_ref)."""
    probes = wanted.select(*keys, "repository", "path", F.posexplode(_refs()).alias("rank", "ref"))
    found = probes.join(snapshot, ["repository", "ref", "path"])
    return found.groupBy(*keys).agg(F.min_by(F.struct("ref", "content"), "rank").alias("found")).select(*keys, "found.ref", "found.content")


def source_snapshots(data: DataFrame, snapshot: DataFrame) -> DataFrame:
    """notebook_execution_id, ref and content of the notebook's file, of rows with repository columns whose file is there."""
    wanted = data.where(filled(F.col("repository")) != "").select("notebook_execution_id", "repository", F.col("notebook_name").alias("path"), "commit_ref")
    return _first_present(wanted, snapshot, ["notebook_execution_id"])


def join_source_snapshot(data: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds ref and content of the notebook's file to rows with repository columns."""
    return data.join(source_snapshots(data, snapshot), "notebook_execution_id", "left")


def dependency_paths(data: DataFrame) -> DataFrame:
    """One row for each dependency file that a row with a repository lists: notebook_execution_id, field_no, pos, path."""
    fields = F.array(*[F.struct(F.lit(i).alias("field_no"), split_paths(F.col(c)).alias("paths")) for i, c in enumerate(FILE_FIELDS)])
    rows = data.where(filled(F.col("repository")) != "").select("notebook_execution_id", "repository", "commit_ref", F.explode(fields).alias("f"))
    return rows.select("notebook_execution_id", "repository", "commit_ref", "f.field_no", F.posexplode("f.paths").alias("pos", "path"))


def join_dependency_files(data: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row for each listed file with fetched, ref and content; files are looked up once per repository."""
    listed = dependency_paths(data)
    once = listed.select("repository", "commit_ref", "path").distinct()
    found = _first_present(once.withColumns({"_repo": F.col("repository"), "_path": F.col("path"), "_commit": F.coalesce("commit_ref", F.lit(""))}), snapshot, ["_repo", "_path", "_commit"])
    same = (F.col("repository") == F.col("_repo")) & (F.col("path") == F.col("_path")) & (F.coalesce("commit_ref", F.lit("")) == F.col("_commit"))
    out = listed.join(found, same, "left")
    return out.select("notebook_execution_id", "field_no", "pos", "path", F.col("content").isNotNull().alias("fetched"), "ref", F.when(F.col("content") != "", F.substring("content", 1, STORED_CHARS)).alias("content"))


def collect_files(files: DataFrame) -> DataFrame:
    order = F.sort_array(F.collect_list(F.struct("field_no", "pos", "path", "fetched", "ref", "content")))
    return files.groupBy("notebook_execution_id").agg(F.transform(order, lambda f: F.struct(f.path, f.fetched, f.ref, f.content)).cast(FILES).alias("dependency_files"))


def cells(content: Column) -> Column:
    """Cells of a notebook document: array of (cell_index over all cells, cell_type, source), or null."""
    listed = F.try_variant_get(F.try_parse_json(content), "$.cells", "array<variant>")
    return F.transform(
        listed,
        lambda c, i: F.struct(
            i.alias("cell_index"), F.try_variant_get(c, "$.cell_type", "string").alias("cell_type"),
            F.coalesce(F.array_join(F.try_variant_get(c, "$.source", "array<string>"), ""), F.try_variant_get(c, "$.source", "string"), F.lit("")).alias("source"),
        ),
    )


def notebook_cells(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("repository", "ref", "path", F.explode(cells(F.col("content"))).alias("c")).select("repository", "ref", "path", "c.*")


def notebook_context(content: Column, index: Column) -> Column:
    """failing_cell_source, import_cells and surrounding_cells; null if there are no cells."""
    listed = cells(content)
    pair = lambda c: F.struct(c.cell_index.cast("bigint").alias("cell_index"), c.source)
    imports = F.slice(F.filter(listed, lambda c: (c.cell_type == "code") & c.source.rlike(IMPORT_LINE)), 1, IMPORT_CELLS)
    near = F.filter(listed, lambda c: F.coalesce(F.abs(c.cell_index - index) <= AROUND, F.lit(False)))
    failing = F.when((index >= 0) & (index < F.size(listed)), F.try_element_at(listed, index.cast("int") + 1).source)
    return F.when(F.size(listed) > 0, F.struct(failing.alias("failing_cell_source"), F.transform(imports, pair).alias("import_cells"), F.transform(near, pair).alias("surrounding_cells")))


def context_status(remote: Column, legacy: Column, attempted: Column | bool) -> Column:
    return F.when(remote, "remote_fetched").when(legacy, "legacy_execution_hint").when(F.lit(attempted) if isinstance(attempted, bool) else attempted, "source_not_found").otherwise("metadata_only")


#: What a record is made of, in the order that `_lookups` and `_probes` name: itself, a file of its repository, a legacy row of its notebook.
_RECORD, _FILE, _LEGACY = "record", "file", "legacy"
_KEY = "struct<kind:string,a:string,b:string,c:string>"
#: The field number of a notebook's own source among its files.
_SOURCE = -1


def _key(kind: str, a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    empty = F.lit("")
    return F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), (empty if b is None else b).alias("b"), (empty if c is None else c).alias("c"))


def _wanted(fetch: bool) -> Column:
    """The keys that a record looks up: its own, its notebook's legacy rows, and its files under each reference in turn (rank)."""
    probe = lambda key, field, pos, path, rank, ref: F.struct(key.alias("key"), field.cast("int").alias("field_no"), pos.cast("int").alias("pos"), path.alias("path"), rank.cast("int").alias("rank"), ref.alias("ref"))
    none, text = F.lit(None), F.lit(None).cast("string")
    plain = lambda key: probe(key, none, none, text, none, text)
    parts = [F.array(plain(_key(_RECORD, F.col("notebook_execution_id")))), F.when(filled(F.col("failing_module")) != "", F.array(plain(_key(_LEGACY, F.col("notebook_id")))))]
    if fetch:
        under = lambda field, pos, path: F.transform(_refs(), lambda ref, rank: probe(_key(_FILE, F.col("repository"), ref, path), field, pos, path, rank, ref))
        each = lambda i: lambda path, pos: under(F.lit(i), pos, path)
        listed = [F.flatten(F.transform(split_paths(F.col(c)), each(i))) for i, c in enumerate(FILE_FIELDS)]
        parts.append(F.when(filled(F.col("repository")) != "", F.concat(under(F.lit(_SOURCE), F.lit(0), F.col("notebook_name")), *listed)))
    return F.filter(F.concat(*[F.coalesce(p, F.array().cast(f"array<struct<key:{_KEY},field_no:int,pos:int,path:string,rank:int,ref:string>>")) for p in parts]), lambda p: p.key.a.isNotNull() & p.key.c.isNotNull())


def _probes(rows: DataFrame, fetch: bool) -> DataFrame:
    """One row for each thing that a record looks up, and one for the record itself, which alone has its columns (own)."""
    known = kept(rows, ("probes", fetch), lambda: _wanted(fetch))
    names = [c for c in rows.columns if c not in ("commit_ref", "repository", *FILE_FIELDS)]
    out = rows.withColumn("_p", F.explode(known))
    kind = F.col("_p.key.kind")
    match_on = F.struct("error_type", "error_message", "failing_module")
    return out.select("notebook_execution_id", "_p.*", F.when(kind == _RECORD, F.struct(*names)).alias("own"), F.when(kind == _LEGACY, match_on).alias("failure"))


def _lookups(legacy: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    found = legacy.select(_key(_LEGACY, F.col("notebook_id")).alias("key"), F.col("id").alias("legacy_id"), F.col("msg").alias("text"))
    if snapshot is None:
        return found
    return found.unionByName(snapshot.select(_key(_FILE, F.col("repository"), F.col("ref"), F.col("path")).alias("key"), F.lit(None).cast("long").alias("legacy_id"), F.col("content").alias("text")))


def gather(rows: DataFrame, legacy: DataFrame, repositories: DataFrame, snapshot: DataFrame, fetch: bool = True) -> DataFrame:
    """The columns of rows with legacy_traceback_hint, legacy_hint_rejected, content (of the notebook's source) and dependency_files.

    Hints, sources and files are looked up in one join and meet the record in one aggregation by the execution, so each table is
    read once and five exchanges do it all: two for the repositories, two for the lookup, one for the records.
    Traceback and files are cut to what a record stores before they move again.
    """
    probes = _probes(join_repository(rows, repositories) if fetch else rows, fetch)
    found = probes.join(_lookups(legacy, snapshot if fetch else None), "key", "left")
    of = lambda name: F.col("key.kind") == name
    failure, text = F.col("failure"), F.col("text")
    candidate = of(_LEGACY) & F.coalesce(F.contains("text", "failure.failing_module"), F.lit(False))
    accepted = candidate & legacy_matches(failure.error_type, failure.error_message, failure.failing_module, text)
    hint = F.struct("legacy_id", F.struct(F.col("failure.failing_module").alias("matched_module"), cell_source(text).alias("cell_source"), F.substring("text", 1, STORED_CHARS).alias("raw_traceback")).alias("hint"))
    content = F.when(F.col("field_no") == _SOURCE, text).when(text != "", F.substring("text", 1, STORED_CHARS))
    file = F.struct("field_no", "pos", text.isNull().alias("gone"), "rank", "path", F.when(text.isNotNull(), F.col("ref")).alias("ref"), content.alias("content"))
    kept = found.where(~of(_LEGACY) | candidate).select(
        "notebook_execution_id", "own", F.when(accepted, hint).alias("hint"), candidate.alias("seen"), F.when(of(_FILE), file).alias("file"),
    )
    grouped = kept.groupBy("notebook_execution_id").agg(F.first("own", ignorenulls=True).alias("own"), F.min("hint").alias("best"), F.bool_or("seen").alias("seen"), F.sort_array(F.collect_list("file")).alias("files"))
    files = F.filter("files", lambda f, i: (i == 0) | F.coalesce((f.field_no != F.try_element_at("files", i).field_no) | (f.pos != F.try_element_at("files", i).pos), F.lit(True)))
    out = once(grouped, "_first", files)
    source = F.filter("_first", lambda f: f.field_no == _SOURCE)
    listed = F.transform(F.filter("_first", lambda f: f.field_no != _SOURCE), lambda f: F.struct(f.path, (~f.gone).alias("fetched"), f.ref, f.content)).cast(FILES)
    return out.select("own.*", F.col("best.hint").alias("legacy_traceback_hint"), (F.col("seen") & F.col("best").isNull()).alias("legacy_hint_rejected"), F.try_element_at(source, F.lit(1)).content.alias("content"), listed.alias("dependency_files"))


def enrich(rows: DataFrame, legacy: DataFrame, repositories: DataFrame, snapshot: DataFrame, fetch: bool = True) -> DataFrame:
    """The nested record of each classified failure.

    Rows have one execution each: those that repeat an id become one record, and rows without an id none (`quarantine_bad_rows` is for those).
    """
    out = once(gather(rows, legacy, repositories, snapshot, fetch), "remote", kept(rows, ("notebook_context",), lambda: notebook_context(F.col("content"), F.col("error_cell_index"))))
    none = F.array().cast("array<struct<cell_index:bigint,source:string>>")
    files = F.col("dependency_files")
    out = out.withColumn("context_status", context_status(F.col("remote").isNotNull(), F.col("legacy_traceback_hint").isNotNull(), fetch))
    remote_cell = F.when(F.col("remote.failing_cell_source") != "", F.col("remote.failing_cell_source"))
    context = F.struct(
        "error_type", "error_message", "failing_module", F.col("refined_subtype").alias("subtype"), "confidence", "root_cause_hint",
        F.coalesce(remote_cell, F.col("legacy_traceback_hint.cell_source")).alias("failing_cell_source"),
        F.coalesce("remote.import_cells", none).alias("import_cells"), F.coalesce("remote.surrounding_cells", none).alias("surrounding_cells"),
        files.alias("dependency_files"), "context_status",
    )
    return out.select(
        "notebook_execution_id", "repository_id", "notebook_id", "notebook_name", "repository_url", "error_type", "error_message", "error_cell_index",
        "failing_module", F.col("subtype").alias("original_subtype"), "refined_subtype", "confidence", "root_cause_hint", "context_status",
        "legacy_traceback_hint", "legacy_hint_rejected", files.alias("dependency_file_metadata"), context.alias("prompt_context"),
        *normalized_fields(F.col("error_type"), F.col("error_message"), F.col("failing_module")),
    )


def quarantine_bad_rows(raw: DataFrame) -> DataFrame:
    """Rows whose ids are no numbers (text columns) stay as metadata-only records with null ids and a reject flag."""
    ids = ["notebook_execution_id", "notebook_id", "repository_id"]
    bad = F.lit(False)
    for c in ids:
        bad = bad | (F.col(c).cast("string").try_cast("bigint").isNull())
    keep = F.coalesce("subtype", F.lit("out_of_scope"))
    return raw.select(
        *[F.col(c).cast("string").try_cast("bigint").alias(c) for c in ids], "error_type", "failing_module", keep.alias("original_subtype"),
        F.when(bad, keep).otherwise(F.col("refined_subtype")).alias("refined_subtype"), F.when(bad, "low").otherwise(F.col("confidence")).alias("confidence"),
        F.when(bad, "insufficient_context").otherwise(F.col("root_cause_hint")).alias("root_cause_hint"), F.when(bad, "metadata_only").alias("context_status"), bad.alias("rejected"),
    )


def hint_coverage(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(F.col("legacy_traceback_hint").isNotNull()).alias("with_hint"), F.count_if("legacy_hint_rejected").alias("with_rejected_hint"),
        F.count_if(F.col("context_status") == "remote_fetched").alias("remote_fetched"), F.count_if(F.col("context_status") == "metadata_only").alias("metadata_only"),
    )


def dependency_file_counts(files: DataFrame) -> DataFrame:
    """Files that were looked for and those that were there, of the rows of `join_dependency_files`."""
    return files.agg(F.count("*").alias("attempted"), F.count_if("fetched").alias("fetched"))


def legacy_coverage(data: DataFrame, legacy: DataFrame) -> DataFrame:
    """Rows, rows whose notebook has a legacy row, and those of them that a legacy row mentions the module of."""
    some = data.select("notebook_execution_id", "notebook_id", "failing_module")
    with_row = some.join(legacy, "notebook_id", "left_semi")
    mention = some.alias("s").join(legacy.alias("l"), (F.col("s.notebook_id") == F.col("l.notebook_id")) & (F.col("s.failing_module") != "") & F.contains("l.msg", "s.failing_module"), "left_semi")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return one_row(count(some, "rows"), count(with_row, "with_legacy"), count(mention, "mentioned"))
