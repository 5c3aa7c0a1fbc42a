"""Scans and sinks. Outputs go below the folder that the session shares with its executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SCHEMA = (
    "notebook_execution_id bigint, repository_run_id bigint, repository_id bigint, notebook_id bigint, notebook_name string, repository_url string, "
    "execution_status string, error_type string, error_category string, error_message string, error_cell_index bigint, error_count int, "
    "failing_module string, subtype string, scope_status string, exclusion_reason string, split string, created_at string"
)
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; without one, a folder of this machine in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _OWN.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, where several parts of a plan begin with it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_dependency_errors(executions: DataFrame) -> DataFrame:
    """Failed executions of the dependency category; the filter and the columns reach the scan."""
    return executions.where("error_category = 'DEPENDENCY_ERROR'").select(
        "notebook_execution_id", "repository_run_id", "repository_id", "notebook_id", "notebook_name", "repository_url", "execution_status",
        "error_type", "error_category", "error_message", "error_cell_index", "error_count", "created_at",
    )


def scan_legacy_executions(legacy: DataFrame) -> DataFrame:
    """Legacy rows; messages may be bytes, whose faulty parts become replacement characters."""
    return legacy.select("id", "notebook_id", F.make_valid_utf8(F.col("msg").cast("binary").cast("string")).alias("msg"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)


def scan_csv(spark: SparkSession, path: str, schema: str = CSV_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are written, unlike Spark's default."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def scan_jsonl(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds parsed (variant), error to rows that hold one line each; blank lines go, malformed ones get an error."""
    from ..functions.jsontext import strict

    kept = lines.where(F.coalesce(F.col(column), F.lit("")).rlike(r"(?U)\S"))
    return kept.withColumn("parsed", strict(F.col(column))).withColumn("error", F.when(F.col("parsed").isNull(), "malformed JSON"))


MANIFEST = "run_id string, version string, committed_at timestamp, rows long"


def commit_runs(rows: DataFrame, path: str, runs: list[str] | None = None, by: tuple[str, ...] = ()) -> str:
    """Write the rows of one or more runs (column run_id) below path, as the state of those runs from now on; returns the version.

    Rows go to partitions of a version that no reader knows until its runs stand in the manifest, which is written last: a
    write that stops half way is never read, and writing a run again replaces it. `runs` names runs that may have no rows.
    """
    spark = rows.sparkSession
    version = uuid.uuid4().hex
    staged = rows.withColumn("version", F.lit(version))
    staged.write.mode("append").partitionBy("version", "run_id", *by).parquet(f"{path}/data")
    written = spark.read.schema(staged.schema).parquet(f"{path}/data").where(F.col("version") == version)
    counts = written.groupBy("run_id").agg(F.count("*").alias("rows"))
    if runs:
        named = spark.createDataFrame([(r,) for r in runs], "run_id string")
        counts = named.join(counts, "run_id", "full").select("run_id", F.coalesce("rows", F.lit(0)).alias("rows"))
    counts.select("run_id", F.lit(version).alias("version"), F.current_timestamp().alias("committed_at"), "rows").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def committed_versions(spark: SparkSession, path: str) -> DataFrame:
    """run_id, version and rows of the last commit of each run."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    last = F.max_by(F.struct("version", "rows"), F.struct("committed_at", "version"))
    return manifest.groupBy("run_id").agg(last.alias("l")).select("run_id", "l.version", "l.rows")


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """The committed rows of all runs, with the columns of schema; partitions of other versions are not read."""
    names = [f.name for f in schema.fields]
    known = committed_versions(spark, path).select("run_id", "version")
    stored = type(schema)([*schema.fields]).add("version", "string")
    return spark.read.schema(stored).parquet(f"{path}/data").join(known, ["run_id", "version"], "left_semi").select(*names)


def drop_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Remove versions that no run's last commit names, torn writes among them, and return their names; not beside a running write."""
    files = spark._jvm.org.apache.hadoop.fs
    root = files.Path(f"{path}/data")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f.getPath() for f in system.listStatus(root) if f.getPath().getName().startswith("version=")]
    keep = {r["version"] for r in committed_versions(spark, path).select("version").distinct().collect()}
    old = [p for p in there if p.getName().removeprefix("version=") not in keep]
    for p in old:
        system.delete(p, True)
    return sorted(p.getName().removeprefix("version=") for p in old)
