"""What the operators share: tables that cut lineage, running sums in chunks, and word counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only where the session names none (tests in local mode) a folder of this machine is set; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table that `materialize` wrote and that nothing will read again."""
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a Python worker turns into objects at a time.
ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that a worker holds few texts as Python objects, however many rows Spark sends at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_count(column: str = "text"):
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, key: str, chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows before each one, in the order of chunk and order within key.

    Sums run within the chunks of a key, then over the chunks, so that a key with most rows is no single task.
    """
    inner = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_sum")).drop("_sum")
    return df.withColumn("_inner", F.sum(value).over(inner) - value).join(before, [key, chunk]).withColumn(name, F.col("_inner") + F.col("_before")).drop("_inner", "_before")
