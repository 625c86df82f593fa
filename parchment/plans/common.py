"""What the plans share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from parchment.sources.tables import table

__all__ = ["shared_folder", "spread", "table", "written"]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder where a session on one machine names none."""
    named = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return named or tempfile.mkdtemp(prefix="parchment-")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: DuckDB: a struct as text, so that nested results compare as strings.
STATUS = "case o_orderstatus when 'F' then 'Verified' when 'O' then 'Pending' else 'Flagged' end"


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks leave so many rows of a scan to each, all cores at least; the files' footers tell its rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A scan for costly expressions: over all cores where its files are too small to be split for them; any larger scan stays
    as it is, without a shuffle. With `rows`, in as many parts as leave so many rows to each, if these are more."""
    parts = tasks_for(df, rows) if rows else df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
