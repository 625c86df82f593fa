"""Results and audit entries as streams: what batch runs do by resuming and appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, format: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Rows of files that come into a folder. A query's checkpoint knows the files it has seen, so a stopped run goes on
    with those it hasn't: the stream's form of leaving out inputs that are done."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def append_lines(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends all rows that are there as JSON lines, each once, and ends."""
    return df.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def actions_by_window(audit: DataFrame, ts: str = "ts", action: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """How many actions of each kind a window of event time has; rows later than `late` behind the newest are left out,
    and a window's state goes once no row can change it."""
    w = F.window(ts, window)
    counted = audit.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, action).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), action, "n")


def write_updates(counted: DataFrame, folder: str) -> StreamingQuery:
    """Writes what each batch changes in counted below the folder, which also holds the checkpoint, and ends. A batch that
    is run again replaces what it wrote; state that the watermark has passed is dropped."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, folder: str, schema: StructType, keys: list[str], value: str) -> DataFrame:
    """The last value of each key that write_updates has written; none where no batch has run."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{folder}/rows").schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def first_sightings(df: DataFrame, key: Column, ts: str, within: str) -> DataFrame:
    """Rows whose key wasn't seen within a span of event time before; keys older than that leave the state."""
    return df.withColumn("_key", key).withWatermark(ts, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
