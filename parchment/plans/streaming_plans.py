"""Streams over the tables, run until what is there is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parchment.plans.common import shared_folder, table
from parchment.streaming import states
from parchment.streaming.incremental import actions_by_window, read_updates, write_updates

QUERIES, ORACLE_SQL = {}, {}


def stream_audit_windows(spark, d):
    """Actions by hour of event time. The stream ends with the table, so its last windows are complete."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = actions_by_window(stream)
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    write_updates(counted, folder).awaitTermination()
    return read_updates(spark, folder, counted.schema, ["start", "event_type"], "n").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES["stream_audit_windows"] = stream_audit_windows
ORACLE_SQL["stream_audit_windows"] = "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2"


#: Events of users as the life of documents.
_STATUS = {"signup": "Uploaded", "view": "Processing", "click": "Processing", "purchase": "OCR Completed", "error": "OCR Failed"}
_STEP = " or ".join(f"({'previous is null' if a is None else f"previous = '{a}'"} and status = '{b}')" for a, bs in states.STEPS.items() for b in bs)


def stream_document_states(spark, d):
    """Every event of a document with the status before it and its session, by a stream with state. A last row far ahead in time
    lets the watermark pass all others."""
    folder = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _STATUS.items()])
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").alias("doc"), status.alias("status"))
    events.write.parquet(f"{folder}/in/a")
    end = events.agg(F.max("ts").alias("ts")).select(F.timestamp_add("day", F.lit(1), "ts").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("doc"), F.lit(None).cast("string").alias("status"))
    end.write.parquet(f"{folder}/in/b")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    states.run_states(states.document_states(stream, "doc", "ts", "event_id", "status"), folder).awaitTermination()
    rows = spark.read.schema(states.OUT).parquet(f"{folder}/rows")
    at = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select(F.col("tie").alias("event_id"), F.col("key").alias("doc"), "status", "previous", "allowed", at("session_start").alias("session_start"))


QUERIES["stream_document_states"] = stream_document_states
ORACLE_SQL["stream_document_states"] = f"""with e as (select event_id, user_id as doc, ts, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _STATUS.items())} end as status from events),
l as (select *, lag(status) over w as previous, coalesce(ts - lag(ts) over w > interval 12 hours, true) as fresh from e window w as (partition by doc order by ts, event_id))
select event_id, doc, status, previous, ({_STEP}) is true as allowed,
  strftime(last_value(case when fresh then ts end ignore nulls) over (partition by doc order by ts, event_id rows unbounded preceding), '%Y-%m-%d %H:%M:%S.%f') as session_start from l"""
