"""The life of documents as a stream with state: what each event found, whether the step was allowed, and its session.

Events may come late and out of order. A document's events wait in its state until the watermark has passed them, so they are
taken in order of time whatever the batches were, and a replay gives what a batch query over all events gives. Events
that are later than the watermark allows are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The steps that a document may take; a new one has no status.
STEPS = {None: ("Uploaded",), "Uploaded": ("Processing",), "Processing": ("OCR Completed", "OCR Failed"), "OCR Failed": ("Processing",), "OCR Completed": ()}
OUT = "key long, tie long, at long, status string, previous string, allowed boolean, session_start long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Documents whose keys differ in their last KEY_BITS bits alone share a state and its timers, and are taken together.
KEY_BITS = 5
WAITING = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("tie", pa.int64()), ("status", pa.string())])
LAST = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("status", pa.string()), ("session_start", pa.int64())])


def _packed(columns: list, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema)], schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(chunks: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(c)).read_all() for c in chunks)])


class DocumentStates(StatefulProcessor):
    """Per group of keys: chunks of the events that wait, and the last one taken of each key with the start of its session. A timer
    stands at the earliest event that waits."""

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.last = handle.getValueState("last", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            if len(df):
                self.waiting.appendValue((_packed([df[c] for c in WAITING.names], WAITING),))
                first = min(int(df["at"].min()), first) if first is not None else int(df["at"].min())
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpacked([x[0] for x in self.waiting.get()], WAITING) if self.waiting.exists() else WAITING.empty_table()
        early = np.asarray(waiting["at"]) <= passed
        if not early.any():
            return iter([])
        last = _unpacked([self.last.get()[0]], LAST) if self.last.exists() else LAST.empty_table()
        out, taken = self._taken(waiting.filter(pa.array(early)), last)
        self.last.update((taken,))
        self.waiting.clear()
        rest = waiting.filter(pa.array(~early))
        if len(rest):
            self.waiting.appendValue((_packed([rest[c].combine_chunks() for c in WAITING.names], WAITING),))
            self.handle.registerTimer(-(-int(np.asarray(rest["at"]).min()) // 1000))
        return iter([out])

    def _taken(self, ready: pa.Table, last: pa.Table) -> tuple[pd.DataFrame, bytes]:
        """The result of events whose time has come, and the last event of each key after them."""
        keys, at, tie = (np.asarray(ready[c]) for c in ("key", "at", "tie"))
        order = np.lexsort((tie, at, keys))  # events of one time and tie stay as they came
        keys, at, tie = keys[order], at[order], tie[order]
        status = ready["status"].take(pa.array(order)).to_pylist()
        before = {x["key"]: x for x in last.to_pylist()}
        starts = np.concatenate([[True], keys[1:] != keys[:-1]])
        fresh = np.concatenate([[True], at[1:] - at[:-1] > self.gap])
        session, previous = at.copy(), [None, *status[:-1]]
        for i in np.flatnonzero(starts).tolist():
            known = before.get(int(keys[i]))
            previous[i] = known["status"] if known else None
            if known and int(at[i]) - known["at"] <= self.gap:
                session[i] = known["session_start"]
        session = session[np.maximum.accumulate(np.where(starts | fresh, np.arange(len(at)), 0))]
        allowed = [s in STEPS.get(p, ()) for p, s in zip(previous, status)]
        for i in np.flatnonzero(np.concatenate([starts[1:], [True]])).tolist():
            before[int(keys[i])] = {"key": int(keys[i]), "at": int(at[i]), "status": status[i], "session_start": int(session[i])}
        out = pd.DataFrame({"key": keys, "tie": tie, "at": at, "status": status, "previous": previous, "allowed": allowed, "session_start": session})
        return out, _packed([[x[c] for x in before.values()] for c in LAST.names], LAST)

    def close(self) -> None:
        pass


def document_states(events: DataFrame, key: str, ts: str, tie: str, status: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """A stream of OUT: each event with the document's status before it, whether the step is one of STEPS, and when its session
    began (one ends where nothing happens for longer than `gap`); times in microseconds. Events without key, time or tie
    are left out. Events of one time are taken by tie."""
    micros = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(tie).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(status).alias("status"))
    rows = rows.withColumn("keys", F.shiftright("key", KEY_BITS))
    return rows.withWatermark("ts", late).groupBy("keys").transformWithStateInPandas(DocumentStates(micros), OUT, "Append", "EventTime")


def states_in_batch(events: DataFrame, key: str, ts: str, tie: str, status: str, gap: str = "12 hours") -> DataFrame:
    """What document_states gives of all events, as a batch query with windows."""
    micros = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(tie).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(tie).cast("long").alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(status).alias("status"))
    order = W.partitionBy("key").orderBy("at", "tie")
    rows = rows.withColumns({"previous": F.lag("status").over(order), "new": F.coalesce(F.col("at") - F.lag("at").over(order) > micros, F.lit(True))})
    steps = [F.col("previous").eqNullSafe(F.lit(a)) & F.col("status").eqNullSafe(F.lit(b)) for a, bs in STEPS.items() for b in bs]
    allowed = F.greatest(*steps)
    session = F.last(F.when(F.col("new"), F.col("at")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("key", "tie", "at", "status", "previous", allowed.alias("allowed"), session.alias("session_start"))


@contextmanager
def stateful(spark: SparkSession):
    """The session with the state store that processors with timers need, for queries that start within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run_states(states: DataFrame, folder: str) -> StreamingQuery:
    """Writes states as Parquet below the folder, which also holds the checkpoint, each once, until all that is there is read. A
    query that was stopped goes on where it was when it is started with the same folder."""
    with stateful(states.sparkSession):
        return states.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
