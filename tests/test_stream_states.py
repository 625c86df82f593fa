"""The stream of document states: replays in any batches, restarts, rows that are too late."""

import random
from datetime import datetime, timedelta

import pytest

from parchment.streaming import states

SCHEMA = "doc long, ts timestamp, id long, status string"
START = datetime(2024, 3, 1)
END = (-1, START + timedelta(days=900), -1, None)


def life(seed, n=120):
    """Events in order of time but for up to half an hour, of few documents, with ties."""
    r = random.Random(seed)
    kinds = [s for bs in states.STEPS.values() for s in bs] + ["Other", None]
    rows = [(r.randrange(5), START + timedelta(minutes=20 * i + r.choice([0, 0, 30])), i, r.choice(kinds)) for i in range(n)]
    rows = [(d, ts, i, s) for d, ts, i, s in rows] + [(2, rows[50][1], 1000, "Uploaded"), (2, rows[50][1], 999, "Processing")]
    return sorted(rows, key=lambda x: (x[1] + timedelta(minutes=r.randrange(30)), x[2]))


def put(spark, rows, folder, k):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = states.run_states(states.document_states(stream, "doc", "ts", "id", "status", "2 hours", "1 hour"), folder)
    query.awaitTermination()
    assert query.exception() is None


def found(spark, folder):
    return sorted((tuple(x) for x in spark.read.schema(states.OUT).parquet(f"{folder}/rows").collect()), key=repr)


def wanted(spark, rows):
    return sorted((tuple(x) for x in states.states_in_batch(spark.createDataFrame(rows, SCHEMA), "doc", "ts", "id", "status", "2 hours").collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_replay_in_batches(spark, tmp_path, batches):
    rows = life(1)
    for k in range(batches):
        put(spark, rows[k * len(rows) // batches : (k + 1) * len(rows) // batches], tmp_path, k)
    put(spark, [END, (None, START, 5, "x"), (3, None, 6, "x")], tmp_path, 99)
    run(spark, tmp_path)
    got = found(spark, tmp_path)
    assert got == wanted(spark, rows) and len(got) == len(rows)


def test_restart_goes_on_and_late_rows_are_left_out(spark, tmp_path):
    rows = life(2)
    put(spark, rows[:60], tmp_path, 0)
    run(spark, tmp_path)
    first = found(spark, tmp_path)
    put(spark, rows[60:], tmp_path, 1)
    put(spark, [(1, START - timedelta(days=1), 5000, "Uploaded")], tmp_path, 2)  # far behind the watermark by now
    put(spark, [END], tmp_path, 3)
    run(spark, tmp_path)
    got = found(spark, tmp_path)
    assert got == wanted(spark, rows) and set(first) <= set(got) and 0 < len(first) < len(got)
    run(spark, tmp_path)
    assert found(spark, tmp_path) == got


def test_documents_share_states(spark, tmp_path):
    """Calls of the processor and its state store grow with groups of documents, not with documents."""
    rows = [(d, START + timedelta(minutes=d % 40), d, "Uploaded") for d in range(-50, 3000)]
    put(spark, rows, tmp_path, 0)
    put(spark, [END], tmp_path, 1)
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = states.run_states(states.document_states(stream, "doc", "ts", "id", "status", "2 hours", "1 hour"), tmp_path)
    query.awaitTermination()
    assert found(spark, tmp_path) == wanted(spark, rows)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < len(rows) / 4
