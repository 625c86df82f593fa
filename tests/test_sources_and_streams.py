"""Readers and writers of files, and streams, by round trips through a folder."""

import json

import pytest
from pyspark.sql import functions as F

from parchment.operators import registry
from parchment.sources import files
from parchment.streaming import incremental


def put(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_test_folder(spark, tmp_path):
    fields = json.dumps({"fields": {"area": {"value": "2", "confidence": 0.5}}})
    put(tmp_path / "bn", a__png="x", a__txt=" one \n", b__JPG="x", b__txt="two", c__png="x", d__pdf="x", d__txt="no image")
    put(tmp_path / "scans", e__png="x", e__txt="five", e__lang=" ta ", e__json=fields, f__png="x", f__txt="six", f__json="{broken")
    got = {r["stem"]: r for r in files.read_test_folder(spark, str(tmp_path)).collect()}
    assert {s: (r["reference"].strip(), r["lang"]) for s, r in got.items()} == {"a": ("one", "bn"), "b": ("two", "bn"), "e": ("five", "ta"), "f": ("six", "hi")}
    assert got["e"]["fields"]["area"]["value"] == "2" and not got["f"]["fields"] and not got["a"]["fields"]


def test_annotations_and_results(spark, tmp_path):
    put(tmp_path, coco__json=json.dumps({"annotations": [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]}, indent=1), lines__jsonl='{"id": 3, "text": "c"}\n{"id": 4}\n')
    both = files.read_annotations(spark, str(tmp_path / "coco.json"), str(tmp_path / "lines.jsonl"))
    assert sorted((r["id"], r["text"]) for r in both.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    line = {"image_path": "p", "regions": [{"text": "t", "confidence": 0.5}], "structured_data": {"area": {"value": "2", "confidence": 0.25}}}
    put(tmp_path, results__json=json.dumps(line) + "\n" + json.dumps({"image_path": "q"}))
    rows = {r["image_path"]: r for r in files.flatten_results(files.read_results(spark, str(tmp_path / "results.json")), ["area", "owner"]).collect()}
    assert (rows["p"]["num_regions"], rows["p"]["field_area"], rows["p"]["field_area_conf"], rows["p"]["field_owner"]) == (1, "2", 0.25, None)
    assert (rows["q"]["num_regions"], rows["q"]["full_text"], rows["q"]["processing_time"]) == (0, "", 0.0)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, ""), (3, None)], "id int, t string")
    files.write_csv_quoted(df.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_text().splitlines() == ['"id","t"', '"1","say ""hi"", you"', '"2",""', '"3",""']
    files.write_json_rows(df, str(tmp_path / "json"))
    files.write_json_rows(df, str(tmp_path / "json"), mode="append")
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).count() == 6
    files.write_text(df.where("t <> ''"), "t", str(tmp_path / "text"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "text")).collect()] == ['say "hi", you']
    assert files.read_or_seed(spark, str(tmp_path / "none"), df).count() == 3 and files.read_or_seed(spark, str(tmp_path / "json"), df).count() == 6


def test_schema(tmp_path):
    put(tmp_path, good__json='{"fields": {"a": {}}}', list__json="[1]")
    assert files.load_schema(str(tmp_path / "good.json")) == {"a": {}} and files.load_schema(str(tmp_path / "list.json")) == {}
    with pytest.raises(OSError):
        files.load_schema(str(tmp_path / "none.json"))


def test_a_stopped_run_goes_on(spark, tmp_path):
    put(tmp_path / "in", a__json='{"id": 1}\n{"id": 2}')
    schema = spark.createDataFrame([], "id int").schema
    run = lambda: incremental.append_lines(incremental.new_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "seen")).awaitTermination()
    run()
    run()
    put(tmp_path / "in", b__json='{"id": 3}')
    run()
    assert sorted(r["id"] for r in spark.read.schema(schema).json(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_updates_and_first_sightings(spark, tmp_path):
    put(tmp_path / "in", a__json="".join(json.dumps({"ts": f"2024-01-01 {h:02d}:10:00", "event_type": "x", "k": h % 2}) + "\n" for h in (1, 1, 2, 3)))
    schema = spark.createDataFrame([], "ts timestamp, event_type string, k int").schema
    read = lambda: incremental.new_files(spark, str(tmp_path / "in"), schema)
    counted = incremental.actions_by_window(read())
    none = incremental.read_updates(spark, str(tmp_path / "w"), counted.schema, ["start", "event_type"], "n")
    assert none.count() == 0
    incremental.write_updates(counted, str(tmp_path / "w")).awaitTermination()
    put(tmp_path / "in", b__json=json.dumps({"ts": "2024-01-01 02:50:00", "event_type": "x", "k": 5}))
    incremental.write_updates(incremental.actions_by_window(read()), str(tmp_path / "w")).awaitTermination()
    got = incremental.read_updates(spark, str(tmp_path / "w"), counted.schema, ["start", "event_type"], "n")
    assert sorted((r["start"].hour, r["n"]) for r in got.collect()) == [(1, 2), (2, 2), (3, 1)]
    firsts = incremental.first_sightings(read(), F.col("k"), "ts", "12 hours")
    incremental.append_lines(firsts, str(tmp_path / "f"), str(tmp_path / "fc")).awaitTermination()
    assert sorted(r["k"] for r in spark.read.json(str(tmp_path / "f")).collect()) == [0, 1, 5]


def test_audit_scan(spark):
    rows = [(1, "A", 5.0, "o"), (2, "a", 5.0, "o"), (3, "b", None, ""), (4, None, 99.0, None), (5, None, 5.0, "o"), (6, "a", 0.0, "o")]
    records = spark.createDataFrame(rows, "k int, name string, area double, owner string")
    got = registry.audit_scan(records, F.col("name"), "k", F.col("area"), 1, 10, ["owner"])
    assert {r["k"]: r["issues"] for r in got.collect()} == {2: ["duplicate"], 3: ["area", "missing:owner"], 4: ["area", "missing:owner"], 6: ["duplicate", "area"]}
    assert registry.audit_scan(records.limit(0), F.col("name"), "k", F.col("area"), 1, 10, ["owner"]).count() == 0
