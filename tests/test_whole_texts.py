"""Queries over whole texts, of more letters and symbols than their prefixes have, against brute force."""

import os
import random
from collections import Counter

import pytest

from parchment import catalog
from tests.test_functions import plain_distance
from tests.test_queries import SF_DIR

r = random.Random(3)
TEXTS = [" ".join("".join(chr(r.choice((0x100, 0x4E00)) + r.randrange(120)) for _ in range(r.randint(1, 4))) + r.choice(("the", "on", "")) for _ in range(n)) for n in (5, 60, 150, 300, 90, 41)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS, 1)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rate(a, b):
    return float(bool(b)) if not a else plain_distance(a, b) / len(a)


def f1(a, b):
    g = [Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in (a, b)]
    both = (g[0] & g[1]).total()
    return float(a == b) if not a or not b else 2 * both / (g[0].total() + g[1].total())


def expected():
    for i, t in enumerate(TEXTS, 1):
        a, b = " ".join(t.split()), "" if i % 5 == 0 else " ".join((t.replace("the", "thee").replace("on", "o") + "x").split())
        yield i, ("en", "hi", "bn")[i % 3], a, b


def test_each_pair(spark, folder):
    run = lambda name: {x["id"]: x for x in catalog.queries()[name](spark, folder).collect()}
    got = {name: run(f"txt_{name}") for name in ("levenshtein", "cer", "wer", "f1", "similarity")}
    for i, _, a, b in expected():
        chars = plain_distance(a, b)
        assert (got["levenshtein"][i]["chars"], got["levenshtein"][i]["words"]) == (chars, plain_distance(a.split(), b.split()))
        assert got["cer"][i]["cer"] == pytest.approx(rate(a, b), abs=1e-6)
        assert got["wer"][i]["wer"] == pytest.approx(rate(a.split(), b.split()), abs=1e-6)
        assert got["f1"][i]["f1"] == pytest.approx(f1(a, b), abs=1e-6)
        assert got["similarity"][i]["similarity"] == pytest.approx(0.0 if not b else 1 - chars / max(len(a), len(b)), abs=1e-6)


def test_means(spark, folder):
    pairs = list(expected())

    def check(rows, key, keys_of):
        assert len(rows) == len({k for p in pairs for k in keys_of(p)})
        for row in rows:
            some = [p for p in pairs if (row[key] if key else None) in keys_of(p)]
            for c, of in (("cer", rate), ("f1", f1), ("wer", lambda a, b: rate(a.split(), b.split()))):
                assert row[c] == pytest.approx(sum(of(a, b) for _, _, a, b in some) / len(some), abs=2e-6)
            assert row["n"] == len(some) and row["accuracy"] == pytest.approx(1 - row["cer"], abs=2e-6)

    run = lambda name: catalog.queries()[name](spark, folder).collect()
    check(run("agg_metrics"), None, lambda p: (None,))
    check(run("agg_metrics_by_lang"), "lang", lambda p: (p[1],))
    check(run("agg_metrics_overall"), "lang", lambda p: (p[1], "OVERALL"))
    check(run("agg_metrics_by_model"), "model", lambda p: (p[0] % 2,))


def test_no_line_item_or_event_is_left_out(spark, tmp_path):
    items = [(image, 1, i + 1, i, 10.0, 0.05, 0.0, "N") for image in (1, 4999, 5000, 123_456) for i in (0, 1)]
    columns = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(items, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = catalog.queries()["jn_iou_pairs"](spark, str(tmp_path)).collect()
    assert sorted((p["image_id"], p["a"], p["b"]) for p in pairs) == [(image, 1, 2) for image in (1, 4999, 5000, 123_456)]
    seconds = {i: r.randrange(300_000) for i in range(500)}
    frame = spark.createDataFrame([*seconds.items(), (500, None)], "event_id long, s long")
    frame.selectExpr("event_id", "timestamp_seconds(s) as ts").write.parquet(f"{tmp_path}/events.parquet")
    places = {p["event_id"]: p["place"] for p in catalog.queries()["srt_newest_first"](spark, str(tmp_path)).collect()}
    assert places == {i: n for n, i in enumerate([*sorted(seconds, key=lambda i: (-seconds[i], -i)), 500], 1)}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", ["rank_match_index", "agg_record_conf", "flt_conf_threshold"])
def test_groups_are_not_collected(spark, name):
    assert "collect_list" not in catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_parsed_by_all_cores_after_a_shuffled_join(spark):
    """A shuffled join of few bytes leaves one task, however costly what follows is."""
    from parchment.plans import common, extraction_plans

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = extraction_plans.records(spark, SF_DIR)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert common.tasks_for(spark.range(95), 10) == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
