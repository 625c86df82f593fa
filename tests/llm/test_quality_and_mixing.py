import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parchment.llm import mixing
from parchment.llm.quality_rules import quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_base_metrics(spark, docs, corpus):
    odd = [(100, "a b c a b c a b", "s"), (101, "a a a a a", "s"), (102, "x # $ <|>\n\nx # $ <|>\n \n", "s"), (103, "a b c d a b c", None), (104, "a b c", "s")]
    more = spark.createDataFrame(odd, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules(docs.select("doc_id", "text", "source").unionByName(more)).collect()}
    for i, text, _ in [*corpus, *odd]:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(text), i
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    notice = "All  rights RESERVED"
    rows = [(i, f"{body(i)}\nall rights reserved", "a") for i in range(15)] + [(20, "\n".join([notice] * 40), "a"), (21, f"{body(21)}\n{notice}", "b")]
    rows += [(30 + i, body("copy"), "a") for i in range(20)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["clean_text"] == body(0) and got[0]["n_words_left"] == 60 and got[0]["kept"]
    assert not got[20]["kept"] and got[20]["n_words_left"] == 0
    assert got[21]["clean_text"].endswith(notice)  # rare in its host
    assert all(got[30 + i]["kept"] for i in range(20))  # copies are one text


def test_limit_does_not_grow_with_the_host(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(50))
    notice = body("notice")
    tail = lambda i: f"\n{notice}" if i < 101 else "\nseen in fewer" if i < 201 else ""
    rows = [(i, f"{body(i) if i else ''}{tail(i)}", "large") for i in range(6000)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 300").collect()}
    assert not got[0]["kept"] and not got[0]["base_failed"] and got[0]["n_words_left"] == 0  # nothing but the notice, in 101 of 6,000 documents
    assert all(got[i]["clean_text"] == body(i) and got[i]["kept"] for i in range(1, 101))
    assert all(got[i]["n_words_left"] == 53 for i in range(101, 201))


def test_rules_on_edges(docs, empty):
    assert quality_rules(empty).count() == 0
    got = quality_rules(docs)
    assert got.where("doc_id in (77, 78, 81) and (kept or n_words > 0)").count() == 0
    assert got.count() == docs.count() and [c for c in got.columns if c == "kept"] == ["kept"]
    assert quality_rules(docs.unionByName(docs)).count() == 2 * docs.count()


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, full, rest = {s: 0.0 for s in names}, set(), 1.5 * sum(sizes.values())
    while rest > 1e-9:
        free = [s for s in names if s not in full]
        total, left = sum(weight[s] for s in free), 0.0
        for s in free:
            want[s] += rest * weight[s] / total
            if want[s] >= 2 * sizes[s]:
                left += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                full.add(s)
        rest = left
    return want


def test_mix(docs, corpus):
    rows = mixing.mix_plan(docs, block_words=16).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    assert len(rows) == len(corpus)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert (r["first_slot"] is None) == (r["taken"] == 0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix_plan(docs.repartition(7), block_words=16).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_schedule_is_even(spark):
    blocks = spark.createDataFrame([(0, 600), (1, 300), (2, 100), (3, 1)], "src int, n_slots long")
    slots = sorted((r["slot"], r["src"], r["rank"]) for r in mixing.schedule(blocks).collect())
    for src, n in ((0, 600), (1, 300), (2, 100), (3, 1)):
        own = [s for s in slots if s[1] == src]
        assert [r for _, _, r in own] == list(range(n))
        half = sum(s[0] < 500 for s in own)
        assert abs(half - n / 2) <= 6


def test_mixed_documents(docs, empty):
    plan = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({i: r["taken"] for i, r in plan.items() if r["taken"]})
    assert mixing.mix_documents(empty).count() == 0 and mixing.mix_plan(empty).count() == 0
    twice = mixing.mix_plan(docs.unionByName(docs))
    assert twice.count() == 2 * docs.count() and twice.where("taken > 2 * size").count() == 0
    assert mixing.mix_plan(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == docs.count()


def test_the_mix_is_in_the_order_of_the_schedule(docs):
    plan = {r["doc_id"]: r for r in mixing._plan(docs, block_words=16).collect()}
    got, seen = [r["doc_id"] for r in mixing.mix_documents(docs.coalesce(1), block_words=16).coalesce(1).collect()], Counter()
    rows = mixing.mix_documents(docs, block_words=16).withColumn("part", F.spark_partition_id()).collect()
    for part in {r["part"] for r in rows}:
        some, own, slots = [r["doc_id"] for r in rows if r["part"] == part], Counter(), []
        for i in some:
            slots.append(plan[i]["epoch_slots"][own[i]])
            own[i] += 1
        assert None not in slots and slots == sorted(slots)
        seen += own
    assert Counter(got) == seen and len(seen) > 60
    assert all(plan[i]["first_slot"] == min(s for s in plan[i]["epoch_slots"] if s is not None) for i in seen)
