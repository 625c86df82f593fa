import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import classifier
from parchment.llm import language_model as lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_base_score_is_exact(docs, corpus):
    counts, tokens = Counter(), {}
    for i, t, _ in corpus:
        tokens[i] = [*WORD.findall(low(t)), "<end>"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    n, v = counts.total(), len(counts)
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_edges(docs, empty):
    assert lm.score_documents(empty).count() == 0
    no_ids = lm.score_documents(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert no_ids.count() == docs.count()
    held = docs.where(lm.held_out(F.col("doc_id")))
    assert {r["base_score"] for r in lm.score_documents(held).collect()} == {0.0}


def test_filter_gives_back_levels():
    hashes = np.random.default_rng(0).integers(0, 2**63, 4000, np.uint64)
    counts = np.arange(4000) % 40
    level = lm.level_of(counts)
    assert all(lm.STARTS[l] <= c < lm.STARTS[l + 1] for l, c in zip(level, counts) if c) and set(level[counts == 0]) == {-1}
    got = lm.Filter.of(hashes, counts, lm.WORD).levels(hashes)
    assert (got >= level).all() and (got != level).mean() < 0.01  # a false positive raises a level
    none = lm.Filter.of(hashes[:0], counts[:0], lm.PAIR)
    assert set(none.levels(hashes).tolist()) == {-1}


def test_packed_hashes_and_counts():
    hashes = np.sort(np.random.default_rng(0).integers(0, 2**64 - 1, 3000, np.uint64))
    for segments in (256, 1024, 4096):
        for kind in (lm.WORD, lm.PAIR):
            kept = lm.short(hashes, kind)
            for i in range(0, 3000, 100):
                segment = int(lm._segment(kept[i : i + 1], kind, segments)[0])
                assert 0 <= segment < segments and lm._unpack(lm._pack(kept[i : i + 1], kind), kind, segment, segments) == kept[i]
    counts = np.array([0, 1, 254, 255, 256, 2**40, 0])
    assert lm._unpack_counts(*lm._pack_counts(counts)).tolist() == counts.tolist()


def learnt(texts):
    """Counts of words and of bigrams of the texts of a list that the model learns from, and how many those are."""
    words, two = Counter(), Counter()
    some = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    for i in some:
        own = [*texts[i].split(), "<end>"]
        words.update(own)
        two.update(zip(["<start>", *own], own))
    return words, two, len(some)


def level(count):
    return max(i for i, s in enumerate(lm.STARTS) if s <= count) if count else -1


def model_of(words, two, n_texts):
    types, times = np.zeros((2, lm.LEVELS), np.int64), np.zeros((2, lm.LEVELS), np.int64)
    for kind, counts in enumerate((words, two)):
        for c in counts.values():
            types[kind, level(c)] += 1
            times[kind, level(c)] += c
    return lm.Model.of(types, times, n_texts)


TEXTS = ["b c a x y x", "a b", "c d e f a b", "g h a b", "", "a b c unknown", "x y b c", "a b", "a a a a a a b", "q r s t", "u b v b w b", "END of it"] * 2 + ["once only", "a b c d e"]


def test_chances_sum_to_one_at_most():
    words, two, n_texts = learnt(TEXTS)
    model = model_of(words, two, n_texts)
    seen = np.array([level(c) for c in words.values()])
    alone = model.alone(seen)
    unseen = float(model.alone(np.array([-1]))[0])
    assert alone.sum() + model.n_unseen * unseen == pytest.approx(1) and unseen <= alone.min()
    for h in [*words, "<start>", "never seen"]:
        both = np.array([level(two[h, w]) for w in words])
        before = np.full(len(words), level(words[h]))
        first = np.full(len(words), h == "<start>")
        for i, chance in enumerate(model.chances(seen, both, before, first)):
            rest = [*model.chances(np.array([-1]), np.array([-1]), before[:1], first[:1])][i][0]
            assert chance.min() > 0 and chance.sum() + model.n_unseen * rest <= 1 + 1e-9


@pytest.mark.parametrize("segments", [256, 1024])
def test_no_count_is_dropped(spark, monkeypatch, segments):
    """Scores are those of a model of all counts, bigrams seen once among them, whatever the number of chunks and segments."""
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 if segments > 256 else 1 << 30)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40)
    low = [t.replace("END", "end") for t in TEXTS]
    words, two, n_texts = learnt(low)
    model = model_of(words, two, n_texts)
    assert 1 in two.values()
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string").repartition(3)).collect()}
    exact = [i for i, t in enumerate(low) if got[i]["score"] == pytest.approx(plain_score(model, words, two, n_texts, t, got[i]["bigram_weight"]))]
    assert len(got) == len(TEXTS) and len(exact) >= len(TEXTS) - 3  # a false positive raises a level


def plain_score(model, words, two, n_texts, text, weight):
    """The score of a text from dictionaries of counts, quantised as the filter's are."""
    before, total = "<start>", 0.0
    for w in [*text.split(), "<end>"]:
        most = n_texts if before == "<start>" else lm.STARTS[level(words[before]) + 1] - 1 if words[before] else 0
        alone = (model.mean[level(words[w])] - model.discount) / words.total() if words[w] else model.discount * len(words) / words.total() / model.n_unseen
        share = min(1.0, (lm.STARTS[level(two[before, w])] if two[before, w] else 0) / most) if most else 0.0
        total += math.log10(weight * share + (1 - weight) * alone if most else alone)
        before = w
    return total


def test_a_stored_model_scores_documents_that_it_has_not_seen(spark, tmp_path):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    text = lambda: " ".join(vocabulary[int(900 * r.random() ** 3)] for _ in range(r.randint(1, 30)))
    seen, other = [text() for _ in range(400)], [text() + " neverseen" * (i % 3) for i in range(300)] + ["", "w0"]
    words, two = Counter(), Counter()
    for t in seen:
        own = [*t.split(), "<end>"]
        words.update(own)
        two.update(zip(["<start>", *own], own))
    frame = lambda texts: spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    lm.fit(frame(seen), str(tmp_path / "model"))
    stored = lm.load(spark, str(tmp_path / "model"))
    model = model_of(words, two, len(seen))
    got = {x["doc_id"]: x for x in lm.score(frame(other), stored).collect()}
    assert len(got) == len(other) and all(x["held_out"] and x["train_tokens"] == words.total() for x in got.values())
    for i, t in enumerate(other):
        own = [*t.split(), "<end>"]
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(own), sum(words[w] > 0 for w in own))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (words.total() + len(words) + 1)) for w in own))
    weight = lm.WEIGHTS[stored.weight]
    same = sum(got[i]["score"] == pytest.approx(plain_score(model, words, two, len(seen), t, weight)) for i, t in enumerate(other))
    grams = sum(2 * len(t.split()) + 2 for t in other)
    assert same < len(other)  # scores come from bits, some of which affirm what isn't there
    assert len(other) - same < 0.01 * grams  # but no more than 1 % of what is asked
    assert lm.score(frame(other).limit(0), stored).count() == 0
    nothing = lm.fit(frame(seen).limit(0), str(tmp_path / "nothing"))
    assert {x["score"] for x in lm.score(frame(other), nothing).collect()} == {0.0}


def test_rows_of_learning_hold_each_ngram_once_a_chunk(spark):
    rows = spark.createDataFrame([(str(i), t, False) for i, t in enumerate(TEXTS)], "doc_id string, text string, held_out boolean")
    chunks = lm.chunked(rows.coalesce(1))
    for segments in (256, 2048):
        learnt, asked = lm.learn(chunks, segments).collect(), lm.ask(chunks, segments).collect()
        for rows in (learnt, asked):
            per = Counter((r["kind"], r["segment"], r["g"]) for r in rows)
            assert set(per.values()) == {1}
            assert sum(len(lm._unpack(r["hashes"], r["kind"], r["segment"], segments)) for r in rows) == len({*" ".join(TEXTS).lower().split(), "<end>"}) + len(
                {p for t in TEXTS for p in zip(["<start>", *t.lower().split()], [*t.lower().split(), "<end>"])}
            )


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, "a b " * 200_000), (2, "a"), (2, "a"), (None, "b"), (3, "\u00c9 \u00e9")]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 400_001), (2, 2), (2, 2), (3, 3)]
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def labelled(spark):
    good = [f"The {i} quick words of plain prose run on and on, as sentences do in text number {i}." for i in range(120)]
    bad = [f"BUY!!! NOW!!! CHEAP{i}!!! ###{i}### $$$ CLICK!!! HERE!!!" for i in range(120)]
    rows = [(i, t, int(i < 120)) for i, t in enumerate(good + bad)]
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_classifier_tells_held_out_documents_apart(spark):
    df = labelled(spark)
    labels = df.select("doc_id", F.col("y").alias("quality"))
    model = classifier.train(df.select("doc_id", "text"), labels)
    got = classifier.classify(df, model).where("held_out").collect()
    assert len(got) > 20 and all(r["predicted"] == r["y"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_the_driver_gives_back_what_training_took(spark, monkeypatch):
    order, fit = [], classifier.fit
    monkeypatch.setattr(classifier, "fit", lambda *a: order.append("fit") or fit(*a))
    monkeypatch.setattr(classifier, "give_back", lambda: order.append("give back"))
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    classifier.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert order == ["fit", "give back"]


def test_held_out_labels_have_no_say(spark):
    df = labelled(spark)
    labels = df.select("doc_id", F.col("y").alias("quality"))
    turned = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.train(df.select("doc_id", "text"), x) for x in (labels, turned))
    assert a.bias == b.bias and (a.gain == b.gain).all()


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    got = classifier.classify(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.columns.count("score") == 1
    assert classifier.classify(empty, model).count() == 0
    none = classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in classifier.classify(docs, none).collect()} == {0.5}
    bounded = classifier.train(docs, labels, max_docs=1, max_chars=10)
    assert np.isfinite(bounded.bias)


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["ab cd ab ab", "", "  x\ny ", "éé ab", "  "]
    gain = np.random.default_rng(0).normal(size=classifier.BUCKETS).astype(np.float32)
    model = classifier.Model(gain, 0.25)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])
    one, two = (list(classifier.features(t)) for t in (["ab ab cd"], ["x ab", "ab cd"]))
    assert len(one[1][0]) == 2 and one[1][0][1] == two[1][0][1] and two[1][1].tolist() == [0, 1]
