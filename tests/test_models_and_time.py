"""Alerts, states at events, sketches, the language model and the noisy channel against brute force."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parchment.operators import alerts, channel, correction, langmodel, sketches, temporal
from test_correction import distance

DAY = datetime(2024, 1, 1)


def at(days):
    return None if days is None else DAY + timedelta(days=days)


def intervals(spark, r, n):
    rows = []
    for i in range(n):
        start = r.choice([None, r.uniform(-4000, 4000), r.uniform(0, 40), 5.0])
        length = r.choice([0, r.uniform(0, 5), r.uniform(0, 300), 8000, 2_000_000, -1])
        end = None if start is None or i % 23 == 0 else min(start + length, 2_900_000)
        rows.append((i, r.choice(["hot", "hot", "a", "b", None]), at(start), at(end)))
    return rows, spark.createDataFrame(rows, "id long, k string, s timestamp, e timestamp")


@pytest.mark.parametrize("days", [0.5, 30])
def test_overlapping_intervals(spark, days):
    r = random.Random(1)
    a, left = intervals(spark, r, 150)
    b, right = intervals(spark, r, 130)
    got = Counter((x["i"], x["j"]) for x in temporal.overlapping(left, right, "k", "s", "e", days).select(F.col("left.id").alias("i"), F.col("right.id").alias("j")).collect())
    whole = lambda x: None not in x and x[2] <= x[3]
    want = Counter((x[0], y[0]) for x in a for y in b if whole(x) and whole(y) and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and len(got) > 500
    assert temporal.overlapping(left.limit(0), right, "k", "s", "e").count() == 0


def test_ordered_overlaps_and_how_often_rows_are_placed(spark):
    r = random.Random(8)
    a, left = intervals(spark, r, 120)
    found = temporal.overlapping(left, left, "k", "s", "e", 30, ordered=True)
    got = Counter((x["i"], x["j"]) for x in found.select(F.col("left.id").alias("i"), F.col("right.id").alias("j")).collect())
    whole = [x for x in a if None not in x and x[2] <= x[3]]
    assert got == Counter((x[0], y[0]) for x in whole for y in whole if x[1] == y[1] and x[2] <= y[2] <= x[3])
    # rows of up to 40 days fill two buckets of 90 days at most, once where they start; no level is used that none needs
    short = temporal._timed(spark.createDataFrame([(i, "a", at(i), at(i + i % 40)) for i in range(200)], "id long, k string, s timestamp, e timestamp"), "k", "s", "e", 90)
    most = temporal._highest(short)
    assert most == 0 and temporal._placed(short, "b", most, 90, False).count() == 200
    assert 200 <= temporal._placed(short, "a", most, 90, True).count() < 300


def test_row_before_in_two_levels(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot", "hot", "a", None]), at(r.choice([None, r.randrange(300), 7])), r.choice([None, 1.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp, v double")
    got = {x["id"]: x["previous"] and x["previous"]["id"] for x in temporal.previous(df, "k", "t", "id", 9).collect()}
    last, want = {}, {}
    for row in sorted(rows, key=lambda x: (x[2] or datetime.min, x[0])):
        want[row[0]] = last.get(row[1])
        last[row[1]] = row[0]
    assert got == want


@pytest.mark.parametrize("days", [0.01, 1, 1000])
def test_state_as_of_an_event(spark, days):
    r = random.Random(3)
    time = lambda: at(r.choice([None, r.uniform(0, 30), float(r.randrange(8))]))
    states = [(r.choice(["hot", "a", None]), time(), i if i % 9 else None, f"s{i}") for i in range(120)]
    events = [(r.choice(["hot", "a", "none", None]), time(), i, i * 0.5) for i in range(200)] * 2
    s = spark.createDataFrame(states, "k string, t timestamp, no long, status string")
    e = spark.createDataFrame(events, "k string, t timestamp, id long, status double")
    got = Counter((x["id"], x["state"] and (x["state"]["t"], x["state"]["no"])) for x in temporal.as_of(e, s, "k", "t", "no", days).collect())
    want = Counter()
    for k, t, i, _ in events:
        before = [x for x in states if t and x[1] and x[0] == k and k is not None and x[1] <= t]
        best = max(before, key=lambda x: (x[1], -1 if x[2] is None else x[2]), default=None)
        want[i, best and (best[1], best[2])] += 1
    assert got == want
    assert temporal.as_of(e, s.limit(0), "k", "t", "no").where("state is not null").count() == 0 and temporal.as_of(e.limit(0), s, "k", "t", "no").count() == 0


def test_alert_rules(spark):
    deeds = spark.createDataFrame(
        [("112/A", 1, "Sunita", 2.5, 10.0, at(0), at(2000)), ("112/A", 2, "Rajesh", 2.5, 11.0, at(1500), at(1600)), ("112/A", 3, "Sunita", 2.5, 12.0, at(1550), at(1560)),
         ("88/1", 4, "Patil", 4.95, 9.0, at(3), at(4)), ("220/4", 5, "Anil", 1.2, 4.0, at(9), at(9)), ("220/4", 6, "Deepak", 1.2, 10.0, at(27), at(30)),
         ("220/4", 7, None, 1.2, 99.0, at(57), at(58)), (None, 8, "x", 9.0, 1.0, at(1), at(2)), ("220/4", 9, "Anil", None, 9.0, None, None)],
        "parcel string, deed long, claimant string, area double, price double, date timestamp, until timestamp")
    cadastre = spark.createDataFrame([("88/1", 4.1), ("112/A", 2.5), ("112/A", 2.0), (None, 1.0), ("220/4", None)], "parcel string, area double")
    got = {tuple(x) for x in alerts.alerts(deeds, cadastre, surge=0.5).withColumn("measure", F.round("measure", 3)).collect()}
    assert got == {
        ("parallel_deeds", "CRITICAL", "112/A", 1, 2, 1500.0), ("parallel_deeds", "CRITICAL", "112/A", 2, 3, 50.0),
        ("area_excess", "HIGH", "88/1", None, 4, 0.85), ("rapid_resale", "MEDIUM", "220/4", 5, 6, 2.5),
    }


def test_sketches_of_spans_keep_their_error(spark):
    n = 200_000
    rows = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("v"), (F.col("id") % 50_000).alias("who"), F.timestamp_seconds(F.col("id") * 7).alias("t"), F.lit("k").alias("k"))
    hours = sketches.hourly_sketches(rows, "t", "v", "who", ["k"])
    (whole,) = sketches.merge_hours(hours, ["k"]).collect()
    values = sorted(x[0] for x in rows.select("v").collect())
    for name, share in sketches.QUANTILES.items():
        rank = sum(v <= whole[name] for v in values) / n
        assert abs(rank - share) < 0.004, (name, rank)
    assert abs(whole["people"] / 50_000 - 1) < 0.02 and whole["n"] == n
    nothing = spark.createDataFrame([(None, None, None, "k"), (DAY, None, None, "k")], "t timestamp, v double, who long, k string")
    (none,) = sketches.merge_hours(sketches.hourly_sketches(nothing, "t", "v", "who", ["k"]), ["k"]).collect()
    assert (none["n"], none["p50"], none["mean"], none["people"]) == (1, None, None, 0)


def test_quantiles_and_people_of_spans_beyond_the_sketches(spark):
    n = 60_000  # of one day and key, fifteen times what a sketch holds exactly
    rows = spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 100.0).alias("v"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40_000)).alias("who"), F.timestamp_seconds(F.col("id") % 86_400).alias("t"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise("k").alias("k"),
    ).unionByName(spark.createDataFrame([(None, None, DAY, "none"), (3.5, None, None, "k")], "v double, who long, t timestamp, k string"))
    hours = sketches.hourly_sketches(rows, "t", "v", "who", ["k"])
    got = {x["k"]: x for x in sketches.exact_hours(hours, rows, "t", "v", "who", ["k"], F.date_trunc("day", "hour")).collect()}
    all_rows = [x for x in rows.collect() if x["t"] is not None]
    assert set(got) == {"k", None, "none"}
    for k, x in got.items():
        own = [y for y in all_rows if y["k"] == k]
        values = sorted(y["v"] for y in own if y["v"] is not None)
        want = [values[-(-len(values) * q // 100) - 1] if values else None for q in (50, 95, 99)]
        assert [x["p50"], x["p95"], x["p99"]] == want and x["n"] == len(own)
        assert x["people"] == len({y["who"] for y in own} - {None})


def test_language_model_equals_plain_bayes(spark):
    r = random.Random(4)
    alphabets = {"x": "abcd ", "y": "cdef ", "z": "aé字\U0001f600"}
    make = lambda x, n: "".join(r.choice(alphabets[x]) for _ in range(n))
    train = [(make(x, r.randrange(40)), x) for x in "xxyyz" * 12] + [("stray", None), (None, "z"), ("", "x")]
    asked = [(i, make(r.choice("xyz"), r.randrange(25))) for i in range(60)] + [(90, None), (91, ""), (92, "AB"), (93, "ab"), (93, "ab")]
    docs = spark.createDataFrame(train, "text string, lang string")
    model = langmodel.train(docs, buckets=512)
    got = Counter((x["id"], x["language"], round(x["confidence"], 9), len(x["languages"])) for x in langmodel.identify(spark.createDataFrame(asked, "id long, text string").repartition(5), model).collect())

    def bucket(g):
        value = 0
        for c in g:
            value = (value * langmodel.MULTIPLIER + ord(c)) % (1 << 40)
        return value % 512

    def grams(t):
        t = (t or "").lower()
        return [t] if 0 < len(t) < 3 else [t[i : i + 3] for i in range(len(t) - 2)]

    counts, docs_of = defaultdict(Counter), Counter(x for _, x in train if x)
    for t, x in train:
        counts[x].update(map(bucket, grams(t)))
    want = Counter()
    for i, t in asked:
        score = {x: math.log(docs_of[x] / sum(docs_of.values())) + sum(math.log((counts[x][b] + 0.5) / (counts[x].total() + 0.5 * 512)) for b in map(bucket, grams(t))) for x in docs_of}
        best = max(sorted(score), key=score.get)
        want[i, best, round(1 / sum(math.exp(s - score[best]) for s in score.values()), 9), 3] += 1
    assert got == want
    none = langmodel.train(docs.limit(0))
    assert langmodel.identify(docs, none).where("language is not null").count() == 0


def test_texts_shorter_than_a_gram(spark, tmp_path):
    from parchment.plans import model_plans

    spark.createDataFrame([(1, "A.", "en"), (2, "abc", "en"), (3, None, "de"), (4, "xyzw", "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = model_plans.lid_ngram_counts(spark, str(tmp_path)).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert {x["lang"]: x["n"] for x in counts} == {"en": 1, "de": 2}
    got = {x["doc_id"]: x["confidence"] for x in model_plans.lid_fasttext(spark, str(tmp_path)).collect()}
    assert got[1] == got[3] == 0.5 and min(got[2], got[4]) > 0.5


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = langmodel.train(docs.where("not held"))
    right = langmodel.identify(docs.where("held"), model).agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    print(f"held-out share right: {right[0]:.4f} of {right[1]}")
    assert right[0] > 0.97


def viterbi(words, options, follow):
    """All sequences, by enumeration."""
    best = [((0.0, ()), "")]
    ways = [[]]
    for w in words:
        ways = [x + [o] for x in ways for o in options.get(w, [(w, 0.0)])]
    score = lambda way: sum(c for _, c in way) + sum(follow(a, b) for a, b in zip(["", *[w for w, _ in way]], [*[w for w, _ in way], ""]))
    best = max(ways, key=score)
    return [w for w, _ in best], score(best)


def test_channel_equals_enumeration(spark):
    r = random.Random(5)
    chain = {"the": ["cart", "card", "village"], "cart": ["was", "goes"], "card": ["game", "was"], "village": ["hall", "card"], "was": ["lost", "the"], "goes": ["the"], "game": ["was"], "hall": ["was"], "lost": ["the", "card"]}
    corpus = []
    for _ in range(150):
        w, out = "the", []
        for _ in range(r.randrange(2, 7)):
            out.append(w)
            w = r.choice(chain[w])
        corpus.append((" ".join(out), "en"))
    counts = channel.count_corpus(spark.createDataFrame(corpus + [(None, "en"), ("card", None), ("  ", "en")], "text string, lang string"))
    spoil = lambda w: w if r.random() < 0.5 else w[:1] + w[2:] if r.random() < 0.5 else w[:-1] + "x"
    asked = [(i, " ".join(spoil(w) for w in r.choice(corpus)[0].split()), "en") for i in range(40)]
    asked += [(50, None, "en"), (51, "", "en"), (52, "cerd", "xx"), (None, "the  cars, was", "en"), (None, "the  cars, was", "en"), (53, "(carg) game!", "en")]
    got = Counter(map(tuple, channel.correct_in_context(spark.createDataFrame(asked, "id long, text string, lang string").repartition(3), counts, "id").collect()))

    words, pairs = Counter(), Counter()
    for t, _ in corpus:
        ws = t.split()
        pairs.update(zip(["", *ws], [*ws, ""]))
        words.update([*ws, ""])
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    total, kinds = words.total(), len(words)

    def follow(a, b):
        alone = (words[b] + 0.1) / (total + 0.1 * (kinds + 1))
        return math.log((pairs[a, b] + channel.BACK_OFF * alone) / (before[a] + channel.BACK_OFF))

    want, changed = Counter(), 0
    for i, text, lang in asked:
        ws = (text or "").split()
        bares = ["".join(c for c in w if c.isalnum()) for w in ws]
        options = {}
        for w in set(bares):
            near = [(e, distance(w, e)) for e in words if e and e != w and words[e] >= 2 and distance(w, e) / max(len(w), len(e)) < 0.3]
            if near:
                options[w] = [(w, 0.0)] + [(e, -channel.EDIT_COST * d) for e, d in near]
        chosen = viterbi(bares, options, follow)[0] if lang == "en" else bares
        new = [w.replace(b, c) if b != c else w for w, b, c in zip(ws, bares, chosen)]
        changed += new != ws
        want[i, " ".join(new)] += 1
    assert got == want and changed > 10


def test_context_corrects_what_the_nearest_entry_gets_wrong(spark):
    corpus = spark.createDataFrame([("village hall was built", "en"), ("sale deed was signed", "en"), ("sale deed was lost", "en"), ("village hall was sold", "en")] * 5 + [("hill road", "en"), ("seed store", "en")] * 4, "text string, lang string")
    rows = spark.createDataFrame([(1, "village hell was sold", "en"), (2, "sale teed was signed", "en")], "id long, text string, lang string")
    vocabulary = correction.vocabulary_frame(spark, {"en": ["hill", "hall", "seed", "deed", "sale"]})
    nearest = {x["id"]: x["corrected"] for x in correction.correct_vocabulary(rows, vocabulary, "id").collect()}
    counts = channel.count_corpus(corpus)
    context = {x["id"]: x["corrected"] for x in channel.correct_in_context(rows, counts, "id").collect()}
    assert nearest == {1: "village hill was sold", 2: "sale seed was signed"}
    assert context == {1: "village hall was sold", 2: "sale deed was signed"}
    all_stages = {x["id"]: x["corrected"] for x in channel.correct_fully(rows, correction.vocabulary_frame(spark, {"en": ["signed"]}), counts, "id").collect()}
    assert all_stages == context
