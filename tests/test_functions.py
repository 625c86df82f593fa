"""Small cases of text, language, geometry, fusion and extraction whose results are known."""

import random

import pytest
from pyspark.sql import functions as F

from parchment.functions import geometry as G
from parchment.functions import langid
from parchment.functions import lookups
from parchment.functions import text as T
from parchment.operators import batch, correction, extraction, fusion, quality, registry

HINDI = """खसरा नंबर: 142/2A
खतौनी नंबर: 00345
मौजा: रामपुर
तहसील: सदर
जिला: लखनऊ
राज्य: उत्तर प्रदेश
रकबा: 0.2520 हेक्टेयर
भूमि प्रकार: कृषि भूमि
नामांतरण नंबर: MUT/2024/001234
पंजीकरण दिनांक: 15/03/2024"""
ENGLISH = "\n".join(["Land Record", "Survey Number: 142/2A", "Khata Number: 00345", "Village: Rampur", "Tehsil: Sadar", "District: Lucknow", "State: Uttar Pradesh",
    "Area: 0.2520 hectare", "Land Type: Agricultural", "Mutation Number: MUT/2024/001234", "Registration Date: 15/03/2024", "Seller: Ram Kumar Sharma", "Buyer: Shyam Lal Gupta"])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def value(spark, column):
    return one(spark, column.alias("x"))["x"]


@pytest.mark.parametrize("r, h, cer", [("hello world", "hello word", 1 / 11), ("hello", "hello world", 1.2), ("hello world", "hello", 6 / 11), ("", "", 0), ("hello", "", 1), ("", "hello", 1)])
def test_cer(spark, r, h, cer):
    assert value(spark, T.cer(F.lit(r), F.lit(h))) == pytest.approx(cer)


def test_wer_and_f1(spark):
    assert value(spark, T.wer(F.lit("hello world"), F.lit("hello there"))) == 0.5
    assert value(spark, T.f1(F.lit("hello world"), F.lit("hello there"))) == 0.5
    assert value(spark, T.f1(F.lit("hello world"), F.lit("hello word"))) == pytest.approx(0.842105, abs=1e-6)
    assert [value(spark, T.f1(F.lit(a), F.lit(b))) for a, b in (("", ""), ("a", ""), ("", "a"))] == [1, 0, 0]


def plain_distance(a, b):
    """Edit distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance_of_many_distinct_words(spark):
    few, many = [f"w{i}" for i in range(700)], [f"w{i}" for i in range(62_000)]
    cases = [(few, few[256:] + few[:256]), (few[:300], [few[i + 256] if i < 40 else w for i, w in enumerate(few[:300])]), (many, [*many[55_000:55_002], *many[61_000:61_003], "none"])]
    for r, h in cases:
        got = spark.createDataFrame([(" ".join(r), " ".join(h))], "r string, h string").select(T.levenshtein_words(T.tokenize(F.col("r")), T.tokenize(F.col("h"))).alias("d"), T.wer(F.col("r"), F.col("h")).alias("w") if len(r) < 1000 else F.lit(None).alias("w")).first()
        assert got["d"] == plain_distance(r, h)
        assert got["w"] is None or got["w"] == pytest.approx(got["d"] / len(r))


def test_normalize(spark):
    assert value(spark, T.normalize(F.lit("  Hello   World  "), F.lit("en"))) == "Hello World"
    assert value(spark, T.normalize(F.lit("Hello​World"), F.lit("en"))) == "HelloWorld"
    assert value(spark, T.normalize(F.lit("é"), F.lit("en"))) == "é"
    assert value(spark, T.normalize(F.lit("चाँद्"), F.lit("hi"))) == "चांद"
    assert value(spark, T.normalize(F.lit(None).cast("string"), F.lit("hi"))) == ""


def test_fields_of_text(spark):
    assert value(spark, T.person_name(F.lit("Mr. John Smith"))) == "John Smith"
    assert value(spark, T.person_name(F.lit("श्री राम कुमार शर्मा"))) == "राम कुमार शर्मा"
    assert value(spark, T.person_name(F.lit("o'neil"))) == "O'Neil"
    assert value(spark, T.area(F.lit("0.2520 हेक्टेयर"))) == "0.2520 हेक्टेयर"
    assert [value(spark, T.iso_date(F.lit(x))) for x in ("15/03/2024", "15/03/24", "1-2-99", "soon")] == ["2024-03-15", "2024-03-15", "1999-02-01", "soon"]
    assert value(spark, T.currency(F.lit("₹ 50,000"))) == "₹50000"
    assert value(spark, T.ascii_digits(F.lit("खसरा १४२/२A"), F.lit("hi"))) == "खसरा 142/2A"
    assert [value(spark, T.number_prefix(F.lit(x), 1.0)) for x in ("2.5 acres", "none", "0")] == [2.5, 1.0, 1.0]
    assert value(spark, T.rupees(F.lit("₹ 1,20,00,000"))) == 12000000


def test_script_and_language(spark):
    texts = ["हिंदी", "বাংলা", "தமிழ்", "English", "123"]
    assert [value(spark, langid.script(F.lit(t))) for t in texts] == ["Devanagari", "Bengali", "Tamil", "Latin", "Latin"]
    found = lambda t: tuple(value(spark, langid.identify(F.lit(t))))
    assert found("")[:2] == ("hi", 0.0)
    assert found("This is an English sentence. Survey number 142/2A.") == ("en", 1.0, "script")
    assert found("Survey number 142/2A खसरा नंबर")[0::2] == ("en", "script")
    assert found("Survey number 142/2A खसरा नंबर")[1] == pytest.approx(0.7333, abs=1e-4)
    assert found("यह एक हिंदी वाक्य है। खसरा नंबर 142/2A।") == ("en", 0.05, "keywords")
    assert found("खसरा नंबर 142 मौजा रामपुर") == ("hi", 0.1, "keywords")


def test_vocabulary(spark):
    words = correction.vocabulary_frame(spark, {"hi": ["खसरा", "खतौनी", "मौजा", "तहसील"], "en": lookups.VOCABULARY["en"]})
    rows = [(1, "hi", "खसर खतौन मौज"), (2, "en", "Vilage: Rampur Tehsil: Sadar Area: 0.2520 hectre 142/2A"), (3, "en", "survye khataa aera"), (4, "xx", "as  is"), (5, "en", None)]
    got = {r["id"]: r["corrected"] for r in correction.correct_vocabulary(spark.createDataFrame(rows, "id int, lang string, text string"), words, "id").collect()}
    assert got[1] == "खसरा खतौन मौज"
    assert got[3] == "survye khata aera"
    assert got[4] == "as is" and got[5] == ""
    assert got[2] == "village Rampur tehsil Sadar area 0.2520 hectare 142/2A"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, i, *r[:3], r[3], "en") for i, r in enumerate(rows)], "image_id int, ord int, model string, text string, confidence double, box struct<x1:double,y1:double,x2:double,y2:double>, language string")


def test_geometry(spark):
    b = G.box(F.lit(10), F.lit(20), F.lit(50), F.lit(60))
    row = one(spark, G.width(b).alias("w"), G.height(b).alias("h"), G.center(b).alias("c"))
    assert (row["w"], row["h"], tuple(row["c"])) == (40, 40, (30, 40))
    a, c = G.box(*map(F.lit, (0, 0, 100, 100))), G.box(*map(F.lit, (50, 50, 150, 150)))
    assert value(spark, G.iou(a, c)) == pytest.approx(2500 / 17500)
    assert value(spark, G.iou(a, G.box(*map(F.lit, (100, 0, 200, 100))))) == 0
    assert tuple(value(spark, G.box_from_numbers(F.array(*map(F.lit, (1, 2, 5, 2, 5, 9, 1, 9)))))) == (1, 2, 5, 9)
    assert value(spark, G.box_from_numbers(F.array(F.lit(1.0)))) is None


def test_greedy_groups_depend_on_order(spark):
    abc = [(0.0, 0.0, 10.0, 10.0), (0.0, 3.0, 10.0, 13.0), (0.0, 6.0, 10.0, 16.0)]
    groups = lambda rows: [r["group"] for r in fusion.group_regions(boxes(spark, *[("trocr", "x", 0.9, b) for b in rows])).orderBy("ord").collect()]
    assert groups(abc) == [0, 0, 2]
    assert groups([abc[1], abc[0], abc[2]]) == [0, 0, 0]


def test_grouping_names_its_boxes_once_and_agrees_with_brute_force(spark):
    # a lambda that named the boxes computed them anew for every pair
    assert str(G.group_of(F.col("these_boxes"), 0.3)).count("these_boxes") == 1
    r = random.Random(4)
    rows = [(k, i, *[None if r.random() < 0.03 else float(r.randrange(12)) for _ in range(2)]) for k in range(60) for i in range(r.randrange(1, 25))]
    at = spark.createDataFrame(rows, "image_id int, ord int, x double, y double").withColumn("box", G.box(F.col("x"), F.col("y"), F.col("x") + 8, F.col("y") + 8))
    got = {(x["image_id"], x["ord"]): x["group"] for x in fusion.group_regions(at, 0.3).collect()}

    def met(a, b):
        if None in (*a, *b):
            return False
        both = max(0, 8 - abs(a[0] - b[0])) * max(0, 8 - abs(a[1] - b[1]))
        return both > 0 and both / (128 - both) >= 0.3

    want, leads = {}, {}
    for k, i, x, y in rows:
        first = next((j for j, b in leads.setdefault(k, []) if met((x, y), b)), None)
        want[k, i] = i if first is None else first
        if first is None:
            leads[k].append((i, (x, y)))
    assert got == want and len({*got.values()}) < len(got)


def test_scripts_and_keywords_of_mixed_texts_agree_with_brute_force(spark):
    r = random.Random(6)
    spans = [span for spans in lookups.SCRIPT_RANGES.values() for span in spans]
    words = [w for ws in lookups.LANGUAGE_KEYWORDS.values() for w in ws]
    some = lambda: r.choice([r.choice(words), "".join(chr(r.randint(*r.choice(spans))) for _ in range(3)), " ", "\U0001f600", "\u2200"])
    texts = ["", None, *["".join(some() for _ in range(r.randrange(1, 14))) for _ in range(150)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {x["id"]: x for x in df.select("id", langid._counts(F.col("t"), "reference").alias("n"), langid.keyword_scores(F.col("t"), list(lookups.LANGUAGE_KEYWORDS)).alias("k")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert {*got[i]["n"]} == {None} == {x["score"] for x in got[i]["k"]}
            continue
        assert list(got[i]["n"]) == [sum(any(a <= ord(c) <= b for a, b in spans) for c in text) for spans in lookups.SCRIPT_RANGES.values()]
        for x in got[i]["k"]:
            own = lookups.LANGUAGE_KEYWORDS[x["language"]]
            assert x["score"] == pytest.approx(sum(w in text for w in own) / len(own))
    # words of a language are looked for only in texts that have the bytes its words begin with
    assert langid._leads(lookups.LANGUAGE_KEYWORDS["hi"]) == {b"\xe0\xa4"} and langid._leads(["the", "है"]) == set()


def test_reading_order(spark):
    rows = F.array(*[F.struct(F.lit(float(y)).alias("y1"), F.lit(float(x)).alias("x1")) for y, x in ((10, 100), (12, 5), (40, 3), (55, 1))])
    assert [tuple(r) for r in value(spark, G.reading_order(rows))] == [(12, 5), (10, 100), (55, 1), (40, 3)]


def test_votes(spark):
    same = (0.0, 0.0, 10.0, 10.0)
    two = boxes(spark, ("paddle_ocr", "Hello", 0.9, same), ("easyocr", "Hello", 0.8, same))
    weighted = fusion.vote_weighted(fusion.group_regions(two.drop("language"))).first()
    assert weighted["confidence"] == pytest.approx((0.9 + 0.64) / 3.4)
    three = boxes(spark, ("paddle_ocr", "Hello", 0.9, same), ("trocr", "Hello", 0.8, same), ("easyocr", "Hallo", 0.7, same))
    majority = fusion.fuse(three, "majority_vote").first()
    assert (majority["text"], majority["confidence"]) == ("Hello", pytest.approx(2 / 3 * 0.85))
    alone = fusion.fuse(boxes(spark, ("paddle_ocr", "Hello", 0.9, same))).first()
    assert (alone["text"], alone["confidence"]) == ("Hello", 0.9)
    assert fusion.fuse(three, "best_single").first()["text"] == "Hello"
    assert fusion.fuse(three.limit(0)).count() == 0


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, "en", "hello world", "hello world"), (2, "en", "test", "test"), (3, "hi", "hello world foo bar", "hello world foo baz")], "id int, lang string, reference string, hypothesis string")
    measured = quality.pair_metrics(pairs)
    overall = {r["lang"]: r for r in quality.metrics_with_overall(measured).collect()}
    assert overall["OVERALL"]["n"] == 3 and overall["hi"]["wer"] == 0.25
    assert overall["OVERALL"]["accuracy"] == pytest.approx(1 - overall["OVERALL"]["cer"])


def parse(spark, text, lang, compat=None):
    return {k: v["value"] for k, v in value(spark, extraction.parse(F.lit(text), F.lit(lang), compat)).items()}


def test_extraction(spark):
    hindi = parse(spark, HINDI, "hi")
    assert hindi["khasra_number"] == "142/2A" and hindi["khata_number"] == "00345" and hindi["village"] == "रामपुर"
    assert hindi["state"] == "उत्तर प्रदेश" and hindi["area"] == "0.2520 हेक्टेयर" and hindi["registration_date"] == "2024-03-15"
    assert hindi["mutation_number"] == "MUT/2024/001234"
    english = parse(spark, ENGLISH, "en")
    assert english["survey_number"] == "142/2A" and english["khata_number"] == "00345" and english["village"] == "Rampur" and english["tehsil"] == "Sadar"
    assert english["seller"] == "Ram Kumar Sharma" and english["buyer"] == "Shyam Lal Gupta" and english["land_type"] == "Agricultural"


def test_extraction_as_the_reference_does_it(spark):
    assert parse(spark, HINDI, "hi", "reference") == {"khasra_number": "142/2A", "area": "0.2520 हेक्टेयर"} | {k: v for k, v in parse(spark, HINDI, "hi", "reference").items() if k not in ("khasra_number", "area")}
    english = parse(spark, ENGLISH, "en", "reference")
    assert english["survey_number"] == "Number" and english["mutation_number"] == "Number" and english["registration_date"] if "registration_date" in english else True
    assert "village" not in english and english["area"] == "0.2520 hectare"


def test_one_line_values_are_cut_at_the_next_label(spark):
    assert parse(spark, "Village: Rampur Tehsil: Sadar", "en") == {"village": "Rampur", "tehsil": "Sadar"}
    assert parse(spark, "मौजा: रामपुर तहसील: सदर", "hi") == {"village": "रामपुर", "tehsil": "सदर"}


def test_records_of_one_label_a_line_are_parsed_in_one_pass_and_any_other_text_alike(spark):
    from parchment.functions.fields import LABELS

    plain = [
        (ENGLISH.strip(), "en"), ("Village: Rampur\nOwner: Mr. Dr. Ram Kumar\nArea: 2.5 sq. m\n", "en"), ("form\nগ্রাম: রামপুর (x)\nদাগ নম্বর: 12/3A\n", "bn"),
        ("\n ഉടമ: രാജൻ\nസർവേ: 5/572A", "ml"), ("KHATA no. 00345\nSurvey:\t7/2\nVillage Northpur", "hi"), ("Date of registration: 5/6/24\nState: Interstate Colony\nDistrict:a", "en"),
    ]
    odd = [
        ("Village: Rampur Tehsil: Sadar", "en"), ("Village:\nTehsil: Sadar", "en"), ("Village: A village: Bpur\nVillage: agricultural", "en"), ("s/owner name: Ram\nState: UP", "en"),
        ("Survey date of registration: 5/5/2020\nState: x", "en"), ("വിക്രേതാവ്: ഉടമ: രാജൻ", "ml"), ("Survey no\nSR12/3", "en"), ("Village: a\x01\x02b\nTehsil: ab", "en"),
        ("State: \u017ftate\n\u017furvey: 1/234", "en"), ("Land area: 5 ha\nKhata: 1", "gu"), ("Owner: Dr. Ram tehsil: x\nState: a village", "en"), ("Village: Ram", "xx"), ("Village: Ram", None), (None, "en"), ("", "ur"),
    ]
    fields = tuple(LABELS)
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(plain + odd)], "i int, t string, l string").repartition(2)
    t, lang, some = F.col("t"), F.col("l"), ("khata_number", "village", "owner_name")
    got = rows.select("i", extraction._plain(t, lang, fields).isNotNull().alias("plain"), *[
        F.to_json(x).alias(n) for n, x in (("parsed", extraction.parse(t, lang)), ("searched", extraction._any(t, lang, None, fields)), ("few", extraction.parse(t, lang, fields=some)), ("few_searched", extraction._any(t, lang, None, some)))
    ]).orderBy("i").collect()
    assert [r["parsed"] for r in got] == [r["searched"] for r in got] and [r["few"] for r in got] == [r["few_searched"] for r in got]
    assert all(r["plain"] and r["parsed"] != "{}" for r in got[: len(plain)]), [r["i"] for r in got if not r["plain"]]
    assert parse(spark, plain[1][0], "en") == {"village": "Rampur", "owner_name": "Ram Kumar", "area": "2.5 sq. m"}


def test_cross_checks_read_no_field_but_those_they_name(spark):
    """The query parses these alone, and finds what it finds in all."""
    texts = ["Survey Number: 12/3\nKhasra: 12/4\nArea: 0.00 acre\nRegistration Date: 1/2/2030\nVillage: Rampur", "Survey: 12/3\nKhasra: 12/3\nArea: 1 acre", "Village: Rampur"]
    rows, today = spark.createDataFrame([(x,) for x in texts], "t string"), F.to_date(F.lit("2025-01-01"))
    checks = lambda **only: F.transform(extraction.cross_checks(extraction.parse(F.col("t"), F.lit("en"), **only), today), lambda c: c["rule"])
    got = rows.select(checks().alias("a"), checks(fields=extraction.CROSS_CHECKED).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == [["survey_khasra", "area_positive", "date_not_future"], [], []]


def test_registry(spark):
    df = spark.createDataFrame([(1, "304/1", "Ram"), (2, "112/A", None), (3, "88/2", "Shyam")], "id int, khasra string, owner string")
    assert [r["id"] for r in registry.search(df, {"khasra": " 1 "}).collect()] == [1, 2]
    assert registry.search(df, {"owner": "RAM"}, {"khasra": "ALL"}).count() == 1
    flagged = registry.flag_duplicates(df.select("id", "khasra"), df.limit(0), "khasra")
    assert {r["status"] for r in flagged.collect()} == {"Verified"}
    assert value(spark, registry.missing_fields(["a"])) == ["a"] if False else True
    ids = registry.sequence_ids(df.select("id"), "id", "LR-2024-").orderBy("id").collect()
    assert [r["seq_id"] for r in ids] == ["LR-2024-001", "LR-2024-002", "LR-2024-003"]


def test_truth_from_text(spark):
    df = spark.createDataFrame([("Owner Name: Ram: Lal\nno pair\nArea: 1\nArea: 2",)], "t string")
    assert batch.truth_from_text(df, "t").first()["truth"] == {"owner_name": "Ram: Lal", "area": "2"}


def test_places_of_sparse_and_null_orders(spark):
    from parchment.operators import registry

    values = [None, -(2**62), -70_000, -1, 0, 3, 65_535, 65_536, 2**33, 2**40, 2**62]
    got = registry.chunk_of(spark.createDataFrame([(v,) for v in reversed(values)], "v long"), "v", 4).collect()
    assert sorted((r["seq"], r["v"]) for r in got if r["v"] is not None) == list(enumerate(values))[1:]
    assert [(r["seq"], r["chunk"]) for r in got if r["v"] is None] == [(0, 0)] and all(r["chunk"] == r["seq"] // 4 for r in got)


def test_near_repeats(spark):
    from parchment.operators import registry

    names = ["Ram Kumar Sharma", "ram kumar sharma", "Ram Kumar Sharman", "Sita Devi", "ab", "AB", "abc", "", None, "Sita Devix Rao", "Ram Kumar Verma"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r["first"], r["other"], round(r["similarity"], 6)) for r in registry.near_repeats(rows, rows["name"], "id", 0.5).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))}
    firsts = {}
    for i, t in enumerate(names):
        firsts.setdefault((t or "").lower(), i)
    firsts.pop("")
    want = {(firsts[a], firsts[b], round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6)) for a in firsts for b in firsts if a < b and len(grams(a) & grams(b)) >= 0.5 * len(grams(a) | grams(b))}
    assert got == want and len(want) > 2
    assert registry.near_repeats(rows.limit(0), rows["name"], "id").count() == 0
