"""Queries that extract and check the fields of land records, in seven languages, written from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions.fields import GROUPS, LABELS, pattern
from parchment.functions.lookups import LAND_TYPE_WORDS, VOCABULARY
from parchment.operators import extraction
from parchment.plans.common import table, tasks_for

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Languages of the records, one for each group of labels, and two records' names in each: village, tehsil, district, state, owner and seller.
LANGS = ("en", "bn", "ta", "te", "kn", "ml", "ur")
NAMES = [
    ("Rampur", "Sadar", "Lucknow", "Uttar Pradesh", "Ram Kumar", "Shyam Lal"), ("Interstate Colony", "Haveli", "Pune", "Maharashtra", "Sita Devi", "Mohan Rao"),
    ("রামপুর", "সাভার", "ঢাকা", "পশ্চিমবঙ্গ", "রহিম উদ্দিন", "করিম শেখ"), ("জমিরপুর", "মিরপুর", "খুলনা", "অসম", "সালমা বেগম", "আনোয়ার হোসেন"),
    ("திருப்பூர்", "அவினாசி", "கோயம்புத்தூர்", "தமிழ்நாடு", "முருகன் செல்வம்", "குமார் ராஜா"), ("நிலம்பூர்", "மேலூர்", "மதுரை", "கேரளம்", "லட்சுமி தேவி", "அருண் குமார்"),
    ("రామాపురం", "నందిగామ", "గుంటూరు", "ఆంధ్రప్రదేశ్", "వెంకట రావు", "రాము బాబు"), ("భూమిపురం", "తెనాలి", "వరంగల్", "తెలంగాణ", "లక్ష్మి దేవి", "రమేష్ కుమార్"),
    ("ರಾಮನಗರ", "ಹೊಸಕೋಟೆ", "ಮೈಸೂರು", "ಕರ್ನಾಟಕ", "ರಾಜು ಗೌಡ", "ಸುರೇಶ್ ಭಟ್"), ("ಭೂಮಿಪುರ", "ಸಾಗರ", "ಹಾಸನ", "ಗೋವಾ", "ಲಕ್ಷ್ಮಿ ದೇವಿ", "ಅನಿಲ್ ಕುಮಾರ್"),
    ("കോട്ടയം", "വൈക്കം", "എറണാകുളം", "കേരളം", "രാജൻ നായർ", "സുരേഷ് മേനോൻ"), ("കൃഷിപുരം", "ആലുവ", "തൃശൂർ", "തമിഴകം", "ലക്ഷ്മി ദേവി", "അനിൽ കുമാർ"),
    ("رامپور", "صدر", "لکھنؤ", "اترپردیش", "رحیم خان", "کریم شیخ"), ("زرعیآباد", "ملیر", "کراچی", "سندھ", "سلمی بیگم", "انور علی"),
]
NAMED = ("village", "tehsil", "district", "state", "owner_name", "seller")
ENGLISH_LABELS = {"survey_number": "Survey Number", "khata_number": "Khata Number", "khasra_number": "Khasra Number", "registration_date": "Registration Date"}


def group_of(lang):
    return next(g for g, languages in GROUPS.items() if lang in languages)


def records(spark, d):
    """A land record for each order, in the seven languages in turn. Every third lacks its district, every fifth has no area to
    speak of, every eleventh has no date; English and Bengali ones have a khasra number, every other of them one of its own."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    met = orders.join(table(spark, d, "customer").select("c_custkey"), F.col("c_custkey") == F.col("o_custkey")).drop("c_custkey")
    met = met.repartition(tasks_for(orders, 50_000))  # after the join, which leaves few and large tasks; to start one costs half a second, as it has many patterns
    key, at = F.col("o_orderkey"), F.col("o_orderkey") % len(LANGS)
    of = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    name = {f: of([n[i] for n in NAMES], at * 2 + F.col("o_custkey") % 2) for i, f in enumerate(NAMED)}

    def line(field, value):
        labels = [ENGLISH_LABELS.get(field, field.split("_")[0].title()) if x == "en" else LABELS[field].get(group_of(x), "").split("|")[0] for x in LANGS]
        return F.concat(of(labels, at), F.lit(": "), value, F.lit("\n"))

    some = lambda when, text: F.when(when, text).otherwise("")
    title = lambda english: some(at == 0, F.lit(english))
    survey = F.concat("o_orderkey", F.lit("/"), F.col("o_custkey"))
    khasra = F.when(key % 2 == 0, F.concat(survey, some(at == 0, F.lit("A")))).otherwise(F.concat("o_orderkey", F.lit("-"), F.col("o_custkey")))
    text = F.concat(
        line("survey_number", F.concat(survey, F.lit("A"))), line("khata_number", F.lpad(F.col("o_custkey").cast("string"), 5, "0")), some(at < 2, line("khasra_number", khasra)),
        line("village", name["village"]), line("tehsil", name["tehsil"]), some(key % 3 != 0, line("district", name["district"])), line("state", name["state"]),
        line("area", F.when(key % 5 == 0, "0.00 hectare").otherwise(F.concat(F.col("o_custkey"), F.lit(".25 hectare")))),
        some(key % 11 != 0, line("registration_date", F.date_format("o_orderdate", "dd/MM/yyyy"))),
        line("owner_name", F.concat(title("Shri "), name["owner_name"])), line("seller", F.concat(title("Mr. "), name["seller"])),
    )
    return met.select("o_orderkey", "o_custkey", "o_orderdate", text.alias("text"), of(LANGS, at).alias("lang"))


def parsed(spark, d, compat=None, fields=tuple(LABELS)):
    return records(spark, d).select("*", extraction.parse(F.col("text"), F.col("lang"), compat, fields).alias("f"))


def value(field):
    return F.col("f")[field]["value"]


#: What is in the records. In Bengali a survey number ends before the letter.
_NAMES = ", ".join(f"({i}, '{LANGS[i // 2]}', {', '.join(repr(x) for x in n)})" for i, n in enumerate(NAMES))
_FROM = f"""from (select o_orderkey, o_custkey, o_orderdate, lang, o_orderkey || '/' || o_custkey || case lang when 'bn' then '' else 'A' end as survey, lpad(cast(o_custkey as varchar), 5, '0') as khata,
case when lang in ('en', 'bn') then case when o_orderkey % 2 = 0 then o_orderkey || '/' || o_custkey || case lang when 'bn' then '' else 'A' end else o_orderkey || '-' || o_custkey end end as khasra,
village, tehsil, case when o_orderkey % 3 <> 0 then district end as district, state, owner_name, seller,
case when o_orderkey % 5 = 0 then '0.00 hectare' else o_custkey || '.25 hectare' end as area, case when o_orderkey % 11 <> 0 then o_orderdate end as registered, k % 2 = 1 as rich
from orders join customer on c_custkey = o_custkey join (values {_NAMES}) n(k, lang, village, tehsil, district, state, owner_name, seller) on k = (o_orderkey % {len(LANGS)}) * 2 + o_custkey % 2) r"""


@query(f"select o_orderkey, lang, survey, khata, khasra, village, tehsil, district, state, area, strftime(registered, '%Y-%m-%d') as date, owner_name, seller {_FROM}")
def ext_parse(spark, d):
    names = {"survey_number": "survey", "khata_number": "khata", "khasra_number": "khasra", "registration_date": "date"}
    fields = ("survey_number", "khata_number", "khasra_number", "village", "tehsil", "district", "state", "area", "registration_date", "owner_name", "seller")
    return parsed(spark, d, fields=fields).select("o_orderkey", "lang", *[value(f).alias(names.get(f, f)) for f in fields])


@query(f"""select o_orderkey, case lang when 'en' then 'Number' else survey end as survey, area, case when lang <> 'te' then strftime(registered, '%d/%m/%Y') end as date, true as no_village {_FROM}""")
def ext_parse_compat(spark, d):
    """As the original rules run: of an English number they take the label's next word, and no date of Telugu records is found."""
    return parsed(spark, d, "reference").select("o_orderkey", value("survey_number").alias("survey"), value("area").alias("area"), value("registration_date").alias("date"), value("village").isNull().alias("no_village"))


#: The records have lines for these fields, and some for three more.
_HAVE = ("survey_number", "khata_number", "village", "tehsil", "state", "area", "owner_name", "seller")
_COMPILED = [(group_of(x), x, f) for x in LANGS for f in LABELS if group_of(x) in LABELS[f]]


@query(f"""select label_group, field, count(o_orderkey) filter (field in {_HAVE} or field = 'district' and district is not null or field = 'registration_date' and registered is not null or field = 'khasra_number' and khasra is not null) as n
from (values {", ".join(str(c) for c in _COMPILED)}) t(label_group, lang, field) left join (select * {_FROM}) using (lang) group by 1, 2""")
def ext_compile(spark, d):
    """In how many land records of its languages the compiled pattern of each field and group of labels is met."""
    rows = records(spark, d)
    met = {(g, f): (F.col("lang") == x) & F.col("text").rlike(pattern(f, g, None)) for g, x, f in _COMPILED}
    counted = rows.agg(*[F.count_if(m).alias(f"{g}_{f}") for (g, f), m in met.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(g).alias("label_group"), F.lit(f).alias("field"), F.col(f"{g}_{f}").alias("n")) for g, f in met])))


@query(f"""select o_orderkey, 0.95 as survey, case when khasra is not null then 0.9 end as khasra, case when rich then 0.9 else 0.8 end as village, case when registered is not null then 1.0 end as date,
round((2 * 0.95 + case when rich then 0.9 else 0.8 end + 2 * 0.8 + 1.0 + 0.85 + 0.7 + if(khasra is null, 0, 0.9) + if(district is null, 0, 0.8) + if(registered is null, 0, 1.0))::double
/ (8 + if(khasra is null, 0, 1) + if(district is null, 0, 1) + if(registered is null, 0, 1)), 6) as record {_FROM}""")
def ext_confidence(spark, d):
    """Every other village has a word of its language's vocabulary in its name, which makes it surer."""
    sure = lambda f: F.round(F.col("f")[f]["confidence"], 6)
    return parsed(spark, d).select(
        "o_orderkey", sure("survey_number").alias("survey"), sure("khasra_number").alias("khasra"), sure("village").alias("village"), sure("registration_date").alias("date"),
        F.round(extraction.record_confidence(F.col("f")), 6).alias("record"),
    )


@query("select c_custkey, c_custkey >= 100 and c_custkey <= 999999 as khata_ok, length(c_name) between 3 and 100 as name_ok from customer")
def ext_validate(spark, d):
    return table(spark, d, "customer").select("c_custkey", extraction.valid(F.col("c_custkey").cast("string"), "khata_number").alias("khata_ok"), extraction.valid(F.col("c_name"), "owner_name").alias("name_ok"))


@query("select c_custkey, c_name as name, c_custkey || ' acre' as area, '2024-03-15' as date, '₹' || c_custkey as duty from customer")
def ext_postprocess(spark, d):
    n = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", extraction.finish(F.concat(F.lit("Smt. "), F.col("c_name")), "owner_name").alias("name"), extraction.finish(F.concat(n, F.lit("  acre")), "area").alias("area"),
        extraction.finish(F.lit("15/3/24"), "registration_date").alias("date"), extraction.finish(F.concat(F.lit("Rs "), n), "stamp_duty").alias("duty"),
    )


@query(f"select o_orderkey, case when district is null then 'district' else '' end as missing {_FROM}")
def ext_required(spark, d):
    return parsed(spark, d).select("o_orderkey", F.array_join(extraction.missing_required(F.col("f")), ",").alias("missing"))


@query(f"""select o_orderkey, array_to_string(list_filter([case when khasra <> survey then 'survey_khasra' end, case when area like '0.00 %' then 'area_positive' end,
case when date_trunc('day', registered) > timestamp '1996-01-01' then 'date_not_future' end], lambda x: x is not null), ',') as violations {_FROM}""")
def ext_cross(spark, d):
    checks = extraction.cross_checks(F.col("f"), F.to_date(F.lit("1996-01-01")))
    return parsed(spark, d, fields=extraction.CROSS_CHECKED).select("o_orderkey", F.array_join(F.transform(checks, lambda c: c["rule"]), ",").alias("violations"))


_LAND = [(x, w) for x, ws in LAND_TYPE_WORDS.items() for w in ws]


@query(f"""with w as (select * from (values {", ".join(f"({i}, '{x}', '{w}')" for i, (x, w) in enumerate(_LAND))}) t(i, lang, word)), o as (select o_orderkey, o_orderkey % {len(_LAND) + 9} as i from orders)
select o_orderkey, (select string_agg(v.word, '|' order by v.i) from w v where v.lang = coalesce(w.lang, 'en') and contains(coalesce(lower(w.word), ''), v.word)) as types from o left join w using (i)""")
def ext_land_type_kw(spark, d):
    """The types of land that a record in any language names; some records name none."""
    k = F.col("o_orderkey") % (len(_LAND) + 9)
    of = lambda n: F.get(F.array(*[F.lit(x[n]) for x in _LAND]), k)
    rows = table(spark, d, "orders").select("o_orderkey", F.coalesce(of(0), F.lit("en")).alias("lang"), F.concat(F.lit("1. "), F.coalesce(of(1), F.lit("-")), F.lit(".")).alias("text"))
    return rows.select("o_orderkey", F.nullif(F.array_join(extraction.land_types(F.col("text"), F.col("lang")), "|"), F.lit("")).alias("types"))


_WORDS_EN = VOCABULARY["en"]


@query(f"select i::int as place, w as entry, count(o_orderkey) as n from (values {", ".join(f"({i}, '{w}')" for i, w in enumerate(_WORDS_EN))}) t(i, w) left join orders on o_orderkey % {2 * len(_WORDS_EN)} = i group by 1, 2")
def ext_vocabulary(spark, d):
    """How often the words of the vocabulary occur in texts of which half have none."""
    words = F.array(*[F.lit(w) for w in _WORDS_EN])
    said = table(spark, d, "orders").select(F.explode(F.split(F.concat_ws(" ", F.lit("the"), F.get(words, F.col("o_orderkey") % (2 * len(_WORDS_EN)))), " ")).alias("entry"))
    entries = spark.createDataFrame(list(enumerate(_WORDS_EN)), "place int, entry string")
    return entries.join(said.groupBy("entry").agg(F.count(F.lit(1)).alias("n")), "entry", "left").fillna(0, ["n"]).select("place", "entry", "n")
