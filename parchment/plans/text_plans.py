"""Queries on text: normalisation, edit distance, metrics, correction and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import langid, lookups
from parchment.functions import text as T
from parchment.operators import correction, quality
from parchment.plans.common import spread, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Pairs of benchmark texts: the text, and the same with some words changed and one letter more, or nothing.
_PAIRS = """p as (select item_id as id, case item_id % 3 when 0 then 'en' when 1 then 'hi' else 'bn' end as lang, text as reference,
  case when item_id % 5 = 0 then '' else replace(replace(text, 'the', 'thee'), 'on', 'o') || 'x' end as hypothesis from benchmark)"""
_SYMBOLS = "array_to_string(list_transform({x}, lambda s: chr(list_position({v}, s)::int)), '')"


def _distance(a: str, b: str) -> str:
    v = f"list_distinct(list_concat({a}, {b}))"
    return f"levenshtein({_SYMBOLS.format(x=a, v=v)}, {_SYMBOLS.format(x=b, v=v)})"


_CHARS = "list_filter(string_split({0}, ''), lambda s: s <> '')"
_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda s: s <> '')"
_N = "n as (select id, lang, trim(regexp_replace(reference, '\\s+', ' ', 'g')) as r, trim(regexp_replace(hypothesis, '\\s+', ' ', 'g')) as h from p)"
_CER = f"case when r = '' then case when h = '' then 0.0 else 1.0 end else {_distance(_CHARS.format('r'), _CHARS.format('h'))} / length(r) end"
_WER = f"case when r = '' then case when h = '' then 0.0 else 1.0 end else {_distance(_WORDS.format('r'), _WORDS.format('h'))} / len({_WORDS.format('r')}) end"
_GRAM = "select id, g, count(*) c from (select id, unnest(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) as g from n) group by all"
_GRAMS = f"ga as ({_GRAM.format('r')}), gb as ({_GRAM.format('h')}), o as (select id, sum(least(ga.c, gb.c)) as common from ga join gb using (id, g) group by 1)"
_F1 = "case when h = '' or r = '' then (h = '' and r = '')::int::double when coalesce(common, 0) = 0 then 0.0 else 2.0 * common / (length(r) - 1 + length(h) - 1) end"
_MEASURED = f"{_PAIRS}, {_N}, {_GRAMS}, m as (select id, lang, {_CER} as cer, {_WER} as wer, {_F1} as f1 from n left join o using (id))"
_MEANS = "round(avg(cer), 6) as cer, round(avg(wer), 6) as wer, round(avg(f1), 6) as f1, round(1 - avg(cer), 6) as accuracy, count(*) as n"


def pairs(spark, d):
    """As _PAIRS."""
    lang = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "hi").otherwise("bn")
    changed = F.concat(F.replace(F.replace("text", F.lit("the"), F.lit("thee")), F.lit("on"), F.lit("o")), F.lit("x"))
    t = spread(table(spark, d, "benchmark").select("item_id", "text"))
    return t.select(F.col("item_id").alias("id"), lang.alias("lang"), F.col("text").alias("reference"), F.when(F.col("item_id") % 5 == 0, "").otherwise(changed).alias("hypothesis"))


def measured(spark, d):
    return quality.pair_metrics(pairs(spark, d))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("cer", "wer", "f1", "accuracy") else c for c in df.columns])


@query("select doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) as normal from documents")
def txt_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text"), F.col("lang")).alias("normal"))


@query("select item_id, text || 'क' as bare, text || 'ं' as nasal from benchmark")
def txt_normalize_indic(spark, d):
    bare, nasal = T.normalize_indic(F.concat("text", F.lit("क््")), F.lit("bn")), T.normalize_indic(F.concat("text", F.lit("ँ")), F.lit("hi"))
    return table(spark, d, "benchmark").select("item_id", bare.alias("bare"), nasal.alias("nasal"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as clean from documents")
def txt_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text"), F.col("lang")).alias("clean"))


@query("select o_orderkey, cast(o_orderkey as varchar) || '/' || cast(o_custkey as varchar) as parcel from orders")
def txt_digits(spark, d):
    deva = F.translate(F.concat_ws("/", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), "0123456789", "".join(chr(0x966 + i) for i in range(10)))
    return table(spark, d, "orders").select("o_orderkey", T.ascii_digits(deva, F.lit("hi")).alias("parcel"))


@query("select item_id, 'जीला ' || item_id as long_signs, 'जिला ' || item_id as kept from benchmark")
def txt_matra(spark, d):
    word = F.concat(F.lit("जिला "), F.col("item_id"))
    return table(spark, d, "benchmark").select("item_id", T.replace_signs(word, F.lit("hi")).alias("long_signs"), T.clean(word, F.lit("hi")).alias("kept"))


@query(f"select doc_id, len({_WORDS.format('text')})::int as n, coalesce({_WORDS.format('text')}[1], '') as first_word from documents")
def txt_tokenize(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first_word"))


@query("select item_id, case when length(text) < 3 then text else array_to_string(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)), '|') end as grams from benchmark")
def txt_ngrams(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.ngrams(F.col("text"), 3), "|").alias("grams"))


@query(f"with {_PAIRS}, {_N} select id, {_distance(_CHARS.format('r'), _CHARS.format('h'))}::int as chars, {_distance(_WORDS.format('r'), _WORDS.format('h'))}::int as words from n")
def txt_levenshtein(spark, d):
    n = pairs(spark, d).withColumns({c: T.normalize(F.col(c), F.lit("en")) for c in ("reference", "hypothesis")})
    return n.select("id", F.levenshtein("reference", "hypothesis").alias("chars"), T.levenshtein_words(T.tokenize(F.col("reference")), T.tokenize(F.col("hypothesis"))).alias("words"))


@query(f"with {_PAIRS}, {_N} select id, round({_CER}, 6) as cer from n")
def txt_cer(spark, d):
    return rounded(measured(spark, d).select("id", "cer"))


@query(f"with {_PAIRS}, {_N} select id, round({_WER}, 6) as wer from n")
def txt_wer(spark, d):
    return rounded(measured(spark, d).select("id", "wer"))


@query(f"with {_MEASURED} select id, round(f1, 6) as f1 from m")
def txt_f1(spark, d):
    return rounded(measured(spark, d).select("id", "f1"))


@query(f"with {_PAIRS} select id, round(case when reference = '' or hypothesis = '' then 0.0 else 1 - {_distance(_CHARS.format('reference'), _CHARS.format('hypothesis'))} / greatest(length(reference), length(hypothesis)) end, 6) as similarity from p")
def txt_similarity(spark, d):
    return pairs(spark, d).select("id", F.round(T.similarity(F.col("reference"), F.col("hypothesis")), 6).alias("similarity"))


@query(f"with {_MEASURED} select {_MEANS} from m")
def agg_metrics(spark, d):
    return rounded(measured(spark, d).agg(*quality.means()))


@query(f"with {_MEASURED} select lang, {_MEANS} from m group by lang")
def agg_metrics_by_lang(spark, d):
    return rounded(quality.metrics_by(measured(spark, d), "lang")).orderBy("lang")


@query(f"with {_MEASURED} select coalesce(lang, 'OVERALL') as lang, {_MEANS} from m group by rollup(lang)")
def agg_metrics_overall(spark, d):
    return rounded(quality.metrics_with_overall(measured(spark, d)))


@query(f"with {_MEASURED}, b as (select id % 2 as model, * from m) select model, {_MEANS} from b group by model")
def agg_metrics_by_model(spark, d):
    return rounded(quality.metrics_by(measured(spark, d).withColumn("model", F.col("id") % 2), "model"))


_ENTRIES = ["wodget", "small", "ring", "gadget", "large", "bolt"]


@query("""with w as (select p_partkey, pos, list_filter(string_split(p_name, ' '), lambda s: s <> '')[pos] as word from part, range(1, 5) t(pos) where pos <= len(list_filter(string_split(p_name, ' '), lambda s: s <> ''))),
v as (select unnest(['wodget', 'small', 'ring', 'gadget', 'large', 'bolt']) as entry, unnest(range(6)) as ord),
m as (select word, arg_min(entry, (levenshtein(word, entry) / greatest(length(word), length(entry)), ord)) as entry from (select distinct word from w), v
  where levenshtein(word, entry) / greatest(length(word), length(entry)) < 0.3 and 1 - levenshtein(word, entry) / greatest(length(word), length(entry)) > 0.7 group by word)
select p_partkey, string_agg(coalesce(entry, word), ' ' order by pos) as corrected from w left join m using (word) group by 1""")
def txt_vocab_correct(spark, d):
    vocabulary = correction.vocabulary_frame(spark, {"en": _ENTRIES})
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.lit("en").alias("lang"))
    return correction.correct_vocabulary(parts, vocabulary, "p_partkey")


@query("select word, entry, round(levenshtein(word, entry) / greatest(length(word), length(entry)), 6) as distance from (select distinct unnest(string_split(p_name, ' ')) as word from part), (select 'widget' as entry) where levenshtein(word, entry) / greatest(length(word), length(entry)) < 0.3")
def jn_vocab_nearest(spark, d):
    words = table(spark, d, "part").select(F.lit("en").alias("lang"), F.explode(F.split("p_name", " ")).alias("word"))
    found = correction.nearest_words(words, correction.vocabulary_frame(spark, {"en": ["widget"]}))
    return found.select("word", "entry", F.round("distance", 6).alias("distance"))


@query("select c_custkey, 'Village: ' || c_custkey || ' village' as corrected from customer")
def txt_correct(spark, d):
    text = F.concat(F.lit("Village:  "), F.col("c_custkey"), F.lit(" vilage "))
    rows = spread(table(spark, d, "customer").select("c_custkey"), 50_000).select("c_custkey", text.alias("text"), F.lit("en").alias("lang"))
    entries = correction.vocabulary_frame(spark, {"en": ["village"]})
    fixed = correction.correct(rows.withColumn("text", F.replace("text", F.lit("Village:"), F.lit("#"))), entries, "c_custkey")
    return fixed.withColumn("corrected", F.replace("corrected", F.lit("#"), F.lit("Village:")))


@query("select conv_id, string_agg(trim(text, ' ' || chr(10)), ' ' order by turn) as full_text from conversations where trim(text, ' ' || chr(10)) <> '' group by 1")
def txt_join_lines(spark, d):
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.btrim("text", F.lit(" \n")).alias("t")))).alias("r"))
    lines = F.array_remove(F.transform("r", lambda x: x["t"]), "")
    return whole.where(F.size(lines) > 0).select("conv_id", F.array_join(lines, " ").alias("full_text"))


@query("select c_custkey, 'O''Neil ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as name from customer")
def txt_person_name(spark, d):
    raw = F.concat(F.lit(" Mr. Shri o'neil "), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.person_name(raw).alias("name"))


@query("select o_orderkey, o_custkey || '.5 hectare' as area from orders")
def txt_area(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.area(F.concat(F.lit("about "), F.col("o_custkey"), F.lit(".5   hectare"))).alias("area"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as long_year, strftime(o_orderdate, '%Y-%m-%d') as short_year, 'no date' as other from orders")
def txt_date(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.iso_date(F.date_format(at, "d/M/yyyy")).alias("long_year"), T.iso_date(F.date_format(at, "dd-MM-yy")).alias("short_year"), T.iso_date(F.lit("no date")).alias("other"))


@query("select p_partkey, '₹' || p_size || '000' as rupee, '৳' || p_size as taka, cast(p_size as varchar) as plain from part")
def txt_currency(spark, d):
    n = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", T.currency(F.concat(F.lit("Rs "), n, F.lit(",000"))).alias("rupee"), T.currency(F.concat(n, F.lit(" টাকা"))).alias("taka"), T.currency(n).alias("plain"))


@query("select p_partkey, case when p_size % 3 = 0 then 1.0 else p_size + 0.5 end as n from part")
def txt_coerce_num(spark, d):
    raw = F.when(F.col("p_size") % 3 == 0, "acres").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5 acres")))
    return table(spark, d, "part").select("p_partkey", T.number_prefix(raw, 1).alias("n"))


@query("select p_partkey, replace(p_name, ' ', '_') || '.pdf' as name from part")
def txt_secure_filename(spark, d):
    return table(spark, d, "part").select("p_partkey", T.safe_filename(F.concat(F.lit("../"), F.col("p_name"), F.lit("!.pdf"))).alias("name"))


@query("select p_partkey, cast(p_size * 100000 as decimal(18,2)) as amount from part")
def txt_inr(spark, d):
    return table(spark, d, "part").select("p_partkey", T.rupees(F.concat(F.lit("₹ "), F.col("p_size"), F.lit(",00,000"))).alias("amount"))


# languages

_SPELT = (("etaoinshr", "कखगघङचछजझ"), ("etaoinshrdlcum", "কখগঘঙচছজঝটঠডঢণ"))
_CLASS = {name: "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in spans) for name, spans in lookups.SCRIPT_RANGES.items()}
_BY_SCRIPT: dict[str, list[str]] = {}
for _language, _name in lookups.LANGUAGE_SCRIPT.items():
    _BY_SCRIPT.setdefault(_name, []).append(_language)


def _spelt_sql(key: str, text: str = "text") -> str:
    """Texts as they are, or with some letters of two other scripts, which makes them ever less Latin; each third with keywords."""
    one, two = (f"translate({text}, '{a}', '{b}')" for a, b in _SPELT)
    return f"case {key} % 4 when 0 then {text} when 1 then {one} || ' खसरा मौजा है' when 2 then {two} || ' খতিয়ান জমি' else translate({one}, ' .,', '') end"


def spelt(key, text="text"):
    one, two = (F.translate(text, a, b) for a, b in _SPELT)
    k = F.col(key) % 4
    return F.when(k == 0, F.col(text)).when(k == 1, F.concat(one, F.lit(" खसरा मौजा है"))).when(k == 2, F.concat(two, F.lit(" খতিয়ান জমি"))).otherwise(F.translate(one, " .,", ""))


def _told(languages: list[str]) -> str:
    """{score, place, language} of the language with the largest share of keywords in lower(t)."""
    score = lambda x: "(" + " + ".join(["0", *[f"contains(lower(t), '{w}')::int" for w in lookups.LANGUAGE_KEYWORDS.get(x, [])]]) + f") / {max(1, len(lookups.LANGUAGE_KEYWORDS.get(x, [])))}"
    each = ", ".join("{'score': " + score(x) + f", 'place': {-i}, 'language': '{x}'" + "}" for i, x in enumerate(languages))
    return f"list_sort([{each}], 'DESC')[1]"


def _lid_sql(rows: str) -> str:
    """CTEs over rows (id, t): d has the dominant script and its share, s what it says, k what keywords say, a the answer."""
    counts = ", ".join("{'n': length(regexp_replace(t, '[^" + c + "]', '', 'g')), 'p': -length(regexp_extract(t, '(?s)^[^" + c + "]*')), 'script': '" + n + "'}" for n, c in _CLASS.items())
    several = " ".join(f"when script = '{n}' then {_told(xs)}" for n, xs in _BY_SCRIPT.items() if len(xs) > 1)
    first = " ".join(f"when script = '{n}' then '{xs[0]}'" for n, xs in _BY_SCRIPT.items())
    one = ", ".join(f"'{n}'" for n, xs in _BY_SCRIPT.items() if len(xs) == 1)
    return f"""with t as ({rows}), c as (select id, t, [{counts}] as counts from t),
    d as (select id, t, case when list_sum(list_transform(counts, lambda x: x.n)) = 0 then 'Unknown' else list_sort(counts, 'DESC')[1].script end as script,
      coalesce(list_sort(counts, 'DESC')[1].n / nullif(list_sum(list_transform(counts, lambda x: x.n)), 0), 0.0) as share from c),
    w as (select *, case {several} end as told, case {first} else 'hi' end as first_one from d),
    s as (select id, t, case when told.score > 0 then told.language else first_one end as language,
      case when script in ({one}) then share when script = 'Unknown' then 0.0 when told.score > 0 then (share + told.score) / 2 else share * 0.5 end as confidence from w),
    k as (select id, case when top.score > 0 then top.language else 'hi' end as k_language, case when top.score > 0 then top.score * 0.5 else 0.1 end as k_confidence
      from (select id, {_told(list(lookups.LANGUAGE_KEYWORDS))} as top from t)),
    a as (select id, case when not regexp_matches(t, '\\S') then 'hi' when confidence >= 0.7 then language else k_language end as language,
      case when not regexp_matches(t, '\\S') then 'blank' when confidence >= 0.7 then 'script' else 'keywords' end as stage from s join k using (id))"""


_BENCH_LID, _DOCS_LID = (_lid_sql(f"select {k} as id, {_spelt_sql(k)} as t from {name}") for k, name in (("item_id", "benchmark"), ("doc_id", "documents")))
_COUNT = "length(regexp_replace(t, '[^{0}]', '', 'g'))::int"


def spelt_benchmark(spark, d):
    return spread(table(spark, d, "benchmark").select("item_id", "text")).select(F.col("item_id").alias("id"), spelt("item_id").alias("t"))


@query(f"{_BENCH_LID} select id, {_COUNT.format(_CLASS['Latin'])} as latin, {_COUNT.format(_CLASS['Devanagari'])} as devanagari from t")
def lid_script_counts(spark, d):
    n = langid.script_counts(F.col("t"))
    return spelt_benchmark(spark, d).select("id", n["Latin"].alias("latin"), n["Devanagari"].alias("devanagari"))


@query(f"{_BENCH_LID} select id, script, round(share, 6) as share from d")
def lid_script(spark, d):
    rows = spelt_benchmark(spark, d).select("id", langid.dominant(F.col("t")).alias("s"))
    return rows.select("id", "s.script", F.round("s.share", 6).alias("share"))


@query(f"{_BENCH_LID} select id, language, round(confidence, 6) as confidence from s")
def lid_by_script(spark, d):
    rows = spelt_benchmark(spark, d).select("id", langid.by_script(F.col("t")).alias("s"))
    return rows.select("id", "s.language", F.round("s.confidence", 6).alias("confidence"))


@query(_lid_sql("select item_id as id, case item_id % 3 when 0 then 'खसराथा' when 1 then 'खगघङ' else 'आहेजमीन' end || item_id as t from benchmark") + " select id, language, round(confidence, 6) as confidence from s")
def lid_disambiguate(spark, d):
    t = F.concat(F.when(F.col("item_id") % 3 == 0, "खसराथा").when(F.col("item_id") % 3 == 1, "खगघङ").otherwise("आहेजमीन"), F.col("item_id"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), langid.by_script(t).alias("s"))
    return rows.select("id", "s.language", F.round("s.confidence", 6).alias("confidence"))


@query(f"{_DOCS_LID} select id, k_language as language, round(k_confidence, 6) as confidence from k")
def lid_by_keywords(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), langid.by_keywords(spelt("doc_id")).alias("s"))
    return rows.select("id", "s.language", F.round("s.confidence", 6).alias("confidence"))


@query(f"{_DOCS_LID} select id, language, stage from a")
def lid_identify(spark, d):
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), langid.identify(spelt("doc_id")).alias("s"))
    return rows.select("id", "s.language", "s.stage")


@query(_lid_sql(f"select row_number() over () as id, {_spelt_sql('turn')} as t from conversations") + " select language, count(*) as n from a group by 1")
def lid_batch(spark, d):
    rows = spread(table(spark, d, "conversations").select("turn", "text")).select(langid.identify(spelt("turn"))["language"].alias("language"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


_DIM = "(values " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(lookups.LANGUAGE_SCRIPT.items())) + ") t(language, script, place)"


def spoken(spark, d):
    """Customers with the language that their nation's number picks."""
    codes = F.array(*[F.lit(x) for x in lookups.LANGUAGE_SCRIPT])
    return table(spark, d, "customer").select("c_custkey", F.get(codes, F.col("c_nationkey") % len(lookups.LANGUAGE_SCRIPT)).alias("language"))


@query(f"select language, script, place, count(c_custkey) as n from {_DIM} left join customer on place = c_nationkey % {len(lookups.LANGUAGE_SCRIPT)} group by all")
def lid_lang_dim(spark, d):
    """The languages with their scripts, and how many customers speak each."""
    dim = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(lookups.LANGUAGE_SCRIPT.items())], "language string, script string, place int")
    counts = spoken(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "language", "left").fillna(0, ["n"])


@query(f"""select language_group, count(c_custkey) as n, count(distinct language) as languages from (values {", ".join(f"('{g}', '{x}')" for g, xs in lookups.LANGUAGE_GROUPS.items() for x in xs)}) g(language_group, language)
join {_DIM} using (language) join customer on place = c_nationkey % {len(lookups.LANGUAGE_SCRIPT)} group by 1""")
def lid_groups(spark, d):
    """How many customers speak a language of each group."""
    groups = spark.createDataFrame(list(lookups.LANGUAGE_GROUPS.items()), "language_group string, languages array<string>").select("language_group", F.explode("languages").alias("language"))
    counts = spoken(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(groups, "language").groupBy("language_group").agg(F.sum("n").alias("n"), F.count_distinct("language").alias("languages"))
