"""Column functions on text: normalisation, edit distance, error rates and the clean-up of single fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from parchment.functions.lookups import HINDI_SIGNS, NAME_TITLES, VIRAMAS, ZERO_DIGIT

INVISIBLE = "[\\u200B-\\u200F\\uFEFF]"
SPACE = "(?U)\\s+"
INDIC = ("hi", "mr", "ne", "bn", "as", "or", "gu", "pa")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Upper case after every character that isn't a letter, as in O'Neil; initcap only looks at blanks."""
    return texts.map(str.title, na_action="ignore")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column, lang: Column, composed: bool = False) -> Column:
    """Null as empty, NFC unless the text is known to be composed, without invisible characters, blanks collapsed, and
    for Indic languages without viramas at the end and, in Devanagari ones, candrabindu as anusvara."""
    full = F.coalesce(text, F.lit(""))
    flat = collapse(F.regexp_replace(full if composed else nfc(full), INVISIBLE, ""))
    return F.when(lang.isin(*INDIC), normalize_indic(flat, lang)).otherwise(flat)


def normalize_indic(text: Column, lang: Column) -> Column:
    bare = F.regexp_replace(text, f"[{VIRAMAS}]+$", "")
    return F.when(lang.isin("hi", "mr", "ne"), F.translate(bare, "ँ", "ं")).otherwise(bare)


def ascii_digits(text: Column, lang: Column) -> Column:
    """The digits of a language as 0 to 9; languages without own digits stay."""
    out = text
    for code, zero in ZERO_DIGIT.items():
        own = "".join(chr(ord(zero) + i) for i in range(10))
        out = F.when(lang == code, F.translate(text, own, "0123456789")).otherwise(out)
    return out


def replace_signs(text: Column, lang: Column) -> Column:
    """Each of four Hindi vowel signs as its long form, wherever it stands."""
    return F.when(lang == "hi", F.translate(text, "".join(HINDI_SIGNS), "".join(HINDI_SIGNS.values()))).otherwise(text)


def clean(text: Column, lang: Column, compat: str | None = None) -> Column:
    """Digits and blanks; compat="reference" also replaces vowel signs, which damages correct words."""
    digits = ascii_digits(text, lang)
    return collapse(replace_signs(digits, lang) if compat == "reference" else digits)


def tokenize(text: Column) -> Column:
    return F.array_remove(F.split(collapse(text), " "), "")


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams; a shorter text is its own one, an empty one has none. One scan of the text finds them all."""
    size = F.length(text)
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(grams)


def symbols(words: Column, vocabulary: Column) -> Column:
    """Each word as one character: its place in the sorted vocabulary, by halving steps, is a code point, without
    surrogates. More places than Unicode has code points are an error. The mark in front is taken for the byte order."""

    def code(steps: Column, w: Column) -> Column:
        place = F.aggregate(steps, F.lit(256), lambda at, s: F.when(F.get(vocabulary, at - 256 + s) <= w, at + s).otherwise(at))
        return let(place, lambda p: F.lpad(F.hex(p + F.when(p < 0xD800, 0).otherwise(0x800)), 8, "0"))

    needed = F.filter(F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]), lambda s: s < F.size(vocabulary))
    codes = let(needed, lambda steps: F.transform(words, lambda w: code(steps, w)))
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(codes, ""))), "UTF-32")


def levenshtein_words(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word becomes one character."""
    return let(F.sort_array(F.array_distinct(F.concat(a, b))), lambda v: F.levenshtein(symbols(a, v), symbols(b, v)))


def _rate(distance: Column, size: Column, other: Column) -> Column:
    return F.when(size == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(distance / size)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character errors for each character of the reference; may exceed 1."""
    return _rate(F.levenshtein(reference, hypothesis), F.length(reference), F.length(hypothesis))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word errors for each word of the reference."""
    r, h = tokenize(reference), tokenize(hypothesis)
    return _rate(levenshtein_words(r, h), F.size(r), F.size(h))


def multiset_overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays: of both sizes, half of what is left when each value's surplus on
    either side is taken off. The surpluses are summed over both arrays sorted together."""
    signed = lambda xs, sign: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(sign).alias("n")))
    zero = F.lit(0)
    start = F.struct(F.lit(None).cast("string").alias("x"), zero.alias("n"), zero.alias("all"))

    def step(acc: Column, one: Column) -> Column:
        same = acc["x"].eqNullSafe(one["x"])
        n = F.when(same, acc["n"]).otherwise(0) + one["n"]
        return F.struct(one["x"].alias("x"), n.alias("n"), (acc["all"] + F.when(same, 0).otherwise(F.abs(acc["n"]))).alias("all"))

    surplus = F.aggregate(F.sort_array(F.concat(signed(a, 1), signed(b, -1))), start, step, lambda acc: acc["all"] + F.abs(acc["n"]))
    return ((F.size(a) + F.size(b) - surplus) / 2).cast("int")


def f1(reference: Column, hypothesis: Column, n: int = 2) -> Column:
    """F1 of the n-gram multisets; 1 if both texts are empty, 0 if one is."""

    def score(a: Column, b: Column) -> Column:
        return let(multiset_overlap(a, b), lambda both: 2 * both / (F.size(a) + F.size(b)))

    empty = (F.length(reference) == 0).cast("int") + (F.length(hypothesis) == 0).cast("int")
    scored = let(F.struct(ngrams(reference, n).alias("a"), ngrams(hypothesis, n).alias("b")), lambda g: score(g["a"], g["b"]))
    return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(scored)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def strip_titles(name: Column) -> Column:
    """The titles of NAME_TITLES in turn off the front, each once. Most names have none, which one pattern tells."""
    bare = name
    for title in NAME_TITLES:
        bare = F.regexp_replace(bare, f"(?iu)^{title}[\\s.]+", "")
    return F.when(name.rlike(f"(?iu)^(?:{'|'.join(NAME_TITLES)})[\\s.]"), bare).otherwise(name)


def person_name(name: Column) -> Column:
    bare = strip_titles(F.trim(name))
    return F.trim(F.when(bare.rlike("[A-Za-z]"), title_case(bare)).otherwise(bare))


def area(text: Column) -> Column:
    """The first number, without commas, and what follows it as unit; the text itself if it has no number with a unit."""
    number, unit = (F.regexp_extract(text, r"([0-9,]+(?:\.[0-9]+)?)\s*(.+)", i) for i in (1, 2))
    return F.when(number == "", text).otherwise(F.concat_ws(" ", F.replace(number, F.lit(","), F.lit("")), F.trim(unit)))


def iso_date(text: Column) -> Column:
    """D/M/YYYY or D/M/YY with / or - at the front as YYYY-MM-DD, years below 50 in this century; any other text as it is."""
    day, month, year = (F.regexp_extract(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})", i) for i in (1, 2, 3))
    century = F.when(F.length(year) == 4, "").when(F.expr("true") & (F.try_to_number(year, F.lit("99")) < 50), "20").otherwise("19")
    return F.when(day == "", text).otherwise(F.concat_ws("-", F.concat(century, year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def currency(text: Column) -> Column:
    """The first number, without commas, behind the sign of rupee or taka; without either sign the text as it is."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    number = F.regexp_extract(plain, r"[0-9]+(?:\.[0-9]+)?", 0)
    return (
        F.when(number == "", text)
        .when(text.rlike("₹|Rs|रु"), F.concat(F.lit("₹"), number))
        .when(text.rlike("৳|টাকা"), F.concat(F.lit("৳"), number))
        .otherwise(text)
    )


def number_prefix(text: Column, default: float) -> Column:
    """The number that a text starts with; the default if there is none or it is zero."""
    found = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.coalesce(F.when(found != 0, found), F.lit(float(default)))


def safe_filename(name: Column) -> Column:
    """Only letters, digits, dots, dashes and underscores, no path and no dots in front."""
    joined = F.regexp_replace(F.regexp_replace(name, "[/\\\\]", " "), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(joined, "[^A-Za-z0-9_.-]", ""), "^[._]+|[._]+$", "")


def rupees(text: Column) -> Column:
    """An amount with Indian digit groups, like ₹ 1,20,00,000, as decimal."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("decimal(18,2)")
