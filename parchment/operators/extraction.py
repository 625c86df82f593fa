"""Fields of land records from recognised text, with confidence, validation and cross checks."""

from __future__ import annotations

import string
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import fields as S
from parchment.functions import text as T
from parchment.functions.lookups import LAND_TYPE_WORDS, REQUIRED_FIELDS, VOCABULARY

BASE = 0.7
FIELDS_TYPE = "map<string,struct<value:string,confidence:double>>"


def _by(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = F
    for holds, found in cases:
        out = out.when(holds, found)
    return out.otherwise(otherwise) if cases else otherwise


def _by_group(lang: Column, values: dict[str, Column], otherwise: Column) -> Column:
    """The value of the group that a language is in."""
    return _by([(lang.isin(*S.GROUPS[group]), found) for group, found in values.items()], otherwise)


def _candidates(text: Column, lang: Column, field: str, compat: str | None) -> Column:
    """All values that the field's pattern for the language finds, in order of place."""
    groups = [g for g in S.GROUPS if g in S.LABELS[field] and not (compat == "reference" and S.has_script_class(field, g))]
    return _by_group(lang, {g: F.regexp_extract_all(text, F.lit(S.pattern(field, g, compat)), F.lit(1)) for g in groups}, F.array().cast("array<string>"))


def cut_at_label(value: Column, lang: Column) -> Column:
    """The value up to a line end or the next label of any field; of values joined by HEAD each of them, not trimmed."""
    cut = {}
    for group in S.GROUPS:
        every = "|".join(sorted({w for f in S.LABELS for w in S.LABELS[f].get(group, "").split("|") if w.strip()}, key=len, reverse=True))
        cut[group] = F.regexp_replace(value, f"(?iu)(?=\\s)\\s*(?:[\\n\\r][^{S.HEAD}]*|(?<=[\\s])(?:{every})(?=[\\s:.{S.HEAD}]|$)[^{S.HEAD}]*)", "")
    return _by_group(lang, cut, value)


def valid(value: Column, field: str) -> Column:
    """Not empty, the field's form and lengths; codes have a digit."""
    form, least, most = S.VALID.get(field, (None, 0, None))
    ok = F.length(value) >= max(1, least)
    if form:
        ok &= value.rlike(form)
    if most:
        ok &= F.length(value) <= most
    return ok & value.rlike("[0-9]") if field in S.CODES else ok


def finish(value: Column, field: str) -> Column:
    kind = S.FINISH.get(field)
    return {"name": T.strip_titles, "area": T.area, "date": T.iso_date, "currency": T.currency}.get(kind, lambda v: v)(value)


def _by_words(lang: Column, made, otherwise: Column) -> Column:
    """made(pattern of the words) with the vocabulary of a language."""
    return _by([(lang == code, made(f"{S.starts_with(words)}(?:{'|'.join(words)})")) for code, words in VOCABULARY.items()], otherwise)


def field_confidence(value: Column, field: str, known: Column) -> Column:
    """The base, more for a word of the vocabulary and for the form of the field; 1 at most."""
    score = F.lit(BASE) + F.when(known, 0.1).otherwise(0.0)
    if field in ("survey_number", "khata_number", "khasra_number"):
        score += F.when(value.rlike("^[A-Z0-9/\\-]+$"), 0.15).otherwise(0.0)
    elif field == "area":
        score += F.when(value.rlike("[0-9]\\s*[^0-9\\s.,]"), 0.2).otherwise(0.0)
    elif field == "registration_date":
        score += F.when(value.rlike("^\\d{4}-\\d{2}-\\d{2}"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def best_candidate(values: Column, field: str, lang: Column) -> Column:
    """struct(value, confidence) of the surest value, the first among equals; once one is beyond 1, which is cut to 1,
    each later one beyond 1 takes its place. Null without values."""
    boost = S.BOOST.get(field, 0.0)
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"))

    def step(acc: Column, v: Column) -> Column:
        return F.when(v["confidence"] > acc["confidence"], F.struct(v["value"].alias("value"), F.least(F.lit(1.0), v["confidence"]).alias("confidence"))).otherwise(acc)

    known = lambda v: _by_words(lang, v.rlike, F.lit(False))
    values = F.transform(values, lambda v: F.struct(v.alias("value"), (field_confidence(v, field, known(v)) + boost).alias("confidence")))
    return T.let(F.aggregate(values, none, step), lambda b: F.when(F.coalesce(b["value"], F.lit("")) != "", b))


def _finished(values: Column, field: str) -> Column:
    return F.transform(F.filter(values, lambda v: valid(v, field)), lambda v: finish(v, field))


NAMED = (S.PLACES + ("seller", "buyer"), ("owner_name", "father_name"), ("land_type",))  # fields whose values are cut, by the characters they take


def _plain(text: Column, lang: Column, fields) -> Column:
    """What `_any` finds, for texts in which each label starts a line, no field has two and each of `fields` that has a label has a value
    behind it; null for others.

    The heads of all fields are found in one pass, so that a field's value is what its own lines start with. What is done alike to names
    is done to all of them at once, joined by HEAD.
    """
    i_of = {f: i for i, f in enumerate(fields)}
    joined = lambda values: F.concat_ws(S.HEAD, *[F.coalesce(v, F.lit("")) for v in values])
    parts = lambda text: F.split(text, S.HEAD, -1)
    named = [[f for f in some if f in i_of] for some in NAMED]
    letters = string.ascii_letters[: len(S.FIELD_BARS) + 2]
    order = [f for some in named for f in some]

    def found(marked: Column) -> Column:
        bars = lambda p: F.array_join(F.transform(p, lambda x: F.substring(F.lit(letters), F.length(x) - F.length(F.ltrim(x, F.lit(S.BAR))) + 1, F.lit(1))), "")
        return F.when(~marked.rlike(f"{S.HEAD}(?<=[^\\n\\r]{S.HEAD})"), T.let(parts(marked), lambda p: T.let(bars(p), lambda k: behind(p, k))))

    def behind(pieces: Column, heads: Column) -> Column:
        """What is behind each field's head; `heads` has a letter for each piece, by its field."""
        once = ~heads.rlike(f"(.).*\\1|{letters[S.ODD]}")
        return F.when(once, T.let(F.array(*[F.substring_index(F.get(pieces, F.instr(heads, letters[S.FIELD_BARS[f]]) - 1), S.BAR, -1) for f in fields]), runs))

    def runs(rest: Column) -> Column:
        """The characters that a value takes."""
        of = lambda f: F.get(rest, F.lit(i_of[f]))

        def run(some: list[str], text: Column) -> Column:
            spared = lambda g: "(?![A-Za-z\\s])" if g == "main" else ""  # noqa: E731  (for these Java would ask for nine scripts first)
            beyond = {g: f"(?iu){spared(g)}[^{S.characters(some[0], g)}{S.HEAD}][^{S.HEAD}]*" for g in S.GROUPS if g in S.LABELS[some[0]]}
            return _by_group(lang, {g: F.regexp_replace(text, x, "") for g, x in beyond.items()}, text)

        taken = [T.let(joined([of(f) for f in some]), partial(run, some)) for some in named if some]

        def first(f: str) -> Column:
            made = {g: f"^(?iu){S.value_pattern(f, g)}" for g in S.GROUPS if g in S.LABELS[f]}
            if len(set(made.values())) == 1:
                return F.regexp_extract(of(f), made["main"], 0)
            return F.when(of(f).isNotNull(), _by_group(lang, {g: F.regexp_extract(of(f), x, 0) for g, x in made.items()}, of(f)))

        names = parts(cut_at_label(F.concat_ws(S.HEAD, *taken), lang)) if taken else F.array().cast("array<string>")
        trimmed = lambda n: F.array(*[F.when(of(f).isNotNull(), F.trim(F.get(n, F.lit(order.index(f))))) if f in order else first(f) for f in fields])
        return T.let(T.let(names, trimmed), finished)

    def finished(raw: Column) -> Column:
        of = lambda f: F.get(raw, F.lit(i_of[f]))
        return F.when(~F.coalesce(F.array_contains(raw, ""), F.lit(False)), T.let(F.array(*[F.when(of(f).isNotNull() & valid(of(f), f), finish(of(f), f)) for f in fields]), sure))

    def sure(values: Column) -> Column:
        of = lambda f: F.get(values, F.lit(i_of[f]))
        marked = T.let(joined([of(f) for f in fields]), lambda t: _by_words(lang, lambda words: F.regexp_replace(t, words, S.BAR), t))
        return T.let(parts(marked), lambda known: F.map_from_entries(F.array_compact(F.array(*[entry(f, of(f), F.contains(F.get(known, F.lit(i_of[f])), F.lit(S.BAR))) for f in fields]))))

    def entry(field: str, value: Column, known: Column) -> Column:
        surest = F.least(F.lit(1.0), field_confidence(value, field, known) + S.BOOST.get(field, 0.0))
        return F.when(value != "", F.struct(F.lit(field).alias("key"), F.struct(value.alias("value"), surest.alias("confidence")).alias("value")))

    marked = _by_group(lang, {g: F.regexp_replace(text, S.heads_pattern(g), S.HEADS) for g in S.GROUPS}, F.lit(None).cast("string"))
    return F.when(~(F.contains(text, F.lit(S.HEAD)) | F.contains(text, F.lit(S.BAR))), T.let(marked, found))


def _any(text: Column, lang: Column, compat: str | None, fields) -> Column:
    found = []
    for field in fields:
        values = _candidates(text, lang, field, compat)
        if compat != "reference":
            if field in S.PEOPLE + S.PLACES + ("land_type",):
                values = F.transform(values, lambda v: F.trim(cut_at_label(v, lang)))
            values = _finished(values, field)
        found.append(F.struct(F.lit(field).alias("key"), best_candidate(values, field, lang).alias("value")))
    return F.map_from_entries(F.filter(F.array(*found), lambda x: x["value"].isNotNull()))


def parse(text: Column, lang: Column, compat: str | None = None, fields=tuple(S.LABELS)) -> Column:
    """FIELDS_TYPE: value and confidence of each field found.

    Values are cut at the next label, checked and finished (titles, area, date, currency). With compat="reference" none of
    this happens and fields whose patterns name a script aren't found. Records of one label a line are parsed in one pass; any other text
    is searched by the pattern of each field, with the same results.
    """
    searched = _any(text, lang, compat, fields)
    return searched if compat == "reference" else F.coalesce(_plain(text, lang, fields), searched)


def record_confidence(found: Column) -> Column:
    """The mean confidence of the fields; 0 without any."""
    return T.let(F.map_values(found), lambda v: F.when(F.size(v) == 0, 0.0).otherwise(F.aggregate(v, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(v)))


def missing_required(found: Column, required: list[str] = REQUIRED_FIELDS) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.map_keys(found))


#: The fields that `cross_checks` reads.
CROSS_CHECKED = ("survey_number", "khasra_number", "area", "registration_date")


def cross_checks(found: Column, today: Column) -> Column:
    """array of struct(rule, severity): survey and khasra number differ, an area that isn't positive, a date to come."""
    value = lambda f: found[f]["value"]
    area = F.regexp_extract(value("area"), r"^\s*([0-9.]+)", 1).try_cast("double")
    rules = F.array(
        F.when(value("survey_number") != value("khasra_number"), F.struct(F.lit("survey_khasra").alias("rule"), F.lit("warning").alias("severity"))),
        F.when(~(area > 0), F.struct(F.lit("area_positive").alias("rule"), F.lit("error").alias("severity"))),
        F.when(F.try_to_timestamp(value("registration_date"), F.lit("yyyy-MM-dd")) > today.cast("timestamp"), F.struct(F.lit("date_not_future").alias("rule"), F.lit("warning").alias("severity"))),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def extract(df: DataFrame, text: str = "text", lang: str = "lang", compat: str | None = None) -> DataFrame:
    """df with fields, record_confidence and missing."""
    found = df.withColumn("fields", parse(F.coalesce(F.col(text), F.lit("")), F.col(lang), compat))
    return found.withColumns({"record_confidence": record_confidence(F.col("fields")), "missing": missing_required(F.col("fields"))})


def land_types(text: Column, lang: Column) -> Column:
    """The words for types of land that occur in a text of a language, in the order of their list; none for null or another language."""
    found = F.array().cast("array<string>")
    for code, words in LAND_TYPE_WORDS.items():
        found = F.when(lang == code, F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))).otherwise(found)
    return found
