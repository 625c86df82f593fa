"""Script and language identification by counts of characters and by keywords, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.lookups import LANGUAGE_KEYWORDS, LANGUAGE_SCRIPT, SCRIPT_RANGES
from parchment.functions.text import let

MIN_CONFIDENCE = 0.7
FALLBACK, FALLBACK_CONFIDENCE = "hi", 0.1
#: With compat="reference", Latin is every character below U+0250, digits and blanks too; otherwise its letters alone.
LATIN_LETTERS = "A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u024F"


def _char_class(script: str, compat: str | None) -> str:
    if script == "Latin" and compat != "reference":
        return LATIN_LETTERS
    return "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in SCRIPT_RANGES[script])


def _counts(text: Column, compat: str | None) -> Column:
    """How many characters of a text each of SCRIPT_RANGES has, in order. A script's characters are taken out before the next
    one's are counted, so a text is read a few times and not once for each script."""
    letters = F.length(F.regexp_replace(text, f"[^{LATIN_LETTERS}]+", ""))

    def count(foreign: Column, left: Column, scripts: list[str], counted: list[Column]) -> Column:
        if not scripts:
            return F.array(*counted)
        if scripts[0] == "Latin":
            return count(foreign, left, scripts[1:], [*counted, F.length(text) - F.length(foreign) if compat == "reference" else letters])
        taken = F.when(left == "", left).otherwise(F.regexp_replace(left, f"[{_char_class(scripts[0], compat)}]+", ""))
        return let(taken, lambda rest: count(foreign, rest, scripts[1:], [*counted, F.length(left) - F.length(rest)]))

    # all other scripts are beyond it
    return let(F.regexp_replace(text, f"[{_char_class('Latin', 'reference')}]+", ""), lambda foreign: count(foreign, foreign, list(SCRIPT_RANGES), []))


def script_counts(text: Column, compat: str | None = "reference") -> dict[str, Column]:
    """How many characters of a text each script has."""
    return {s: let(text, lambda t: _counts(t, compat))[i] for i, s in enumerate(SCRIPT_RANGES)}


def _first(text: Column, script: str, compat: str | None) -> Column:
    """The place of a script's first character; past the end if it has none."""
    return F.length(F.regexp_extract(text, f"(?s)^[^{_char_class(script, compat)}]*", 0))


def dominant(text: Column, compat: str | None = "reference") -> Column:
    """struct(script, share of all characters of known scripts); the script that comes first wins a tie; without such
    characters Unknown and 0."""
    names = F.array(*[F.lit(s) for s in SCRIPT_RANGES])

    def choose(t: Column, n: Column) -> Column:
        most, total = F.array_max(n), F.aggregate(n, F.lit(0), lambda a, b: a + b)
        tie = F.size(F.filter(n, lambda x: x == most)) > 1
        rows = F.array(*[F.struct(n[i].alias("n"), (-_first(t, s, compat)).alias("p"), F.lit(s).alias("script")) for i, s in enumerate(SCRIPT_RANGES)])
        name = F.when(tie, F.array_max(rows)["script"]).otherwise(F.element_at(names, F.array_position(n, most).cast("int")))
        return F.when(most == 0, F.struct(F.lit("Unknown").alias("script"), F.lit(0.0).alias("share"))).otherwise(F.struct(name.alias("script"), (most / total).alias("share")))

    return let(text, lambda t: let(_counts(t, compat), lambda n: choose(t, n)))


def script(text: Column, compat: str | None = "reference") -> Column:
    return dominant(text, compat)["script"]


def _leads(words: list[str]) -> set[bytes]:
    """The first two bytes in UTF-8 of each word's first character beyond ASCII, which texts without them can't have; none if a
    word has no such character."""
    beyond = [next((c for c in w if ord(c) > 127), "") for w in words]
    return {c.encode()[:2] for c in beyond} if all(beyond) else set()


def keyword_scores(lowered: Column, languages: list[str]) -> Column:
    """array of struct(score, -place, language): the share of a language's keywords that occur anywhere in the text. Words are
    looked for only where the bytes that they begin with occur."""

    def score(language: str, octets: Column) -> Column:
        words = LANGUAGE_KEYWORDS.get(language, [])
        hits = reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words], F.lit(0))
        if leads := _leads(words):
            there = reduce(lambda a, b: a | b, [F.contains(octets, F.lit(lead)) for lead in sorted(leads)])
            hits = F.when(~there, 0).otherwise(hits)
        return hits / max(1, len(words))

    scores = lambda octets: F.array(*[F.struct(score(x, octets).alias("score"), F.lit(-i).alias("place"), F.lit(x).alias("language")) for i, x in enumerate(languages)])
    return let(lowered.cast("binary"), scores)


def _answer(language: Column, confidence: Column, stage: str) -> Column:
    return F.struct(language.alias("language"), confidence.alias("confidence"), F.lit(stage).alias("stage"))


def by_keywords(text: Column) -> Column:
    """The language with the largest share of keywords, first ones among equals, at half that share; the fallback
    if no keyword occurs."""
    top = let(F.lower(text), lambda t: F.array_max(keyword_scores(t, list(LANGUAGE_KEYWORDS))))
    return let(
        top,
        lambda t: F.when(t["score"] > 0, _answer(t["language"], t["score"] * 0.5, "keywords")).otherwise(
            _answer(F.lit(FALLBACK), F.lit(FALLBACK_CONFIDENCE), "keywords")
        ),
    )


def by_script(text: Column, compat: str | None = "reference") -> Column:
    """The language of the dominant script; several languages of one script are told apart by keywords. Without a
    keyword the script's first language at half the share, else the mean of share and keyword score."""
    of_script: dict[str, list[str]] = {}
    for language, name in LANGUAGE_SCRIPT.items():
        of_script.setdefault(name, []).append(language)

    def of_several(text: Column, d: Column, languages: list[str]) -> Column:
        plain = _answer(F.lit(languages[0]), d["share"] * 0.5, "script")
        told = lambda t: _answer(t["language"], (d["share"] + t["score"]) / 2, "script")
        return let(let(F.lower(text), lambda t: F.array_max(keyword_scores(t, languages))), lambda t: F.when(t["score"] > 0, told(t)).otherwise(plain))

    def choose(text: Column, d: Column) -> Column:
        out = _answer(F.lit(FALLBACK), F.lit(0.0), "script")
        for name, languages in of_script.items():
            found = _answer(F.lit(languages[0]), d["share"], "script") if len(languages) == 1 else of_several(text, d, languages)
            out = F.when(d["script"] == name, found).otherwise(out)
        return out

    return let(text, lambda t: let(dominant(t, compat), lambda d: choose(t, d)))


def identify(text: Column, compat: str | None = "reference", min_confidence: float = MIN_CONFIDENCE) -> Column:
    """struct(language, confidence, stage): blank texts are the fallback at 0; else what the script says if it is sure
    enough, else what the keywords say."""

    def answer(full: Column) -> Column:
        found = let(by_script(full, compat), lambda s: F.when(s["confidence"] >= min_confidence, s).otherwise(by_keywords(full)))
        return F.when(~full.rlike("(?U)\\S"), _answer(F.lit(FALLBACK), F.lit(0.0), "blank")).otherwise(found)

    return let(F.coalesce(text, F.lit("")), answer)
