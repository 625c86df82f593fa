"""Correction of words by the nearest word of a vocabulary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import clean, tokenize

#: Code points that a comparison drops: all but letters, decimal and other numbers, and underscores.
NOT_WORD = "[^\\p{L}\\p{N}_]"


def vocabulary_frame(spark, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(lang, ord, entry) of a vocabulary by language. It comes from an Arrow table, whose size Spark knows: of rows from a list it
    takes any size, and sends what they are joined with to the driver."""
    rows = [(lang, i, w) for lang, ws in vocabulary.items() for i, w in enumerate(ws)]
    types = (pa.string(), pa.int32(), pa.string())
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return spark.createDataFrame(pa.table(columns, ["lang", "ord", "entry"]), "lang string, ord int, entry string")


def allowed_edits(longer: Column) -> Column:
    """The most edits whose share of the longer length is below 0.3."""
    return F.floor((3 * longer - 1) / 10).cast("int")


def piece_keys(word: Column, entry_length: Column, edits: Column, own: bool) -> Column:
    """Keys array<struct(length, edits, piece, letters)> under which a word meets entries of a length within so many edits.

    An entry is cut into one piece more than there may be edits, so one piece is in the word as it is, no further from its
    own place than there are edits. With `own` the pieces are those of the entry itself.
    """
    start = lambda k: F.floor(k * entry_length / (edits + 1)).cast("int")
    shifts = F.array(F.lit(0)) if own else F.sequence(-edits, edits)

    def at(k: Column, shift: Column) -> Column:
        size = start(k + 1) - start(k)
        fits = (start(k) + shift >= 0) & (start(k) + shift + size <= F.length(word))
        return F.when(fits, F.struct(entry_length.alias("length"), edits.alias("edits"), k.alias("piece"), F.substr(word, start(k) + shift + 1, size).alias("letters")))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), edits), lambda k: F.transform(shifts, lambda s: at(k, s))))))


def near_entries(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, bare, ord, entry, edits) for all distinct (lang, bare) of words and the entries of their language whose edit distance is
    below 0.3 of the longer length. They meet under pieces of an entry, not under their language, so no language's words
    are compared with all its entries."""
    n, m = F.length("bare"), F.length("entry")
    lengths = F.sequence(F.ceil(n * 0.7).cast("int"), F.floor(n / 0.7).cast("int"))
    tasks = 4 * words.sparkSession.sparkContext.defaultParallelism  # short as the words are, each has dozens of keys
    asked = words.select("lang", "bare").where("bare <> ''").distinct().repartition(tasks, "lang", "bare").withColumn("length", F.explode(lengths))
    asked = asked.select("lang", "bare", F.explode(piece_keys(F.col("bare"), F.col("length"), allowed_edits(F.greatest(n, F.col("length"))), False)).alias("key"))
    most = F.sequence(allowed_edits(m), allowed_edits(F.floor(m / 0.7).cast("int")))
    held = vocabulary.where("entry <> ''").withColumn("edits", F.explode(most))
    held = held.select("lang", "ord", "entry", F.explode(piece_keys(F.col("entry"), m, F.col("edits"), True)).alias("key"))
    met = asked.join(held, ["lang", "key"]).select("lang", "bare", "ord", "entry").distinct()
    near = met.withColumn("edits", F.levenshtein("bare", "entry")).withColumn("share", F.col("edits") / F.greatest(n, m))
    return near.where((F.col("share") < 0.3) & (1 - F.col("share") > 0.7)).drop("share")


def nearest_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, word, bare, entry, distance): for each distinct word the entry of its language at the least edit distance
    over the longer length, the first among equals, if that is below 0.3 and its complement above 0.7."""
    distinct = words.select("lang", "word").distinct().withColumn("bare", F.regexp_replace("word", NOT_WORD, ""))
    scored = near_entries(distinct, vocabulary).withColumn("distance", F.col("edits") / F.greatest(F.length("bare"), F.length("entry")))
    best = scored.groupBy("lang", "bare").agg(F.min(F.struct("distance", "ord", "entry")).alias("m"))
    return distinct.join(best.hint("merge"), ["lang", "bare"]).select("lang", "word", "bare", F.col("m.entry").alias("entry"), F.col("m.distance").alias("distance"))


def tokenized(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(_row, key, lang, words) of each row. Rows equal in language and text are corrected alike, so what is found out about them
    comes back by their digest: keys may be null or repeat, and rows may come in any order."""
    digest = F.sha2(F.to_json(F.struct(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))), 256)
    return df.select(digest.alias("_row"), F.col(key).alias("key"), F.col(lang).alias("lang"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("words"))


def with_words(rows: DataFrame, found: DataFrame, fitted) -> DataFrame:
    """(key, corrected) of rows as in tokenized(): words joined by blanks, those at the places of found (_row, pos, word) as
    fitted(word, found word). There are as many changes as rows, so they are shuffled, whatever the size of the files that they
    come from makes of them."""
    changes = found.select("_row", "pos", "word").distinct().groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "word"))).alias("changes"))
    new = F.transform("words", lambda w, i: F.coalesce(fitted(w, F.try_element_at("changes", i)), w))
    return rows.join(changes.hint("merge"), "_row", "left").select("key", F.array_join(new, " ").alias("corrected"))


def correct_vocabulary(df: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, corrected), one for each row: words joined by blanks, each replaced, its punctuation included, where an entry is
    near enough. Rows of an unknown or null language keep their words; null texts are empty; keys may be null or repeat."""
    rows = tokenized(df, key, text, lang)
    words = rows.select("_row", "lang", F.posexplode("words").alias("pos", "word"))
    found = words.join(nearest_words(words, vocabulary).select("lang", "word", "entry").hint("merge"), ["lang", "word"]).where("word <> entry")
    return with_words(rows, found.select("_row", "pos", F.col("entry").alias("word")), lambda w, new: new).withColumnRenamed("key", key)


def correct(df: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", lang: str = "lang", compat: str | None = None) -> DataFrame:
    """(key, corrected): digits and blanks first, then the vocabulary."""
    rules: Column = clean(F.coalesce(F.col(text), F.lit("")), F.col(lang), compat)
    return correct_vocabulary(df.withColumn(text, rules), vocabulary, key, text, lang)
