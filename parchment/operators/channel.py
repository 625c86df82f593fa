"""Correction of words in their context: a noisy channel.

A word may stand for any word of the vocabulary that is near it; what it costs to take one for the other, and how often words
follow each other in a corpus, decide which sequence is likeliest. Only words that may stand for several are looked at: a
word without choice parts a text, so the choices between two such words are searched for themselves, by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.text import clean, tokenize
from parchment.operators.correction import NOT_WORD, correct_vocabulary, near_entries, tokenized, with_words

#: What an edit costs (natural logarithm), the weight of a word's own frequency among those that follow, and the choices of a word.
EDIT_COST, BACK_OFF, CHOICES = 4.0, 2.0, 8


@dataclass
class Counts:
    """words: (lang, word, n); pairs: (lang, a, b, n), where an empty word stands before a row's first and behind its last one;
    sums: (lang, total, kinds)."""

    words: DataFrame
    pairs: DataFrame
    sums: DataFrame


def bare(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, NOT_WORD, ""))


def count_corpus(corpus: DataFrame, text: str = "text", lang: str = "lang") -> Counts:
    """How often words occur, and follow each other, in the rows of a corpus; punctuation is dropped. Null texts and languages count nothing."""
    rows = corpus.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.array_remove(bare(tokenize(F.col(text))), "").alias("ws"))
    edge = F.array(F.lit(""))
    both = F.explode(F.arrays_zip(F.concat(edge, "ws").alias("a"), F.concat("ws", edge).alias("b")))
    pairs = rows.where(F.size("ws") > 0).select("lang", both.alias("p")).groupBy("lang", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    words = pairs.groupBy("lang", F.col("b").alias("word")).agg(F.sum("n").alias("n"))
    return Counts(words, pairs, words.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))


def choices(words: DataFrame, counts: Counts, least: int, edit_cost: float, most: int) -> DataFrame:
    """(lang, bare, choices) of the distinct (lang, bare) that may stand for several words: array<struct(word, cost)>, itself at no
    cost, and the `most` nearest words that occur at least `least` times, the more frequent first among equally near ones."""
    entries = counts.words.where((F.col("n") >= least) & (F.col("word") != "")).select("lang", F.lit(0).alias("ord"), F.col("word").alias("entry"), "n")
    near = near_entries(words, entries.drop("n")).where("bare <> entry").join(entries.drop("ord"), ["lang", "entry"])
    place = F.row_number().over(W.partitionBy("lang", "bare").orderBy("edits", F.desc("n"), "entry"))
    kept = near.withColumn("place", place).where(F.col("place") <= most)
    others = kept.groupBy("lang", "bare").agg(F.sort_array(F.collect_list(F.struct(F.col("entry").alias("word"), (-edit_cost * F.col("edits")).alias("cost")))).alias("others"))
    own = F.array(F.struct(F.col("bare").alias("word"), F.lit(0.0).alias("cost")))
    return others.select("lang", "bare", F.concat(own, "others").alias("choices"))


def _steps(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_row, lang, part, pos, a, b, cost): every pair of neighbouring choices, from the word before each stretch of words with choices
    to the word behind it."""
    near = lambda i: F.when(i >= 0, F.get("bares", i))
    placed = F.transform("bares", lambda w, i: F.struct(w.alias("bare"), near(i - 1).alias("left"), near(i + 1).alias("right")))
    words = rows.select("_row", "lang", F.posexplode(placed).alias("pos", "w")).select("_row", "lang", "pos", "w.*")
    at = words.hint("merge").join(chosen, ["lang", "bare"]).distinct()
    beside = lambda c: F.array(F.struct(F.coalesce(F.col(c), F.lit("")).alias("word"), F.lit(0.0).alias("cost")))
    order = W.partitionBy("_row").orderBy("pos")
    at = at.withColumns({
        "part": F.col("pos") - F.row_number().over(order), "joined": F.coalesce(F.lag("pos").over(order) == F.col("pos") - 1, F.lit(False)),
        "last": F.coalesce(F.lead("pos").over(order) != F.col("pos") + 1, F.lit(True)), "earlier": F.lag("choices").over(order),
    })
    before = F.when(F.col("joined"), F.col("earlier")).otherwise(beside("left"))
    own = F.struct(F.col("pos").alias("pos"), before.alias("from"), F.col("choices").alias("to"))
    closing = F.when(F.col("last"), F.struct((F.col("pos") + 1).alias("pos"), F.col("choices").alias("from"), beside("right").alias("to")))
    steps = at.select("_row", "lang", "part", F.explode(F.array_compact(F.array(own, closing))).alias("s"))
    pairs = steps.select("_row", "lang", "part", "s.pos", F.explode("s.from").alias("a"), "s.to").select("_row", "lang", "part", "pos", "a", F.explode("to").alias("b"))
    return pairs.select("_row", "lang", "part", "pos", F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("b.cost").alias("cost"))


def log_follow(pairs: DataFrame, counts: Counts, back_off: float) -> DataFrame:
    """The distinct (lang, a, b) of pairs with follow, the logarithm of the share of b among the words behind a, mixed with its
    share among all words."""
    asked = pairs.select("lang", "a", "b").distinct()
    before = counts.pairs.groupBy("lang", "a").agg(F.sum("n").alias("n_a"))
    met = asked.join(counts.pairs.withColumnRenamed("n", "n_ab").hint("merge"), ["lang", "a", "b"], "left").join(before.hint("merge"), ["lang", "a"], "left")
    met = met.join(counts.words.select("lang", F.col("word").alias("b"), F.col("n").alias("n_b")).hint("merge"), ["lang", "b"], "left").join(counts.sums, "lang")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    alone = (none("n_b") + 0.1) / (F.col("total") + 0.1 * (F.col("kinds") + 1))
    return met.select("lang", "a", "b", F.log((none("n_ab") + back_off * alone) / (none("n_a") + back_off)).alias("follow"))


def best_sequences(steps: DataFrame) -> DataFrame:
    """(_row, pos, word) of the likeliest choices of each stretch; steps as in _steps, with a weight for each pair."""
    moves = steps.groupBy("_row", "part", "pos").agg(F.collect_list(F.struct("a", "b", "weight")).alias("moves"))
    parts = moves.groupBy("_row", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "moves"))).alias("steps"))
    first = F.element_at(F.element_at("steps", 1)["moves"], 1)["a"]
    start = F.array(F.struct(first.alias("word"), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("path")))

    def reached(so_far: Column, move: Column) -> Column:
        at = F.element_at(F.filter(so_far, lambda x: x["word"] == move["a"]), 1)
        return F.struct((at["score"] + move["weight"]).alias("score"), F.concat(at["path"], F.array(move["b"])).alias("path"))

    def step(so_far: Column, one: Column) -> Column:
        def best(word: Column) -> Column:
            top = F.array_max(F.transform(F.filter(one["moves"], lambda m: m["b"] == word), lambda m: reached(so_far, m)))
            return F.struct(word.alias("word"), top["score"].alias("score"), top["path"].alias("path"))

        return F.transform(F.array_distinct(F.transform(one["moves"], lambda m: m["b"])), best)

    path = F.element_at(F.aggregate("steps", start, step), 1)["path"]
    found = parts.select("_row", F.element_at("steps", 1)["pos"].alias("from"), F.posexplode(F.slice(path, 1, F.size(path) - 1)).alias("k", "word"))
    return found.select("_row", (F.col("from") + F.col("k")).alias("pos"), "word")


def correct_in_context(
    df: DataFrame, counts: Counts, key: str, text: str = "text", lang: str = "lang", least: int = 2, edit_cost: float = EDIT_COST, back_off: float = BACK_OFF, most: int = CHOICES
) -> DataFrame:
    """(key, corrected), one for each row: the likeliest words given those beside them, joined by blanks. A word's punctuation stays.

    Null texts are empty; rows of a language that counts doesn't know keep their words; keys may be null or repeat. Between
    sequences equally likely the one that comes last in order is taken.
    """
    rows = tokenized(df, key, text, lang).withColumn("bares", bare(F.col("words")))
    asked = rows.select("lang", F.explode("bares").alias("bare")).distinct()
    steps = _steps(rows, choices(asked, counts, least, edit_cost, most))
    weighed = steps.join(log_follow(steps, counts, back_off), ["lang", "a", "b"]).withColumn("weight", F.col("cost") + F.col("follow"))
    own = lambda w: F.regexp_replace(w, NOT_WORD, "")
    fitted = lambda w, new: F.when(own(w) == new, w).when(F.contains(w, own(w)), F.replace(w, own(w), new)).otherwise(new)
    return with_words(rows, best_sequences(weighed), fitted).withColumnRenamed("key", key)


def correct_fully(df: DataFrame, vocabulary: DataFrame, counts: Counts, key: str, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(key, corrected) by all three stages: digits and blanks, the nearest entry of the vocabulary, and the context."""
    rows = df.select(F.struct(F.col(key).alias("key"), F.col(lang).alias("lang")).alias("_own"), F.col(lang).alias("lang"), clean(F.coalesce(F.col(text), F.lit("")), F.col(lang)).alias("text"))
    second = correct_vocabulary(rows, vocabulary, "_own").select("_own", F.col("_own.lang").alias("lang"), F.col("corrected").alias("text"))
    return correct_in_context(second, counts, "_own", **options).select(F.col("_own.key").alias(key), "corrected")
