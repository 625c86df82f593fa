"""Language identification by a trained model: naive Bayes over hashed character n-grams.

Counting is a groupBy of all n-grams of whole texts, whose partial sums leave a task few rows; the model is a table of at most
`buckets` rows with a weight for each language, and scoring adds weights up, so a document leaves a task as one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import ngrams

N, BUCKETS, SMOOTHING = 3, 1 << 18, 0.5
MULTIPLIER = 1_000_003
#: Languages that a model may have, and bytes of weights up to which it is broadcast.
MOST_LANGUAGES, MOST_BROADCAST = 1024, 256 << 20


def bucket_of(gram: Column, n: int = N, buckets: int = BUCKETS) -> Column:
    """The bucket of an n-gram: a polynomial of its code points, of which shorter grams have fewer."""
    value = F.lit(0).cast("long")
    for i in range(n):
        letter = F.substr(gram, F.lit(i + 1), F.lit(1))
        value = F.when(letter == "", value).otherwise((value * MULTIPLIER + F.ascii(letter)) % (1 << 40))
    return (value % buckets).cast("int")


def hashed(text: Column, n: int = N, short: bool = True) -> Column:
    """The n-grams of a text in lower case; none of null. A shorter text is its own one, or has none unless `short`."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return ngrams(lowered if short else F.when(F.length(lowered) >= n, lowered).otherwise(""), n)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = N, buckets: int = BUCKETS, short: bool = True) -> DataFrame:
    """(lang, bucket, n): how often the n-grams of each bucket occur in the texts of each language. Rows without a language are
    left out; repeated rows count each. Distinct n-grams are hashed, not every one."""
    grams = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(hashed(F.col(text), n, short)).alias("gram"))
    distinct = grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("lang", bucket_of(F.col("gram"), n, buckets).alias("bucket")).agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """weights: (bucket, weights), for each language in turn what an n-gram of the bucket adds beyond one never met; languages: (name,
    log of its share of the documents, log probability of an n-gram never met); short: whether a text shorter than n is an n-gram."""

    weights: DataFrame
    languages: list[tuple[str, float, float]]
    n: int = N
    buckets: int = BUCKETS
    short: bool = True


def train(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = N, buckets: int = BUCKETS, smoothing: float = SMOOTHING, short: bool = True) -> LanguageModel:
    """A model of the languages that docs name. Every language is smoothed alike. Without any language a model answers null."""
    counts = gram_counts(docs, text, lang, n, buckets, short)
    shares = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("docs"))
    sums = shares.join(counts.groupBy("lang").agg(F.sum("n").alias("n")), "lang", "left").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sums) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    all_docs = sum(r["docs"] for r in sums)
    languages = [(r["lang"], log(r["docs"] / all_docs), log(smoothing / ((r["n"] or 0) + smoothing * buckets))) for r in sums]
    name = {x[0]: F.sum(F.when(F.col("lang") == x[0], F.col("n"))) for x in languages}
    weights = counts.groupBy("bucket").agg(F.array(*[F.coalesce(F.log((c + smoothing) / smoothing), F.lit(0.0)) for c in name.values()]).alias("weights"))
    return LanguageModel(weights, languages, n, buckets, short)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", top: int = 3) -> DataFrame:
    """docs with languages, the `top` likeliest ones with their probabilities in descending order (ties by name), and language and
    confidence of the first. Null and empty texts get the shares of the languages among the training documents."""
    # equal texts have equal answers, so rows and sums meet by the text's digest, whatever the order in which rows come
    rows = docs.withColumn("_text", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    if not model.languages:
        nothing = F.lit(None).cast("array<struct<language:string,confidence:double>>")
        return docs.withColumns({"languages": nothing, "language": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    weights = F.broadcast(model.weights) if model.buckets * len(model.languages) * 8 <= MOST_BROADCAST else model.weights
    grams = rows.select("_text", F.posexplode(hashed(F.col(text), model.n, model.short)).alias("pos", "gram")).select("_text", "pos", bucket_of(F.col("gram"), model.n, model.buckets).alias("bucket"))
    copies = F.count_if(F.col("pos") == 0)
    added = [(F.sum(F.col("weights")[i]) / copies).alias(f"_s{i}") for i in range(len(model.languages))]
    sums = grams.join(weights, "bucket", "left").groupBy("_text").agg((F.count(F.lit(1)) / copies).alias("_n"), *added)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scores = [(name, prior + zero(F.col("_n")) * unmet + zero(F.col(f"_s{i}"))) for i, (name, prior, unmet) in enumerate(model.languages)]
    best = F.greatest(*[s for _, s in scores]) if len(scores) > 1 else scores[0][1]
    scored = rows.join(sums, "_text", "left").withColumn("_best", best)
    likely = F.array(*[F.struct(F.exp(s - F.col("_best")).alias("p"), F.lit(x).alias("language")) for x, s in scores])
    ranked = F.array_sort(likely, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["language"] < b["language"], -1).otherwise(1))
    whole = F.aggregate("_ranked", F.lit(0.0), lambda acc, x: acc + x["p"])
    out = scored.withColumn("_ranked", ranked).withColumn("_all", whole)
    languages = F.slice(F.transform("_ranked", lambda x: F.struct(x["language"].alias("language"), (x["p"] / F.col("_all")).alias("confidence"))), 1, top)
    first = F.element_at("languages", 1)
    return out.withColumn("languages", languages).select(*docs.columns, "languages", first["language"].alias("language"), first["confidence"].alias("confidence"))
