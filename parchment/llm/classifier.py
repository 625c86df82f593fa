"""Quality classifier: vectors of hashed words, pairs of words and character n-grams, averaged per document, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import give_back, without
from parchment.llm.hashing import mix

#: Bounds of the training sample: labelled documents in order of a hash of their id, and their characters together.
MAX_TRAIN_DOCS = 4_000
MAX_TRAIN_CHARS = 16_000_000
BUCKETS = 1 << 17
DIM = 16
EPOCHS = 15
RATE = 0.5
N_GRAMS = (3, 4)
THRESHOLD = 0.3
GROUP_CHARS = 1 << 19
HOLD_OUT = 5
#: Texts whose features are put together in one array.
JOINED = 128
_SPACE = np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """gain: how much each bucket adds to the logit of label 1, bias: what a text without features has."""

    gain: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_CHARS):
                size += len(texts[end]) + 1
                end += 1
            total, count = np.zeros(end - at), np.zeros(end - at)
            for bucket, owner in features(texts[at:end]):
                total += np.bincount(owner, self.gain[bucket], end - at)
                count += np.bincount(owner, minlength=end - at)
            out[at:end] = self.bias + total / np.maximum(count, 1)
            at = end
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, number of the text) of all words, of all pairs of neighbouring words, and of all character n-grams of each
    length. Character n-grams lie in one word, whose ends count as a character each; words and n-grams keep their case."""
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 1 for t in texts), 1])  # the blank before a text is its first
    space = (points == 32) | ((points >= 9) & (points <= 13))
    keep = ~space | np.concatenate([[True], ~space[:-1]])
    points, owner, space = points[keep], owner[keep], space[keep]
    letter = mix((np.where(space, 32, points).astype(np.uint64) + np.uint64(1)) * _STEP)
    inner = np.flatnonzero(~space)
    if not len(inner):
        return
    first = inner[space[inner - 1]]
    lengths = np.flatnonzero(space[1:]) + 1
    lengths = lengths[np.searchsorted(lengths, first)] - first
    place = np.arange(len(inner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    word = mix(np.add.reduceat(letter[inner] * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) ** np.uint64(3), np.cumsum(lengths) - lengths))
    yield (word & np.uint64(BUCKETS - 1)).astype(np.int32), owner[first]
    same = owner[first][1:] == owner[first][:-1]
    yield (mix(word[:-1] * _STEP + word[1:])[same] & np.uint64(BUCKETS - 1)).astype(np.int32), owner[first][1:][same]
    for n in N_GRAMS:
        if len(points) < n:
            return
        value, inside = letter[: len(letter) - n + 1].copy(), np.ones(len(letter) - n + 1, bool)
        for i in range(1, n):
            value = value * _STEP + letter[i : len(letter) - n + 1 + i]
            if i < n - 1:
                inside &= ~space[i : len(letter) - n + 1 + i]
        yield (mix(value[inside] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32), owner[1 : len(letter) - n + 2][inside]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 0) -> Model:
    """A model trained on the texts in a shuffled order, one at a time. Without texts all scores are 0.5; with one
    class alone they are all near that class."""
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    parts, some, ends = [], [], []
    for k, text in enumerate(texts):
        got = [bucket for bucket, _ in features([text])]
        ids, counts = np.unique(np.concatenate(got) if got else np.zeros(0, np.int32), return_counts=True)
        some.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
        ends.append(len(ids))
        if len(some) == JOINED or k == len(texts) - 1:  # a few large arrays, not thousands of small ones
            parts.append([np.concatenate(x) for x in zip(*some)])
            some.clear()
    all_ids, all_shares = (np.concatenate(x) for x in zip(*parts))
    ends, parts = np.cumsum(ends).tolist(), None
    random = np.random.default_rng(seed)
    embed = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    top, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    left, total = 0, epochs * len(texts)
    for _ in range(epochs):
        for i in random.permutation(len(texts)):
            own = slice(ends[i - 1] if i else 0, ends[i])
            ids, share = all_ids[own], all_shares[own]
            hidden = share @ embed[ids]
            odds = hidden @ top + bias
            chance = np.exp(odds - odds.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            step = rate * (1 - left / total)
            back = top @ chance
            top -= step * np.outer(hidden, chance)
            bias -= 0.1 * step * chance
            # each vector moves by the mean gradient over the text's features, scaled up as most features are rare
            embed[ids] -= np.outer(np.minimum(share * len(ids), 4.0), step * back)
            left += 1
    return Model((embed @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: Column, of: int = HOLD_OUT) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """A model of `label` from rows of labels that aren't held out and whose text is in docs.

    At most max_docs documents of max_chars characters in all go to the driver, the first by a hash of doc_id; a text
    that would pass the bound is left out of the sample, whole. Several labels of a document count as their mean; null
    labels and texts are not used.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    texts = docs.where("text is not null").select("doc_id", F.length("text").alias("n"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n")]
    chosen, size = [], 0
    for row in texts.join(known, "doc_id").orderBy(*order).limit(max_docs).select("doc_id", "n", "y").collect():
        if size + row["n"] <= max_chars:
            size += row["n"]
            chosen.append((row["doc_id"], row["n"], row["y"]))
    if not chosen:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, n int, y int").distinct()
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").where(F.length("text") == F.col("n"))
    rows = sorted(found.select("doc_id", "text", "y").collect(), key=lambda r: (r["doc_id"], r["text"]))
    model = fit([r["text"] for r in rows], [r["y"] for r in rows])
    del rows
    give_back()  # the driver, too, goes on with other work
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted. Null and empty texts get the score of a text without features; whole
    texts are scored, each row for itself. Columns of docs with these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model.gain, model.bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*sent.value)
        for some in texts:
            yield pd.Series(own.scores(some.tolist()))

    rows = without(docs, "held_out", "score", "predicted")
    return rows.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(F.coalesce("text", F.lit("")))}).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
