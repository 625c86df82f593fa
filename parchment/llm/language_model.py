"""LM scoring: quantised n-gram counts in log-frequency Bloom filters, and the exact add-one base score.

Counts are quantised to levels that begin at STARTS. An n-gram of level q is in the filter under each level up to q, so
the longest run of levels that the filter affirms gives its level back. The whole filter grows with the corpus, so it
isn't broadcast: it is a table with as many segments as the corpus needs, each a bounded number of bits. Learning counts
the distinct n-grams of chunks of training texts, by segment, and writes that table. Scoring sends the distinct n-grams of
a chunk to the segments that their hashes name, where nothing but the stored bits is asked for their levels; these come
back in the order of the hashes. So a stored model scores documents that it wasn't built from. The exact counts of words
lie beside the bits for the base score alone. No count is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import partitions_for, saved
from parchment.llm.hashing import grouped, mix, word_hashes

HOLD_OUT, HELD = 7, 2
BITS_PER_ITEM = 12
PROBES = 6
#: The least count of each level: 1, 2, 3, 4, 6, 8, 12, ...
STARTS = np.array(sorted({1} | {2**k for k in range(1, 45)} | {3 * 2**k for k in range(44)}), np.int64)
LEVELS = len(STARTS)
#: Weights of the bigram from which leave-one-out chooses one.
WEIGHTS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Bytes of text that are scored together.
CHUNK_BYTES = 8 << 20
#: Bytes of text for each segment of the filter, of which there are LEAST_SEGMENTS at least.
SEGMENT_BYTES = 24 << 20
LEAST_SEGMENTS = 256
#: N-grams that a segment is asked for at once.
ASKED_AT_ONCE = 1 << 18

WORD, PAIR, TEXTS = 0, 1, 2
END = np.uint64(0xE5D00000000000E5)
START = np.uint64(0x57A7000000000057)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = (np.uint64(0x1B873593CC9E2D51), np.uint64(0x2545F4914F6CDD1D))
CHUNK_SCHEMA = "g long, size long, doc_ids array<string>, held array<boolean>, lengths array<int>, texts binary"
LEARN_SCHEMA = "kind int, segment int, g long, hashes binary, counts binary, large binary"
#: A segment of the filter; how many n-grams of each level it has and how often they occur; and exact counts of its words.
FILTER_SCHEMA = "kind int, segment int, top int, bits binary, types binary, times binary, words binary, counts binary, large binary"
ASK_SCHEMA = "kind int, segment int, g long, hashes binary"
ANSWER_SCHEMA = "g long, kind int, segment int, levels binary, counts binary, large binary"
SCORE_SCHEMA = "doc_id string, held_out boolean, n_tokens long, n_known long, logs double, scores array<double>, left_out array<double>"


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % HOLD_OUT == HELD


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, A-Z lower-cased, and of its end; and how many tokens each text has."""
    parts = [word_hashes([t.lower() for t in some]) for some in grouped(texts)]
    counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in parts]])
    return np.insert(np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in parts]]), np.cumsum(counts), END), counts + 1


def pairs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it, and whether it is the first of its text, which follows START."""
    before, first = np.roll(hashes, 1), np.zeros(len(hashes), bool)
    first[np.cumsum(counts) - counts] = True
    before[first] = START
    return mix(before * _ODD + hashes), first


def short(hashes: np.ndarray, kind: int) -> np.ndarray:
    """What is kept of a hash: all of it for words, the upper 48 bits for bigrams."""
    return hashes if kind == WORD else hashes >> np.uint64(16)


def distinct_ngrams(hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What is kept of the distinct words, then of the distinct bigrams, in order, and the place of each token's among them."""
    for kind, found in ((WORD, hashes), (PAIR, pairs(hashes, counts)[0])):
        yield np.unique(short(found, kind), return_inverse=True)


def _segment(hashes: np.ndarray, kind: int, segments: int) -> np.ndarray:
    bits = segments.bit_length() - 1
    return (hashes >> np.uint64((64 if kind == WORD else 48) - bits)).astype(np.int64)


def _pack(hashes: np.ndarray, kind: int) -> bytes:
    """8 bytes for words; 5 for bigrams, without the upper eight bits, which the segment has."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if kind == WORD else 5].tobytes()


def _unpack(data: bytes, kind: int, segment: int, segments: int) -> np.ndarray:
    if kind == WORD:
        return np.frombuffer(data, "<u8")
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    wide[:, 5] = segment * LEAST_SEGMENTS // segments
    return wide.view("<u8").ravel()


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count, and eight for each of those that a byte can't hold."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes()


def _unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<i8")
    return counts


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count, -1 for 0."""
    return np.searchsorted(STARTS, counts, "right") - 1


@dataclass
class Filter:
    """A log-frequency Bloom filter of some n-grams of one kind: its bits, eight to a byte, and its highest level."""

    kind: int
    top: int
    bits: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, kind: int) -> Filter:
        level = level_of(counts)
        made = cls(kind, int(level.max(initial=-1)), np.zeros(max(8, int((level + 1).sum()) * BITS_PER_ITEM // 8 + 1), np.uint8))
        ones = np.zeros(8 * len(made.bits), bool)
        for l in range(made.top + 1):
            for at in made._places(hashes[level >= l], l):
                ones[at] = True
        made.bits = np.packbits(ones, bitorder="little")
        return made

    def _places(self, hashes: np.ndarray, level: int) -> Iterator[np.ndarray]:
        x = mix((hashes ^ _SALT[self.kind]) + np.array([level + 1], np.uint64) * _ODD)
        step = mix(x) | np.uint64(1)
        for _ in range(PROBES):
            yield x % np.uint64(8 * len(self.bits))
            x = x + step

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each hash as far as the filter tells, -1 if it isn't there."""
        level, alive = np.full(len(hashes), -1, np.int8), np.arange(len(hashes))
        for l in range(self.top + 1):
            there = np.ones(len(alive), bool)
            for at in self._places(hashes[alive], l):
                there &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[there]
            if not len(alive):
                break
            level[alive] = l
        return level


def chunked(rows: DataFrame) -> DataFrame:
    """CHUNK_SCHEMA: the rows (doc_id, text, held_out) in chunks of about CHUNK_BYTES of compressed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pd.DataFrame:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pd.DataFrame({"g": [g], "size": [size], "doc_ids": [ids], "held": [held], "lengths": [[len(t) for t in texts]], "texts": [data]})

        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"], batch["text"], batch["held_out"]):
                text = text.encode()
                if texts and size + len(text) > CHUNK_BYTES:
                    yield flush()
                    g, ids, held, texts, size = g + 1, [], [], [], 0
                ids.append(doc_id)
                held.append(bool(out))
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return rows.select("doc_id", "text", "held_out").mapInPandas(run, CHUNK_SCHEMA)


def texts_of(lengths: np.ndarray, data: bytes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(lengths).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def by_segment(distinct: np.ndarray, kind: int, segments: int) -> Iterator[tuple[int, slice]]:
    """The segments of hashes in order, and which of the hashes each has."""
    at = _segment(distinct, kind, segments)
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(distinct)]):
        yield int(at[a]), slice(a, b)


def learn(chunks: DataFrame, segments: int) -> DataFrame:
    """LEARN_SCHEMA: the distinct n-grams of the training texts of each chunk by kind and segment, with their counts."""
    names = [c.split()[0] for c in LEARN_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, held, lengths, data in batch.itertuples(index=False, name=None):
                hashes, n_tokens = tokens([t for t, out in zip(texts_of(lengths, data), held) if not out])
                rows = []
                for kind, (distinct, back) in enumerate(distinct_ngrams(hashes, n_tokens)):
                    counts = np.bincount(back, minlength=len(distinct))
                    rows += [(kind, n, g, _pack(distinct[own], kind), *_pack_counts(counts[own])) for n, own in by_segment(distinct, kind, segments)]
                yield pd.DataFrame(rows, columns=names)

    return chunks.select("g", "held", "lengths", "texts").mapInPandas(run, LEARN_SCHEMA)


def filters(learnt: DataFrame, segments: int) -> DataFrame:
    """FILTER_SCHEMA: a row for each segment of learnt, which has all rows of a kind and segment side by side."""
    names = [c.split()[0] for c in FILTER_SCHEMA.split(", ")]

    def flush(kind: int, segment: int, rows: list[tuple]) -> pd.DataFrame:
        hashes = np.concatenate([_unpack(h, kind, segment, segments) for h, _, _ in rows])
        counts = np.concatenate([_unpack_counts(c, large) for _, c, large in rows])
        order = np.argsort(hashes)
        hashes, first = hashes[order], np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
        distinct, total = hashes[first], np.add.reduceat(counts[order], np.flatnonzero(first))
        made, true = Filter.of(distinct, total, kind), level_of(total)
        types, times = np.bincount(true, minlength=LEVELS).astype("<i8"), np.bincount(true, total, LEVELS).astype("<i8")
        exact = (_pack(distinct, kind), *_pack_counts(total)) if kind == WORD else (b"", b"", b"")
        return pd.DataFrame([(kind, segment, made.top, made.bits.tobytes(), types.tobytes(), times.tobytes(), *exact)], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for kind, segment, _, *row in batch.itertuples(index=False, name=None):
                if at != (kind, segment):
                    if held:
                        yield flush(*at, held)
                    at, held = (kind, segment), []
                held.append(tuple(row))
        if held:
            yield flush(*at, held)

    return learnt.mapInPandas(run, FILTER_SCHEMA)


def statistics(stored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams of each kind and level there are, and how often they occur together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        types, times = np.zeros((2, LEVELS), np.int64), np.zeros((2, LEVELS), np.int64)
        for batch in batches:
            for kind, some, often in batch.itertuples(index=False, name=None):
                types[kind] += np.frombuffer(some, "<i8")
                times[kind] += np.frombuffer(often, "<i8")
        yield pd.DataFrame({"kind": np.repeat([0, 1], LEVELS), "level": np.tile(np.arange(LEVELS), 2), "types": types.ravel(), "times": times.ravel()})

    rows = stored.select("kind", "types", "times").mapInPandas(run, "kind int, level int, types long, times long")
    types, times = np.zeros((2, LEVELS), np.int64), np.zeros((2, LEVELS), np.int64)
    for r in rows.groupBy("kind", "level").agg(F.sum("types").alias("types"), F.sum("times").alias("times")).where("types > 0").collect():
        types[r["kind"], r["level"]], times[r["kind"], r["level"]] = r["types"], r["times"]
    return types, times


def ask(chunks: DataFrame, segments: int) -> DataFrame:
    """ASK_SCHEMA: the distinct n-grams of all texts of each chunk by kind and segment."""
    names = [c.split()[0] for c in ASK_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, lengths, data in batch.itertuples(index=False, name=None):
                rows = []
                for kind, (distinct, _) in enumerate(distinct_ngrams(*tokens(texts_of(lengths, data)))):
                    rows += [(kind, n, g, _pack(distinct[own], kind)) for n, own in by_segment(distinct, kind, segments)]
                yield pd.DataFrame(rows, columns=names)

    return chunks.select("g", "lengths", "texts").mapInPandas(run, ASK_SCHEMA)


def probe(asked: DataFrame, stored: DataFrame, segments: int, n_partitions: int) -> DataFrame:
    """ANSWER_SCHEMA: for each row of asked, in the order of its hashes, the levels that the stored bits of its segment
    affirm, and the exact counts of words. A segment without bits knows none."""
    names = [c.split()[0] for c in ANSWER_SCHEMA.split(", ")]

    def answers(held: Filter, words: np.ndarray, counts: np.ndarray, segment: int, rows: list[tuple]) -> pd.DataFrame:
        hashes = [_unpack(h, held.kind, segment, segments) for _, h in rows]
        levels, out, at = held.levels(np.concatenate(hashes)), [], 0
        for (g, _), own in zip(rows, hashes):
            place = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
            exact = np.where(words[place] == own, counts[place], 0) if len(words) else np.zeros(len(own), np.int64)
            out.append((g, held.kind, segment, levels[at : at + len(own)].tobytes(), *(_pack_counts(exact) if held.kind == WORD else (b"", b""))))
            at += len(own)
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, n, known = None, [], 0, ()
        for batch in batches:
            for kind, segment, g, hashes, top, bits, words, counts, large in batch.itertuples(index=False, name=None):
                if held and (at != (kind, segment) or n > ASKED_AT_ONCE):
                    yield answers(*known, at[1], held)
                    held, n = [], 0
                if at != (kind, segment):
                    at, known = (kind, segment), (Filter(kind, -1, np.zeros(8, np.uint8)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if bits is not None:
                    known = Filter(kind, int(top), np.frombuffer(bits, np.uint8)), np.frombuffer(words, "<u8"), _unpack_counts(counts, large)
                else:
                    held.append((g, hashes))
                    n += len(hashes) // 5
        if held:
            yield answers(*known, at[1], held)

    both = asked.unionByName(stored.drop("types", "times"), allowMissingColumns=True).select("kind", "segment", "g", "hashes", "top", "bits", "words", "counts", "large")
    # rows without g, which hold the bits, come first
    return both.repartition(n_partitions, "kind", "segment").sortWithinPartitions("kind", "segment", F.asc_nulls_first("g")).mapInPandas(run, ANSWER_SCHEMA)


@dataclass
class Model:
    """Chances from levels. A word has its discounted share of all tokens; what discounting frees is shared evenly by as
    many unseen words as there seem to be. A bigram's share is its level's least count over the most that its first word's
    level allows, so the shares of a first word sum to one at most; it is mixed with the chance of the word alone. But
    for false positives of the filter, all words and unseen words together have a chance of one at most."""

    #: How often a word of each level occurs on average.
    mean: np.ndarray
    n: int
    n_words: int
    n_texts: int
    discount: float
    n_unseen: float

    @classmethod
    def of(cls, types: np.ndarray, times: np.ndarray, n_texts: int) -> Model:
        once, twice = int(types[WORD, 0]), int(types[WORD, 1])
        n_words = int(types[WORD].sum())
        discount = max(once / (once + 2 * (twice + 1)), 1 / (n_words + 1))
        mean = times[WORD] / np.maximum(types[WORD], 1)
        rarest = float(mean[mean > 0].min(initial=np.inf))
        # as many as Chao's lower bound says, and enough for none to be likelier than the rarest words that were seen
        unseen = max(1.0, once * (once - 1) / (2 * (twice + 1)), discount * n_words / (rarest - discount))
        return cls(mean, int(times[WORD].sum()), n_words, n_texts, discount, unseen)

    def alone(self, seen: np.ndarray, less: int = 0) -> np.ndarray:
        """The chance of words of these levels, had each occurred `less` times less."""
        if not self.n:
            return np.ones(len(seen))
        unseen = self.discount * self.n_words / self.n / self.n_unseen
        count = np.where(seen > 0 if less else seen >= 0, self.mean[seen] - less, 0.0)
        return np.where(count > 0, (count - self.discount) / self.n, unseen)

    def share(self, both: np.ndarray, before: np.ndarray, first: np.ndarray, less: int = 0) -> np.ndarray:
        """The share of bigrams of these levels in the count of their first words, -1 where that hasn't been seen."""
        most = np.where(first, self.n_texts, np.where(before >= 0, STARTS[np.minimum(before.astype(np.int64) + 1, LEVELS - 1)] - 1, 0)) - less
        least = np.where(both >= 0, STARTS[both] - less, 0)
        return np.where(most > 0, np.minimum(1.0, least / np.maximum(most, 1)), -1.0)

    def chances(self, seen: np.ndarray, both: np.ndarray, before: np.ndarray, first: np.ndarray, less: int = 0) -> Iterator[np.ndarray]:
        """The chance of each token for each of WEIGHTS."""
        alone, share = self.alone(seen, less), self.share(both, before, first, less)
        for weight in WEIGHTS:
            yield np.where(share >= 0, weight * share + (1 - weight) * alone, alone)


def score_chunks(chunks: DataFrame, answers: DataFrame, model: Model, n_partitions: int) -> DataFrame:
    """SCORE_SCHEMA for each text of the chunks; logs sums log10(c + 1) of its tokens, scores has its score for each of
    WEIGHTS, and one row a chunk has left_out: the same over the training texts with every token left out of the counts."""

    def score(rows: list[tuple]) -> pd.DataFrame:
        _, _, ids, held, lengths, data = next(r for r in rows if r[0] == TEXTS)[:6]
        levels = [np.frombuffer(b"".join(r[6] for r in rows if r[0] == kind), np.int8) for kind in (WORD, PAIR)]
        exact = np.concatenate([_unpack_counts(r[7], r[8]) for r in rows if r[0] == WORD])
        hashes, n_tokens = tokens(texts_of(lengths, data))
        (_, word), (_, pair) = distinct_ngrams(hashes, n_tokens)
        begin, first = np.cumsum(n_tokens) - n_tokens, pairs(hashes, n_tokens)[1]
        seen, both = levels[WORD][word], levels[PAIR][pair]
        before = np.roll(seen, 1)
        sums = np.stack([np.add.reduceat(np.log10(c), begin) for c in model.chances(seen, both, before, first)], axis=1)
        learnt = np.repeat(~np.asarray(held, bool), n_tokens)
        left_out = [float(np.log10(c).sum()) for c in model.chances(seen[learnt], both[learnt], before[learnt], first[learnt], 1)]
        return pd.DataFrame({
            "doc_id": ids, "held_out": np.asarray(held, bool), "n_tokens": n_tokens, "n_known": np.add.reduceat((exact > 0).astype(np.int64)[word], begin),
            "logs": np.add.reduceat(np.log10(exact + 1.0)[word], begin), "scores": list(sums), "left_out": [left_out] + [None] * (len(ids) - 1),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for g, *row in batch.itertuples(index=False, name=None):
                if g != at and held:
                    yield score(held)
                    held = []
                at = g
                held.append(tuple(row))
        if held:
            yield score(held)

    texts = chunks.drop("size").withColumns({"kind": F.lit(TEXTS), "segment": F.lit(0)})
    both = texts.unionByName(answers, allowMissingColumns=True)
    both = both.select("g", "kind", "segment", "doc_ids", "held", "lengths", "texts", "levels", "counts", "large")
    return both.repartition(n_partitions, "g").sortWithinPartitions("g", "kind", "segment").mapInPandas(run, SCORE_SCHEMA)


@dataclass
class Stored:
    """A model that scores any documents: the table of the filter's segments, their number, what chances are made from,
    and which of WEIGHTS the bigram has (None: not chosen yet)."""

    filters: DataFrame
    segments: int
    model: Model
    weight: int | None = None


def _chunks(docs: DataFrame, held: Column) -> tuple[DataFrame, int]:
    """The texts of docs in chunks, null ones as empty ones, and how many bytes they have."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    chunks = saved(chunked(rows))
    return chunks, chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _learnt(chunks: DataFrame, size: int, path: str | None) -> Stored:
    """The filter of the training texts of chunks, written to path or to the shared folder, without a weight."""
    spark, segments = chunks.sparkSession, LEAST_SEGMENTS
    while segments * SEGMENT_BYTES < size:
        segments *= 2
    met = learn(chunks, segments).repartition(partitions_for(spark, size), "kind", "segment").sortWithinPartitions("kind", "segment", "g")
    made = filters(met, segments)
    if path:
        made.write.parquet(f"{path}/filters")
    stored = spark.read.schema(FILTER_SCHEMA).parquet(f"{path}/filters") if path else saved(made)
    n_texts = chunks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h)).cast("long")), F.lit(0))).first()[0]
    return Stored(stored, segments, Model.of(*statistics(stored), n_texts))


def _scored(chunks: DataFrame, size: int, stored: Stored) -> DataFrame:
    n_partitions = partitions_for(chunks.sparkSession, size)
    answers = saved(probe(ask(chunks, stored.segments), stored.filters, stored.segments, n_partitions))
    return saved(score_chunks(chunks, answers, stored.model, n_partitions))


def _likeliest(scored: DataFrame) -> int:
    """The place of the weight under which the training texts are likeliest with each token left out of the counts."""
    sums = scored.where("left_out is not null").select(F.posexplode("left_out").alias("i", "sum")).groupBy("i").agg(F.sum("sum").alias("sum"))
    best = sums.orderBy(F.desc("sum"), "i").first()
    return best["i"] if best else 0


def _result(scored: DataFrame, stored: Stored) -> DataFrame:
    model = stored.model
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.n_words + 1)))).alias("base_score"),
        F.get("scores", F.lit(stored.weight)).alias("score"), F.lit(WEIGHTS[stored.weight]).alias("bigram_weight"),
    )


def fit(docs: DataFrame, path: str) -> Stored:
    """A model that learns from all rows of docs (doc_id, text), written to the folder path, which all executors share and
    which must not hold a model yet. Null texts are empty; repeated rows are texts of their own; of no rows it learns
    nothing, and every token has chance one."""
    chunks, size = _chunks(docs, F.lit(False))
    made = _learnt(chunks, size, path)
    made = replace(made, weight=_likeliest(_scored(chunks, size, made)))
    about = docs.sparkSession.createDataFrame([(made.segments, made.model.n_texts, made.weight)], "segments int, n_texts long, weight int")
    about.write.parquet(f"{path}/about")
    return made


def load(spark: SparkSession, path: str) -> Stored:
    """The model that fit() wrote to path."""
    stored, about = spark.read.schema(FILTER_SCHEMA).parquet(f"{path}/filters"), spark.read.parquet(f"{path}/about").first()
    return Stored(stored, about["segments"], Model.of(*statistics(stored), about["n_texts"]), about["weight"])


def score(docs: DataFrame, stored: Stored) -> DataFrame:
    """What score_documents returns, for documents that a stored model needn't have seen; all count as held out. Null texts
    are empty and have one token; repeated rows are scored alike; an empty table gives an empty result."""
    chunks, size = _chunks(docs, F.lit(True))
    return _result(_scored(chunks, size, stored), stored)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bigram_weight of each row of docs (doc_id, text).

    The model learns from the documents that aren't held out. Words are told apart by 64-bit hashes. The base score takes
    exact counts; score is the model's log10 probability of the text, from the filter's levels alone, whose bigram weight is
    the one of WEIGHTS under which the training texts are likeliest with each token left out of the counts. Null texts are
    empty and have one token, the end. Repeated rows are texts of their own; without training texts every token has chance
    one. An empty table gives an empty result; other columns are not looked at.
    """
    chunks, size = _chunks(docs, held_out(F.col("doc_id")))
    stored = _learnt(chunks, size, None)
    scored = _scored(chunks, size, stored)
    return _result(scored, replace(stored, weight=_likeliest(scored)))
