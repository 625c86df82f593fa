"""Token files of directly addressable codes.

Ids are cut into chunks of CHUNK_BITS. Level 0 has the lowest chunk of every id and a bitmap of the ids that go on;
level 1 has the next chunk of those, and so on. A directory with the number of set bits before each RANK_BITS bits of a
bitmap finds the place of an id in the next level, so any id is read from its chunks alone.

A file is a table of blocks (shard, block, n_docs, n_tokens, payload) in ascending order; a payload has whole documents,
their ids and where they end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.llm.common import partitions_for, saved

CHUNK_BITS = 8
RANK_BITS = 512
BLOCK_TOKENS = 1 << 16
END_ID = 2
CACHED_WORDS = 1_200_000
#: Texts that are encoded together.
TEXTS_AT_ONCE = 2_000
STOPS = b".,!?;:"
#: Texts that a tokenizer of another kind than WordEncoder takes encodes otherwise.
PROBES = ("Two  words.\n", "Don't stop... (AT all)!", "\u00c9t\u00e9 \u00df \u5b57\u3002 12a 3.5", " a\tb ")
MAGIC = b"DAC1"
HEAD = struct.Struct("<4sHHII")
FILE_SCHEMA = "shard int, block int, n_docs int, n_tokens long, payload binary"
DOC_SCHEMA = "doc_id long, shard int, block int, place long, n_tokens long, ids_crc32 long"

_tokenizers: dict = {}


def encode_block(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    """The payload of whole documents: their ids, where each ends, and all token ids in levels."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    levels, rest = [], ids.astype(np.uint32)
    while len(levels) == 0 or len(rest):
        chunk, more = (rest & (2**CHUNK_BITS - 1)).astype(np.uint8), rest >> CHUNK_BITS
        bits = np.packbits(more > 0, bitorder="little")
        ones = np.add.accumulate(np.bitwise_count(bits), dtype=np.uint32)
        before = np.concatenate([np.zeros(1, "<u4"), ones[RANK_BITS // 8 - 1 :: RANK_BITS // 8]]).astype("<u4")
        levels.append(struct.pack("<II", len(chunk), len(before)) + chunk.tobytes() + bits.tobytes() + before.tobytes())
        rest = more[more > 0]
    body = HEAD.pack(MAGIC, CHUNK_BITS, len(levels), len(doc_ids), len(ids)) + known.tobytes() + numbers.tobytes() + np.array(ends, "<u8").tobytes() + b"".join(levels)
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A payload opened for reading; token(i) reads one id, tokens() all of them."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC or zlib.crc32(memoryview(payload)[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a whole block of a token file")
        _, self.chunk_bits, n_levels, n_docs, self.n_tokens = HEAD.unpack_from(payload)
        at = HEAD.size
        known = np.frombuffer(payload, np.uint8, n_docs, at)
        numbers = np.frombuffer(payload, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, numbers)]
        self.ends = np.frombuffer(payload, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 17 * n_docs
        self.levels = []
        for _ in range(n_levels):
            n, n_before = struct.unpack_from("<II", payload, at)
            chunk = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at + 8 + n)
            before = np.frombuffer(payload, "<u4", n_before, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * n_before
            self.levels.append((chunk, bits, before))

    def token(self, i: int) -> int:
        value = 0
        for level, (chunk, bits, before) in enumerate(self.levels):
            value |= int(chunk[i]) << (level * self.chunk_bits)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            ones = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(before[i // RANK_BITS]) + ones
        return value

    def tokens(self) -> np.ndarray:
        rest = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            here[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)] |= rest << np.uint32(self.chunk_bits)
            rest = here
        return rest


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and lower-cases, and whose words are runs of letters, runs of
    digits or runs of other signs, in the byte alphabet of byte-level BPE.

    No token of such a tokenizer spans white space, so a text's ids are those of its words in turn. Words met before are
    kept, until there are more than CACHED_WORDS. New words of letters alone go to the tokenizer's model as they are; a word followed by
    stops is two words to the tokenizer, so it takes what is known of either; all others are encoded as texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.tokenize = self.tokenizer.model.tokenize
        self.tokenizer.model._resize_cache(0)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        for text, ids in zip(PROBES, self.encode([*PROBES], END_ID)):
            if np.frombuffer(ids, "<u4")[:-1].tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{path} is not a tokenizer whose texts can be encoded word by word")

    @staticmethod
    def plain(word: bytes) -> bool:
        """Whether a word is letters that neither normalisation nor lower-casing joins, splits or turns into others."""
        if word.isalpha():
            return True
        try:
            text = word.decode()
            return text.isalpha() and bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    @staticmethod
    def lowered(text: str) -> str:
        """The text, lower-cased where that can't interfere with normalisation or the spelling of special tokens."""
        try:
            text.encode("latin-1")
            return text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            return text

    def _learn(self, words: set[bytes]) -> None:
        known, tokenize, alphabet, others = self.known, self.tokenize, self.alphabet, []
        for word in words:
            if self.plain(word) and (text := word.decode()) == text.lower():
                ids = [t.id for t in tokenize(text if len(text) == len(word) else word.decode("latin-1").translate(alphabet))]
                known[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(word)
        for at in range(0, len(others), 5_000):
            some = others[at : at + 5_000]
            for word, got in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, end_id last. Arrow splits the texts and numbers
        their distinct words, so that Python sees each of these once."""
        split = pc.ascii_split_whitespace(pa.array([self.lowered(t) for t in texts], pa.large_string()))
        numbered = pc.dictionary_encode(split.values)
        words = numbered.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        spelt = list(map(self.known.get, words))
        new = {word for word, ids in zip(words, spelt) if ids is None}
        stopped = {}
        for word in new:
            bare = word.rstrip(STOPS)
            if bare != word and self.plain(bare):
                stopped[word] = bare
        parts = {*stopped.values(), *(w[len(b) :] for w, b in stopped.items())}
        self._learn((new - stopped.keys() | parts) - self.known.keys())
        for word, bare in stopped.items():
            self.known[word] = self.known[bare] + self.known[word[len(bare) :]]
        spelt = [self.known[word] if ids is None else ids for word, ids in zip(words, spelt)]
        of_word, size = np.frombuffer(b"".join(spelt), "<u4"), np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
        starts, at = np.cumsum(size) - size, numbered.indices.to_numpy()
        sizes = size[at]
        ends = np.cumsum(sizes)
        ids = of_word[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(sizes.sum())]
        bounds, end = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist(), struct.pack("<I", end_id)
        return [ids[s:e].tobytes() + end for s, e in zip(bounds, bounds[1:])]


def encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


def write_token_file(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """The blocks of a token file over docs in ascending order of key, nulls first, equal keys by text.

    Null texts are empty and have only end_id. Texts are dealt by ranges of the key and of how the text begins, so a shard
    holds the documents between its neighbours', and rows without a key are dealt to many; there are as many shards as the
    texts have bytes for. A text is never cut, and a block ends with the document that fills it. No rows give no blocks.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, shard, block = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys, ends, held, n = [], [], [], 0
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.iloc[at : at + TEXTS_AT_ONCE]
                for doc_id, ids in zip(some["doc_id"], words.encode(some["text"].tolist(), end_id)):
                    n += len(ids) // 4
                    keys.append(None if pd.isna(doc_id) else int(doc_id))
                    ends.append(n)
                    held.append(ids)
                    if n >= BLOCK_TOKENS:
                        payload = encode_block(keys, ends, np.frombuffer(b"".join(held), "<u4"))
                        yield pd.DataFrame({"shard": [shard], "block": [block], "n_docs": [len(keys)], "n_tokens": [n], "payload": [payload]})
                        block, keys, ends, held, n = block + 1, [], [], [], 0
        if keys:
            payload = encode_block(keys, ends, np.frombuffer(b"".join(held), "<u4"))
            yield pd.DataFrame({"shard": [shard], "block": [block], "n_docs": [len(keys)], "n_tokens": [n], "payload": [payload]})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    # texts in order begin in order, so these ranges keep it
    begins, order = F.substring("text", 1, 64), F.col("doc_id").asc_nulls_first()
    ranged = rows.repartitionByRange(partitions_for(docs.sparkSession, size), order, begins).sortWithinPartitions(order, "text")
    return ranged.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(write, FILE_SCHEMA)


def read_documents(file: DataFrame) -> DataFrame:
    """From the blocks of a token file, for each document: doc_id, start, n_tokens and ids_crc32.

    start counts the ids before the document: of earlier shards, of earlier blocks in its shard, and in its block.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, number, payload in zip(batch["shard"], batch["block"], batch["payload"]):
                block = Block(payload)
                ids, ends = block.tokens().astype("<u4"), block.ends.tolist()
                starts = [0, *ends[:-1]]
                yield pd.DataFrame({"doc_id": pd.array(block.doc_ids, "Int64"), "shard": shard, "block": number, "place": starts, "n_tokens": [e - s for s, e in zip(starts, ends)],
                                    "ids_crc32": [zlib.crc32(ids[s:e]) for s, e in zip(starts, ends)]})

    blocks = file.select("shard", "block", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    in_shard = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    starts = blocks.withColumn("in_shard", in_shard).join(shards, "shard").select("shard", "block", (F.col("in_shard") + F.col("shard_start")).alias("first"))
    docs = file.select("shard", "block", "payload").mapInPandas(read, DOC_SCHEMA)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """read_documents of the token file of docs, after it was written to the shared folder."""
    return read_documents(saved(write_token_file(docs, tokenizer_path, **options)))
