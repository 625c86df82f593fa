"""Document fingerprints: content-defined chunks cut by a gear hash, their digests weighted by length."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import shuffle_partitions
from parchment.llm.hashing import mix

#: Bytes of a chunk: at least, about, at most. Before NORMAL a boundary needs HARD_BITS zero bits, after it EASY_BITS.
LEAST, NORMAL, MOST = 16, 64, 256
HARD_BITS, EASY_BITS = 8, 4
DIGEST_BYTES = 6
SCHEMA = """doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
near_edited double, near_next double"""
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte] after each byte; 32 bits, so the last 32 bytes decide it. Sums over twice
    as many bytes are made from two sums, in five steps."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h


def boundaries(data: bytes) -> list[int]:
    """The ends of the chunks, with fewer cuts before the normal length and more after it."""
    if len(data) <= LEAST:
        return [len(data)] if data else []
    h = gear_hashes(data)
    easy = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = (easy[h[easy] >> np.uint32(32 - HARD_BITS) == 0] + 1).tolist()
    easy, ends, at, n = (easy + 1).tolist(), [], 0, len(data)
    hard.append(n + MOST)
    easy.append(n + MOST)
    while n - at > LEAST:
        cut = hard[bisect_left(hard, at + LEAST)]
        if cut >= at + NORMAL:
            cut = easy[bisect_left(easy, at + NORMAL)]
        at = min(cut, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> dict[str, int]:
    """Length in bytes by digest of each distinct chunk of a text."""
    data, at, found = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in boundaries(data):
        chunk = data[at:end]
        found[hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).hexdigest()] = end - at
        at = end
    return found


def as_string(chunks: dict[str, int]) -> str:
    """Digest and length of each chunk, in order of digest; 12 and 3 hex digits a chunk."""
    return "".join([f"{d}{chunks[d]:03x}" for d in sorted(chunks)])


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's chunks, by length, that b has too. An empty text is contained in an empty one alone."""
    if not a:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def edit(text: str, following: str) -> str:
    """text with its last half replaced by as many code points of the following text, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(docs: Iterator[tuple[str | None, str]]) -> Iterator[tuple]:
    """A row for each document of a run but the last, which only follows."""
    doc_id, text = next(docs)
    own = fingerprint(text)
    for next_id, following in docs:
        edited, after = edit(text, following), fingerprint(following)
        changed = fingerprint(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        yield doc_id, len(text), digest, as_string(own), as_string(changed), containment(own, changed), containment(own, after)
        doc_id, text, own = next_id, following, after


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs.

    Null texts are empty. The next document is the next row in ascending order of doc_id, nulls first, rows of one
    doc_id by text; after the last row comes the first, and a single row follows itself. Other columns are not looked at.

    Rows are dealt by ranges of doc_id whose first ids are quantiles of all ids. The first row of a range also goes to the
    range before it, so each task reads its documents once in order, two at a time, and no text is joined.
    """
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("sort_id"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * shuffle_partitions(docs.sparkSession)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("sort_id"))
    cuts = ids.agg(F.percentile_approx("sort_id", [i / n for i in range(n)], 100 * n).alias("cuts"), F.min("sort_id").alias("least")).first()
    if cuts["least"] is None:
        return docs.sparkSession.createDataFrame([], SCHEMA.replace("doc_id string", "doc_id long"))
    firsts = np.unique(np.array([cuts["least"], *cuts["cuts"]], np.int64))

    @F.pandas_udf("array<int>")
    def ranges(sort_ids: pd.Series) -> pd.Series:
        """The range of each id, and the one before it if the id is the first of its range."""
        own = np.searchsorted(firsts, sort_ids.to_numpy(), "right") - 1
        first = firsts[own] == sort_ids.to_numpy()
        return pd.Series([[r, (r - 1) % len(firsts)] if f else [r] for r, f in zip(own.tolist(), first.tolist())])

    dealt = rows.select("*", F.posexplode(ranges("sort_id")).alias("follows", "range"))
    together = dealt.repartition(shuffle_partitions(docs.sparkSession), "range").sortWithinPartitions("range", "follows", "sort_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch["range"].tolist(), batch["follows"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist())

        rest, held = flat(), []
        ahead = next(rest, None)
        while ahead is not None:
            here = ahead[0]

            def one_range() -> Iterator[tuple[str | None, str]]:
                """The range's rows and the first of those that follow; the others are passed over."""
                nonlocal ahead
                followed = False
                while ahead is not None and ahead[0] == here:
                    if not followed:
                        yield ahead[2], ahead[3]
                    followed = followed or ahead[1] == 1
                    ahead = next(rest, None)

            for row in _rows(one_range()):
                held.append(row)
                if len(held) >= 500:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    names = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(",")]
    found = together.select("range", "follows", "doc_id", "text").mapInPandas(run, SCHEMA)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
