"""Source divergence audit: how far the terms of each source lie from those of its language and of its other sources.

A term is a run of ASCII letters and of other characters beyond ASCII, A-Z as a-z. A table of 256 bytes says which bytes of
the texts' UTF-8 buffers belong to terms; the slices between boundaries are grouped by xxhash, and every slice is compared
with the first one of its group byte by byte, so that a collision splits the group. A task sums the terms of all its texts
before anything is shuffled. The terms of a language are then dealt by hash to blocks of a bounded size; a block holds its
terms as a CSR matrix (sources by terms), and a source's part of a divergence is a sum by reduceat over the rows of it.
All arithmetic is in integers of 64 bits, exact for up to 9 * 10**15 term occurrences in a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.llm.common import saved

#: A language's term is kept if so many of its documents have it.
LEAST_DOCS = 10
SCALE_STEPS = (1000, 1000, 1000)  # 10**9 in factors that keep a division's remainders within 64 bits
TOP_TERMS = 10
#: Texts are split together until they have so many bytes; a longer one is split alone.
CHUNK_BYTES = 4 << 20
#: Slices that are compared at a time.
COMPARED = 1 << 17
#: Sums that a task holds before it merges them, and sends them on if that leaves more than half as many.
HELD_ROWS = 2_000_000
#: Bounds of a block's entries; between them it has as many as there are pairs of sources, so that blocks add few sums of pairs.
LEAST_BLOCK, MOST_BLOCK = 1 << 18, 1 << 22
#: Languages up to which their numbers are broadcast.
MAX_BROADCAST_LANGS = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

COUNT_SCHEMA = "lang string, source string, term binary, count long, docs long"
_SUMS = pa.schema([("group", pa.int64()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])

digest = xxhash.xxh3_64_intdigest


def boundaries(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of texts start and end that stand in data one after the other, the k-th up to ends[k]. No term goes
    from one text into the next."""
    solid = _LETTER[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, the same for equal ones alone, and the place among the slices of the first of each number."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, unlike = ends - starts, []
    for at in range(0, len(starts), COMPARED):
        own = np.arange(at, min(at + COMPARED, len(starts)))
        other = first[number[own]]
        alike = lengths[own] == lengths[other]
        unlike.append(own[~alike])
        own, other = own[alike], other[alike]
        n = lengths[own]
        letter = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = data[letter + np.repeat(starts[own], n)] != data[letter + np.repeat(starts[other], n)]
        if differs.any():
            unlike.append(own[np.add.reduceat(differs, np.cumsum(n) - n, dtype=np.int64) > 0])
    extra: dict[bytes, int] = {}
    more = []
    for i in sorted(np.concatenate(unlike).tolist() if unlike else []):
        word = raw[starts[i] : ends[i]]
        if word not in extra:
            extra[word] = len(first) + len(extra)
            more.append(i)
        number[i] = extra[word]
    return number, np.concatenate([first, np.array(more, first.dtype)])


def count_chunk(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> pa.Table:
    """(group, term, count, docs) of texts in data as in boundaries(), each with the number of its group."""
    data = _LOWER[data]
    starts, stops = boundaries(data, ends)
    if not len(starts):
        return _SUMS.empty_table()
    number, first = group_slices(data, starts, stops)
    doc, n_terms = np.searchsorted(ends, starts, side="right"), len(first)
    in_doc, counts = np.unique(doc * n_terms + number, return_counts=True)
    key = group[in_doc // n_terms] * n_terms + in_doc % n_terms
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    raw, term = data.tobytes(), first[key[at] % n_terms]
    terms = [raw[s:e] for s, e in zip(starts[term].tolist(), stops[term].tolist())]
    columns = [key[at] // n_terms, pa.array(terms, pa.binary()), np.add.reduceat(counts, at), np.diff(at, append=len(key))]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_SUMS)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        table = pa.concat_tables(held) if held else _SUMS.empty_table()
        summed = table.group_by(["group", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
        return pa.Table.from_arrays([summed[c] for c in ("group", "term", "count_sum", "docs_sum")], schema=_SUMS)

    def named(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [*groups]
        lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        yield from pa.Table.from_arrays([lang.take(table["group"].combine_chunks()), source.take(table["group"].combine_chunks()), *[table[c] for c in ("term", "count", "docs")]], schema=_COUNTS).to_batches(100_000)

    for batch in batches:
        text = batch.column(2).cast(pa.large_binary())
        own = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
            held.append(count_chunk(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], own[at:to]))
            at = to
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [merged()]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from named(held.pop())
    yield from named(merged())
    everyone = pa.table({"group": pa.array(range(len(groups)), pa.int64()), "term": pa.array([b""] * len(groups), pa.binary()), "count": pa.array([0] * len(groups), pa.int64()), "docs": pa.array([0] * len(groups), pa.int64())})
    yield from named(everyone)


def count_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, count, total, first): how often each source has each kept term of its language, how often the language
    has it, and 1 in one row of each term. Every source also has a row with the empty term, which is none."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    summed = rows.mapInArrow(_count_task, COUNT_SCHEMA).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term, none = W.partitionBy("lang", "term"), F.octet_length("term") == 0
    all_sums = summed.withColumns({"total": F.sum("count").over(term), "all_docs": F.sum("docs").over(term), "place": F.row_number().over(term.orderBy("source"))})
    first = F.when(none | (F.col("place") > 1), 0).otherwise(1)
    return all_sums.where(none | (F.col("all_docs") >= least_docs)).select("lang", "term", "source", "count", "total", first.cast("long").alias("first"))


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * count / whole) for count <= whole, by long division."""
    value, rest = np.zeros_like(count), count
    for step in SCALE_STEPS:
        value, rest = value * step + rest * step // whole, rest * step % whole
    return value + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _block_divergences(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block of a language's terms: each source's sums of gaps to each other source, and its top terms against the language."""
    lang, real = rows["lang"].iloc[0], rows["term"].map(len).to_numpy() > 0
    everyone = rows[~real].sort_values("source")
    sources, whole = everyone["source"].to_numpy(), everyone["n"].to_numpy(np.int64) + 2 * everyone["v"].to_numpy(np.int64)
    lang_whole, rows = int(everyone["lang_n"].iloc[0] + 2 * everyone["v"].iloc[0]), rows[real]
    row = rows["source"].map({s: i for i, s in enumerate(sources)}).to_numpy(np.int64)
    order = np.argsort(row, kind="stable")
    row, rows = row[order], rows.iloc[order]
    column, terms = pd.factorize(rows["term"])
    n_sources, n_terms = len(sources), len(terms)
    n_own = np.bincount(row, minlength=n_sources)
    indptr = np.concatenate([[0], np.cumsum(n_own)])
    p = share(rows["count"].to_numpy(np.int64) + 2, whole[row]) if len(rows) else np.zeros(0, np.int64)
    absent = share(np.full(n_sources, 2), whole) if n_terms else np.ones(n_sources, np.int64)

    def by_row(values: np.ndarray) -> np.ndarray:
        return np.where(n_own > 0, np.add.reduceat(np.append(values, 0), indptr[:-1]), 0)

    out = []
    for b in range(n_sources):
        own = slice(indptr[b], indptr[b + 1])
        dense = np.full(n_terms, absent[b])
        dense[column[own]] = p[own]
        there = by_row(gap(p, dense[column]) - gap(absent[row], dense[column]))
        if len(p[own]):
            values, times = np.unique(p[own], return_counts=True)
            nowhere = (gap(absent[:, None], values[None, :]) * times).sum(axis=1)
        else:
            nowhere = np.zeros(n_sources, np.int64)
        total = there + nowhere + (n_terms - n_own[b]) * gap(absent, absent[b])
        others = np.arange(n_sources) != b
        out.append(pd.DataFrame({"lang": lang, "source": sources[others], "part": "pair", "item": sources[b], "value": total[others]}))
    if n_terms:
        q, words = share(rows["total"].to_numpy(np.int64) + 2, lang_whole), rows["term"].to_numpy()
        value = np.where(p > q, gap(p, q), -1)
        for a in range(n_sources):
            at = np.arange(indptr[a], indptr[a + 1])[value[indptr[a] : indptr[a + 1]] >= 0]
            if len(at) > TOP_TERMS:
                at = at[value[at] >= np.partition(value[at], len(at) - TOP_TERMS)[len(at) - TOP_TERMS]]
            at = sorted(at.tolist(), key=lambda i: (-value[i], bytes(words[i])))[:TOP_TERMS]
            out.append(pd.DataFrame({"lang": lang, "source": sources[a], "part": "term", "item": [bytes(words[i]).decode() for i in at], "value": value[at] if at else []}))
    return pd.concat(out).astype({"value": "int64"})


def source_divergences(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source).

    With p of a source and term 1 + floor(10**9 * (count + 2) / (N + 2V)), N the occurrences of the language's V kept terms in
    it, the gap of p and q is floor((p - q)**2 / (p + q)). Part pair: the sum of gaps to each other source of the language
    over all kept terms. Part term: the TOP_TERMS kept terms that the source has more of than its language, by their gap to it.

    Null lang, source and text are empty strings, and these a language and a source like any other. Repeated rows are
    documents each. A source without terms has its pairs; a source alone in its language has none; a language without
    kept terms has pairs of value 0. Ties are ranked by the item's UTF-8. Of no documents there are no rows. Other columns of
    docs are passed over.
    """
    counts = saved(count_terms(docs, least_docs))
    real = F.octet_length("term") > 0
    sources = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("first").alias("own_v"), F.count_if(real).alias("entries"))
    langs = sources.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("own_v").alias("v"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("n_sources"))
    room = F.least(F.greatest(F.col("n_sources") * F.col("n_sources"), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    langs = saved(langs.select("lang", "lang_n", "v", F.greatest(F.ceil(F.col("entries") / room), F.lit(1)).cast("int").alias("blocks")))
    by_lang = F.broadcast(langs) if langs.count() <= MAX_BROADCAST_LANGS else langs
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    nothing = F.lit(0).cast("long")
    entries = counts.where(real).join(by_lang, "lang").select("lang", block.alias("block"), "term", "source", "count", "total", nothing.alias("n"), nothing.alias("v"), nothing.alias("lang_n"))
    everyone = sources.join(by_lang, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(b"").alias("term"), "source", nothing.alias("count"), nothing.alias("total"), "n", "v", "lang_n")
    parts = entries.unionByName(everyone).groupBy("lang", "block").applyInPandas(_block_divergences, "lang string, source string, part string, item string, value long")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
