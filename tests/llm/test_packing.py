import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parchment.llm import packing as pk

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def piece(length, doc_id=0, start=0):
    return pk.Piece(length, doc_id, start, np.arange(start, start + length, dtype="<u4").tobytes(), start + length)


def test_tightest_window():
    r, rooms, model = random.Random(1), pk.Rooms(100), defaultdict(list)
    for step in range(20_000):
        if r.random() < 0.5:
            room = r.randrange(101)
            rooms.add(room, step)
            model[room].append(step)
        else:
            least = r.randrange(1, 101)
            fit = min((room for room in model if model[room] and room >= least), default=None)
            assert rooms.take(least) == (None if fit is None else (fit, model[fit].pop()))


def plain_best_fit(lengths, size):
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in windows if size - sum(w) >= n]
        if fits:
            max(fits, key=sum).append(n)
        else:
            windows.append([n])
    return sorted(sum(w) for w in windows)


def test_best_fit_decreasing_equals_a_plain_one():
    r = random.Random(2)
    for size in (1, 7, 64, 100):
        for n in (0, 1, 30, 300):
            lengths = [r.randrange(1, size + 1) for _ in range(n)]
            windows = pk.best_fit([piece(x, i) for i, x in enumerate(lengths)], size)
            assert sorted(sum(p.length for p in w) for w in windows) == plain_best_fit(lengths, size)


def test_cuts_keep_every_token():
    r = random.Random(3)
    for _ in range(200):
        pieces = [piece(r.randrange(1, 90), i, r.randrange(5)) for i in range(r.randrange(12))]
        total = sum(p.length for p in pieces)
        full, rest = pk.filled(pieces, 64)
        parts = pk.powers_of_two(rest)
        assert all(sum(p.length for p in w) == 64 for w in full) and sum(p.length for p in rest) == total % 64
        assert [sum(p.length for p in w) for w in parts] == [1 << k for k in range(7, -1, -1) if total % 64 >> k & 1]
        joined = b"".join(p.ids for w in full + parts for p in w)
        assert joined == b"".join(p.ids for p in pieces) and all(len(p.ids) == 4 * p.length and np.frombuffer(p.ids, "<u4")[0] == p.start for w in full + parts for p in w)


def check(rows, want, size, slack):
    """rows: pieces; want: the ids of each document, by a key."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        total = sum(r["length"] for r in own)
        assert size - slack <= total <= size or total & (total - 1) == 0
    assert by_doc.keys() == want.keys()
    for doc_id, ids in want.items():
        own = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == ids and {r["doc_tokens"] for r in own} == {len(ids) // 4}
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()


def ids_of(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.mark.parametrize("held, size", [(1 << 22, 4096), (3000, 512), (600, 64)])
def test_documents(docs, corpus, plain, empty, monkeypatch, held, size):
    monkeypatch.setattr(pk, "HELD_TOKENS", held)
    want = {i: ids_of(plain, t) for i, t, _ in corpus}
    packed = pk.pack_documents(docs.withColumn("length", F.lit("x")).withColumn("offset", F.lit(1)), WORD_BPE, size=size, slack=4)
    assert packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check(packed.collect(), want, size, 4)
    assert pk.pack_documents(empty, WORD_BPE).count() == 0


def test_repeated_and_null_ids(docs, corpus, plain):
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = pk.pack_documents(twice, WORD_BPE).collect()
    n = sum(len(ids_of(plain, t)) // 4 for _, t, _ in corpus)
    assert sum(r["length"] for r in rows) == 3 * n and sum(r["length"] for r in rows if r["doc_id"] is None) == n
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_little_padding_and_digests(spark):
    from parchment.llm import catalog

    rows = catalog.op12_packing(spark, "/root/testdata/sf0.001").collect()
    totals = defaultdict(int)
    for r in rows:
        totals[r["sequence_id"]] += r["length"]
    padding = sum(4096 - n for n in totals.values() if n & (n - 1))
    assert padding < 0.01 * sum(totals.values())
    packed = pk.pack_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), WORD_BPE).collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows} == {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in packed}
