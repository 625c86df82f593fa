import hashlib
import random
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchment.llm import fingerprint as fp
from parchment.llm import pieces, token_file

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "<|endoftext|>x", "<|ENDOFTEXT|>", "don't stop...", 'hi." he', "É́ À.", "tİ? Σας", "H̱a ẖ", "２３ 12a", "a\xa0b\x1cc", "字 字。", "ª º² µ.", "x" * 3000]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_words_encode_as_whole_texts(plain):
    r, own = random.Random(2), token_file.WordEncoder(WORD_BPE)
    parts = ["aA", "é", "É", ".", ",", "'s", " ", "\n", "ß", "À", "ć", "1", "<|endoftext|>", "字", "́", "-", "don't", "...", "Σ", "İ", "_"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(800)]
    for text, ids in zip(texts, own.encode(texts, 2)):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_file.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_directly_addressable_codes():
    r = np.random.default_rng(3)
    for ids in ([0], [255, 256, 65535, 65536, 2**32 - 1], r.integers(0, 50000, 3000).tolist(), [7] * 600, r.integers(0, 2**24, 1100).tolist(), []):
        ids = np.array(ids, np.uint32)
        block = token_file.Block(token_file.encode_block([None, 2**60], [len(ids) // 2, len(ids)], ids))
        assert block.tokens().tolist() == ids.tolist() and block.doc_ids == [None, 2**60]
        assert [block.token(i) for i in range(len(ids))] == ids.tolist()
    whole = token_file.encode_block([1], [3], np.array([1, 2, 3], np.uint32))
    with pytest.raises(ValueError):
        token_file.Block(whole[:20] + bytes([whole[20] ^ 1]) + whole[21:])


def test_token_file(docs, corpus, plain, empty):
    start, want = 0, {}
    for i, t, _ in sorted(corpus, key=lambda r: r[0]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = token_file.round_trip(docs, WORD_BPE).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert token_file.round_trip(empty, WORD_BPE).count() == 0
    twice = token_file.round_trip(docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), WORD_BPE).orderBy("start").collect()
    assert [r["start"] for r in twice] == np.cumsum([0, *(r["n_tokens"] for r in twice[:-1])]).tolist()
    assert all(r["doc_id"] is None for r in twice[: len(corpus)])


def brute_segmentations(codec, text, n):
    text = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    best = [[(0.0, [])]]
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - codec.longest), end):
            piece = codec.table.get(text[start:end])
            if piece is not None:
                ways += [(s + float(codec.scores[piece]), ids + [piece]) for s, ids in best[start]]
            elif end - start == 1:
                ways += [(s + codec.unknown, ids + codec._spell(text[start])) for s, ids in best[start]]
        best.append(sorted(ways, key=lambda w: -w[0])[:n])
    return best[-1]


def test_rows_without_key_are_dealt_to_many_shards_in_order(spark):
    texts = [f"{i:03d} some words" for i in range(400)] + ["x" * 80 + c for c in "cab"]
    file = token_file.write_token_file(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4), WORD_BPE)
    assert file.select("shard").distinct().count() > 1
    rows = token_file.read_documents(file).orderBy("start").collect()
    own = token_file.WordEncoder(WORD_BPE)
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(ids) for ids in own.encode(sorted(texts), token_file.END_ID)]


def test_n_best_segmentations():
    codec, r = pieces.PieceCodec(PIECE_BPE), random.Random(4)
    texts = ODD[:-1] + ["".join(r.choice("the of an in er  \n字é.x") for _ in range(r.randrange(0, 25))) for _ in range(200)]
    split = [pieces.units(t) for t in texts]
    codec.learn(split)
    for text, parts in zip(texts, split):
        best, decoded, score, ways = codec.encode(parts, 4)
        want = brute_segmentations(codec, text, 4)
        assert [w for w, _ in ways] == pytest.approx([w for w, _ in want]), repr(text)
        assert decoded == text and score == pytest.approx(want[0][0])
        assert codec.decode(np.frombuffer(b"".join(best), "<i4")) == text
        others = [[*best] for _ in ways]
        for other, (_, changes) in zip(others, ways):
            for i, ids in changes:
                other[i] = ids
        assert len({b"".join(o) for o in others}) == len(ways)
        assert all(codec.decode(np.frombuffer(b"".join(o), "<i4")) == text for o in others)


def check_n_best(codec, text, n=4):
    parts = pieces.units(text)
    codec.learn([parts])
    best, decoded, score, ways = codec.encode(parts, n)
    want = brute_segmentations(codec, text, n)
    assert decoded == text and score == pytest.approx(want[0][0])
    assert [w for w, _ in ways] == pytest.approx([w for w, _ in want])
    spelt = set()
    for _, changes in ways:
        own = [*best]
        for i, ids in changes:
            own[i] = ids
        spelt.add(b"".join(own))
        assert codec.decode(np.frombuffer(b"".join(own), "<i4")) == text
    assert len(spelt) == len(ways)


def test_ties_and_texts_without_blanks():
    codec, r = pieces.PieceCodec(PIECE_BPE), random.Random(6)
    han = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(2000))
    latin = "".join(r.choice("etaoinshrdlu") for _ in range(2000))
    for text in ("x" * 49, "x" * 202, "xy" * 600, "x" * 5000 + " y", "  " * 400 + "a", han, latin, "a " * 300 + latin):
        check_n_best(codec, text)
    check_n_best(codec, "x" * 60, 40)


def test_very_long_units_take_time_in_proportion():
    codec = pieces.PieceCodec(PIECE_BPE)
    for text, n_ways in (("x" * 100_000, 4), ("\u5b57\u3002\u9fa5" * 7_000, 1), ("ab/+9Zq" * 10_000, 4)):
        began = time.perf_counter()
        codec.learn([[text]])
        best, decoded, score, ways = codec.encode([text], 4)
        assert decoded == text and len(ways) == n_ways and ways[0][0] == score and time.perf_counter() - began < 30


def test_short_units_of_unequal_length_are_solved_together():
    codec, r = pieces.PieceCodec(PIECE_BPE), random.Random(7)
    some = [pieces.SPACE + "".join(r.choice("theofanin\u5b57\u00e9.x") for _ in range(r.randrange(0, 60))) for _ in range(300)]
    score, loss, ids = codec.solve(some)
    for i, unit in enumerate(some):
        one = codec.solve_long(unit)
        assert (score[i], loss[i]) == pytest.approx(one[:2]) and codec.decode(np.frombuffer(ids[i], "<i4")) == unit[1:]


def test_units_are_the_text():
    for text in ("a b", " a", "a ", "  a  b  ", "", " ", "   ", "a\n b"):
        assert "".join(" " + u for u in pieces.units(text))[1:] == text


def test_encoded_documents(docs, corpus, empty):
    rows = {r["doc_id"]: r for r in pieces.encode_documents(docs, PIECE_BPE).collect()}
    assert len(rows) == len(corpus) and all(r["decoded_equal"] for r in rows.values())
    assert rows[77]["n_tokens"] == 0 and rows[78]["score"] == 0 and len(rows[77]["nbest"]) == 1
    assert all(r["nbest"][0]["score"] == r["score"] and r["nbest"][0]["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows.values())
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(pieces.encode_documents(docs, PIECE_BPE), PIECE_BPE).collect()}
    assert back == {i: t or "" for i, t, _ in corpus}
    assert pieces.encode_documents(empty, PIECE_BPE).count() == 0


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(200))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(fp._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert fp.gear_hashes(data).tolist() == want


def test_chunks():
    r = random.Random(1)
    data = "".join(r.choice("abcdefgh éü\n") for _ in range(20000)).encode()
    ends = fp.boundaries(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= fp.MOST and sizes[:-1].min() >= fp.LEAST and 40 < sizes.mean() < 110
    moved = fp.boundaries(b"shifted by this " + data)
    assert len({e + 16 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert fp.boundaries(b"") == [] and fp.boundaries(b"abc") == [3]


def test_fingerprints(docs, corpus, empty):
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    rows = sorted(corpus, key=lambda r: r[0])
    assert len(got) == len(rows)
    for (i, t, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        t, following, r = t or "", following or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fp.as_string(fp.fingerprint(t)) and r["edited_fingerprint"] == fp.as_string(fp.fingerprint(edited))
        assert 0 <= r["near_edited"] <= 1 and (t != following or r["near_next"] == 1)
    assert 0.35 < got[83]["near_edited"] < 0.65 and got[83]["near_next"] < 0.05
    assert fp.fingerprint_documents(empty).count() == 0
    one = docs.where("doc_id = 5")
    assert fp.fingerprint_documents(one).first()["near_next"] == 1
    assert fp.fingerprint_documents(docs.unionByName(docs)).count() == 2 * len(rows)
    assert fp.fingerprint_documents(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(rows)


def test_a_worker_holds_few_texts_of_a_batch(spark):
    """Of a batch of 20 MB, what Python holds at any time; pipeline's workers keep it until the next stage."""

    class Rows:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    run, n = pieces.encode_documents(Rows(), PIECE_BPE), 20_000
    text = " ".join(["abcdefghijklmnopqrstuvwxyz0123456789abc"] * 25)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [text] * n})
    assert sum(map(len, run(iter([batch.slice(0, 1)])))) == 1  # the model is loaded
    tracemalloc.start()
    try:
        rows = sum(map(len, run(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n and peak < 8 << 20


def test_units_are_decoded_together(monkeypatch):
    """What ids spell is compared for all new units at once; only those with U+2581 are decoded one by one. Scores and ids are those of the plain pass."""
    own = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    decoded, text = [], own._text
    monkeypatch.setattr(own, "_text", lambda ids: decoded.append(1) or text(ids))
    some = ["", "a", "word", "  two", "日本語", "naïve\x00", "🙂x", "\U0010ffff", "a▁b", "x" * 47, "ßé" * 20] + [f"w{i}é{i * 7919}" for i in range(300)]
    own.learn([some])
    assert len(decoded) == 1 and own.other_texts == {"a▁b": " a b"}
    for unit in some:
        score, _, ids = own.solve_long(pieces.SPACE + unit.replace(" ", pieces.SPACE))
        at = own.place[unit]
        assert own.best[at] == pytest.approx(score) and (own.ids[at] == ids or own.loss[at] == pytest.approx(0))
        assert text(np.frombuffer(own.ids[at], "<i4")) == f" {unit}".replace("▁", " ")
    assert not own._spelt_alike(["ab", "c"], [own.ids[own.place["a"]], own.ids[own.place["word"]]])
    hashes = own.hashes.reshape(1, -1)
    monkeypatch.setattr(pieces, "mix", lambda x: x)
    assert (own._find(hashes)[0] == own.hash_ids).all()  # also those whose lowest bits another piece has
