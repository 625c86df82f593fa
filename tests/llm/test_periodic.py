import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from parchment.llm import periodic as pr
from parchment.llm.hashing import word_hashes


def brute(words):
    """All runs by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q) and not any(s <= start and start + length <= s + m and q % p == 0 for s, m, p in found):
                found[start, length, q] = 1
    return sorted(found)


def odd_sequences():
    r = random.Random(3)
    yield from ([], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2, 1, 2, 1, 1, 1, 1, 1, 1, 2], [2, 1] * 9 + [3] + [1, 2] * 9)
    for _ in range(1500):
        n, k = r.randrange(60), r.choice([1, 2, 2, 3, 4])
        yield [r.randrange(k) for _ in range(n)]
    for _ in range(400):  # periodic stretches within others, also of periods that are periodic but for one word
        out = []
        while len(out) < 120:
            period = [r.randrange(3) for _ in range(r.randrange(1, 12))]
            out += (period * 9)[: r.randrange(1, 70)] + [r.randrange(4) for _ in range(r.randrange(4))]
        yield out
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    yield b[:600]
    yield [bin(i).count("1") % 2 for i in range(512)]  # sums of a power of two's terms of it collide modulo 2**64


def test_runs_equal_brute_force():
    for numbers in odd_sequences():
        assert pr.find_runs(numbers) == brute(numbers), numbers


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(pr, "_MASK", 3)
    for numbers in list(odd_sequences())[::9]:
        assert pr.find_runs(numbers) == brute(numbers), numbers


def test_all_runs_lie_in_the_stretches_that_may_repeat():
    r = random.Random(4)
    texts = [b" ".join(b"w%d" % x for x in numbers) for numbers in odd_sequences()]
    r.shuffle(texts)
    hashes, counts = word_hashes(texts)
    stops = np.cumsum(counts)
    assert [f[0] for f in pr.text_runs(texts)] == [brute(t.split()) for t in texts]
    zones = pr.may_repeat(hashes, stops)
    assert all(a < b for a, b in zones) and all(b <= c for (_, b), (c, _) in zip(zones, zones[1:]))
    words = [b"w%d" % r.randrange(3000) for _ in range(50_000)]
    assert pr.may_repeat(*[f(x) for f, x in zip((np.asarray, np.cumsum), word_hashes([b" ".join(words)]))]) == []
    assert pr.may_repeat(np.zeros(12, np.uint64), np.array([4, 12]))  # equal hashes exclude nothing


def contract(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = sorted(runs, key=lambda x: (-x[1], x[0], x[2]))[:1]
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    digest = lambda x: hashlib.sha256(x).hexdigest()
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(kept)))


def test_documents(spark, docs, corpus, empty):
    r = random.Random(6)
    more = [(100 + i, " ".join(r.choice(["a", "b", "C", "é"]) for _ in range(r.randrange(80))), "s") for i in range(150)]
    more += [(None, "x " * 9, "s"), (None, None, "s"), (7, "y\t\x0bz\n" * 7, "s"), (7, "y\t\x0bz\n" * 7, "s")]
    rows = docs.select("doc_id", "text", "source", "score").unionByName(spark.createDataFrame([(*m, 0.5) for m in more], "doc_id long, text string, source string, score double"))
    got = sorted(map(tuple, pr.document_runs(rows, edited=True).collect()), key=repr)
    assert got == sorted((contract(i, t) for i, t, _ in corpus + more), key=repr)
    assert sum(g[1] > 0 for g in got) > 10
    assert pr.document_runs(empty).count() == 0
    plain = {r["doc_id"]: r for r in pr.document_runs(rows).where("doc_id = 7").collect()}
    assert plain[7]["period"] == 2 and plain[7]["exponent_milli"] == 7000


@pytest.mark.parametrize("text", ["x " * 300_000, "a b c " * 60_000 + "d " * 60_000, " ".join(str(i % 50_000) for i in range(250_000)), " ".join(bin(i).count("1") % 2 * "a" + "b" for i in range(1 << 17))])
def test_very_long_texts(text):
    began = time.perf_counter()
    ((runs, words),) = pr.text_runs([text.encode()])
    assert time.perf_counter() - began < 40
    for s, length, q in runs[:50]:
        assert words[s : s + length - q] == words[s + q : s + length]
        assert (s == 0 or words[s - 1] != words[s + q - 1]) and (s + length == len(words) or words[s + length] != words[s + length - q])
