import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parchment.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least=10):
    """The operator in dictionaries of Python: rows are (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        whole = {s: sum(c[t] for t in kept) + 2 * len(kept) for s, c in own.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // whole[s] for t in kept} for s, c in own.items()}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        lang_whole = sum(total.values()) + 2 * len(kept)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            q = {t: 1 + 10**9 * (total[t] + 2) // lang_whole for t in kept}
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)}
    return out


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, 1, "x", 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, count long, term string, rank int")
    got = dv.source_divergences(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return {tuple(r) for r in got.collect()}


def made(n=400):
    r = np.random.default_rng(5)
    words = ["alpha", "Beta", "ÉTÉ", "字", "don't", "x1y", "der", "die", "und", "rare", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for i in range(n):
        some = r.choice(words[: 10 + i % 27], size=int(r.integers(0, 40)))
        rows.append((["en", "de", None][i % 3], [None, "", "a", "b", "é"][int(r.integers(0, 5))], " ".join(some) + ["", ".", "\x00", "\U0001f600"][i % 4]))
    return rows + [("fr", "a", "only three words"), ("fr", "b", None), ("it", "z", ""), ("en", "empty", ""), ("en", "empty", "1 2 3")] + rows[:30] + [rows[7]] * 20


def test_equals_brute_force(spark):
    rows = made()
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [16, 64])
def test_blocks_and_merging_change_nothing(spark, monkeypatch, block):
    rows = made(200)
    want = brute(rows, 3)
    for name, value in (("LEAST_BLOCK", block), ("MOST_BLOCK", block), ("MAX_BROADCAST_LANGS", 0)):
        monkeypatch.setattr(dv, name, value)
    assert result(spark, rows, least_docs=3) == want


def test_empty_table_and_no_kept_terms(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert dv.source_divergences(docs).count() == 0
    assert result(spark, [("en", "a", "x y"), ("en", "b", "z")]) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_terms_end_with_their_text():
    texts = ["ab", "", "Cd", "é", "1", "字x-y"]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts, stops = dv.boundaries(np.frombuffer(data, np.uint8), ends)
    assert [data[s:e].decode() for s, e in zip(starts, stops)] == ["ab", "Cd", "é", "字x", "y"]


def test_collisions_split_groups(monkeypatch):
    words = [b"ab", b"cd", b"abc", b"ab", b"ef", b"cd", b"abc", b"gh", b"ef"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    for hashed in (lambda w: 7, lambda w: len(w), lambda w: w[0] % 2):
        monkeypatch.setattr(dv, "digest", hashed)
        number, first = dv.group_slices(data, ends - [len(w) for w in words], ends)
        assert [words[first[k]] for k in number] == words and len(first) == len(set(words))


def test_chunks_of_a_task(monkeypatch):
    import pyarrow as pa

    texts = ["a b a", "", "b c" * 50, "a", "x" * 300, "b"] * 40
    rows = pa.record_batch({"lang": ["en"] * 240, "source": ["s", "t"] * 120, "text": texts})

    def summed():
        sums = Counter()
        for b in dv._count_task(iter([rows.slice(3, 200), rows.slice(0, 0), rows])):
            for x in b.to_pylist():
                sums[x["source"], x["term"], "n"] += x["count"]
                sums[x["source"], x["term"], "d"] += x["docs"]
        return sums

    want = summed()
    monkeypatch.setattr(dv, "CHUNK_BYTES", 100)
    monkeypatch.setattr(dv, "HELD_ROWS", 6)
    monkeypatch.setattr(dv, "COMPARED", 5)
    assert summed() == want and want["s", b"a", "d"] == sum(1 for i, t in enumerate(texts[3:203] + texts) if "a" in t.split() and (i + (i < 200)) % 2 == 0)


def test_exact_shares():
    r = np.random.default_rng(1)
    whole = r.integers(1, 9 * 10**15, 1000)
    count = (whole * r.random(1000)).astype(np.int64)
    assert dv.share(count, whole).tolist() == [1 + 10**9 * c // w for c, w in zip(count.tolist(), whole.tolist())]
