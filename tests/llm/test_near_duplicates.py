import os
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import common, neardup

WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = WORD.findall(low(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def compare(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_corpus(spark, corpus):
    compare(spark, [(i, t) for i, t, _ in corpus])


def test_groups_with_chains_and_shared_lines(spark):
    """Copies with ever more edits, half with a line in common, so that links run through few of them."""
    r, rows = random.Random(9), []
    for group in range(4):
        base = [f"g{group}w{k}" for k in range(150)]
        for k in range(25):
            words = list(base)
            for _ in range(r.randrange(1 + k)):
                words[r.randrange(len(words))] = f"e{len(rows)}x{r.randrange(999)}"
            if k % 2:
                words[40:40] = "a notice that many of these texts have in common".split()
            if k % 5 == 0:
                words = words[: r.randint(90, 150)]
            rows.append((len(rows) * 3, " ".join(words)))
    r.shuffle(rows)
    compare(spark, rows)


@pytest.mark.parametrize("pairs_per_member", [0, 8])
def test_template_families(spark, monkeypatch, pairs_per_member):
    """Texts of one template with 10 to 30 % of their own, around the bound, and a long one that bridges two families."""
    monkeypatch.setattr(neardup, "PAIRS_PER_MEMBER", pairs_per_member)
    monkeypatch.setattr(neardup, "PAIRED", 8)
    r, rows = random.Random(11), []
    for family in range(2):
        template = [f"t{family}w{k}" for k in range(200)]
        for _ in range(70):
            own = [f"o{len(rows)}x{k}" for k in range(r.randint(20, 75))]
            rows.append((len(rows), " ".join([*template, *own] if len(rows) % 3 else [*own, *template])))
    rows.append((len(rows), rows[3][1] + " " + rows[80][1]))
    rows += [(len(rows) + k, " ".join(r.sample([f"t0w{k}" for k in range(200)], 150))) for k in range(20)]
    r.shuffle(rows)
    compare(spark, rows)


def test_few_pairs_under_a_high_bound_need_no_further_hub(spark, monkeypatch):
    """60 members of one class of sizes have up to 60 x 60 pairs; what they have in common leaves 3 of these open."""
    taken = []
    monkeypatch.setattr(neardup, "further_hubs", lambda apart: taken.append(apart))
    rows = [(1, i, 1000 + i, 1000 + i, False, i) for i in range(2, 62)] + [(1, 100 + i, 1010 + i, 1010 + i, True, 1) for i in range(3)]
    near = spark.createDataFrame(rows, "hub long, rep long, n int, most int, linked boolean, component long")
    assert neardup._apart(near, True)[2] > neardup.PAIRS_PER_MEMBER * len(rows)
    for few in (True, False):
        pairs, links = neardup.open_pairs(near, None, few)
        assert sorted(map(tuple, pairs.collect())) == [(10, 100), (11, 101), (12, 102)] and links is None and not taken
    assert neardup.open_pairs(near.where("linked"), None, True) == (None, None)


def test_plain_joins_beyond_what_is_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "MAX_BROADCAST_IDS", 3)
    compare(spark, [(i, t) for i, t, _ in corpus])


def test_a_doc_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(0, a, 1), (5, a + " z", 2), (5, b, 3), (5, b, 4), (5, "", 5), (5, None, 6), (7, c, 7), (8, c + " z", 8), (None, c, 9)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.where("n_shingles > 0 and doc_id is not null").collect()) == [(0, 0), (5, 0), (5, 5), (5, 5), (7, 7), (8, 7)]
    left = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in left.collect()) == sorted([(0, a), (5, b), (5, ""), (7, c), (-1, c)])


def test_exact_bound(spark):
    """Three shingles of four are 75 %, which links; one less doesn't."""
    a = " ".join(f"w{i}" for i in range(7))
    rows = [(1, a), (2, " ".join(f"w{i}" for i in range(8))), (3, " ".join(f"w{i}" for i in range(9))), (4, "p q r s t u"), (5, "p q r s t u v")]
    compare(spark, rows)


def test_pigeonhole():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**16, (200, neardup.N_HASHES), np.uint16)
    b = a.copy()
    for i in range(200):  # 31 places differ
        at = r.choice(neardup.N_HASHES, 2 * neardup.CHUNKS - 1, replace=False)
        b[i, at] += 1
    keys = [neardup.lookup_keys(x) for x in (a, b)]
    assert all(set(x.tolist()) & set(y.tolist()) for x, y in zip(*keys))


def test_edges(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    no_ids = neardup.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(no_ids) == docs.count() and all(r["component_id"] is None and r["kept"] for r in no_ids)
    twice = neardup.near_duplicates(docs.unionByName(docs))
    assert twice.count() == 2 * docs.count()
    kept = {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect()}
    dropped = neardup.drop_near_duplicates(docs.unionByName(docs))
    assert dropped.columns == docs.columns
    assert sorted(r["doc_id"] for r in dropped.collect()) == sorted(kept)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(82, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    below = os.path.dirname(common.shared_folder(spark)).removeprefix("file:")
    others = common.saved(docs)
    began = set(os.listdir(below))
    got = corpus_pipeline.run(spark, str(tmp_path))
    held, folders = got.count(), set(os.listdir(below))
    assert held > 0 and got.where("not decoded_equal").count() == 0
    assert folders > began and len(folders) == len(began) + 1  # of what run() wrote, only what its result reads is left
    assert others.count() == docs.count()
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns and after.where("kept and score = 1.5").count() == after.count(), name
        assert name == "near-duplicates" or after.where("n_chars <> length(text)").count() == 0
        assert set(r["doc_id"] for r in after.collect()) <= set(r["doc_id"] for r in at.collect())
        at = after.cache()
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in at.collect())
    empty = str(tmp_path / "empty")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_folders_of_another_thread_are_not_noted(spark, docs):
    with common.noting_folders() as own:
        elsewhere = threading.Thread(target=lambda: common.saved(docs))
        elsewhere.start()
        elsewhere.join()
        assert own == []
        kept = common.saved(docs)
        assert len(own) == 1
    common.saved(docs)
    assert len(own) == 1 and kept.count() == docs.count()


if __name__ == "__main__":
    pytest.main([__file__])


def test_frequent_keys_are_counted_alike(spark, monkeypatch):
    rows = [(i, np.full(neardup.N_HASHES, i // 5 if i < 20 else i, np.uint16).tobytes()) for i in range(30)]
    reps = spark.createDataFrame(rows, "rep long, signature binary")
    held = lambda: sorted(map(tuple, neardup.held_keys(reps).select("key", "rep", "size").collect()))
    plain = held()
    assert len(plain) == 20 * neardup.N_HASHES and {size for _, _, size in plain} == {5}
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    monkeypatch.setattr(neardup, "FREQUENT", 3)
    assert held() == plain
