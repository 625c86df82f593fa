"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, links confirmed on whole shingle sets.

A signature has CHUNKS chunks of CHUNK_LEN b-bit minhashes. If two signatures differ in at most 2 * CHUNKS - 1 places, some
chunk differs in at most one (pigeonhole). So each chunk is looked up under every way to leave one of its minhashes
out, and all such pairs meet under a common key. Pairs of 75 % resemblance differ in 16 of 64 places on average and
in more than 31 with a chance of about one in a hundred thousand.

Not all pairs of a key are compared. Each key has a hub, a document that meets most others, and every member is
compared with it. Two members that are both linked to the hub need nothing more. For any others, A and B, let C be the
hub's shingles and those that COMMON members or more of the hub have. Then

    |A and B| <= min(|A and C|, |B and C|) + |shingles outside C that both have|,

so they can only be linked if they share a shingle that few members have, or if the first term alone is enough. Edits of one
text rarely share what they put in, and what many share counts towards C. So the second round, in which such pairs are
compared, is small. Pairs that links connect already are left out of it; where many of a hub's members are still apart,
further hubs are taken among them, one for each class of sizes, before what remains is paired. No pair is lost.

Nodes of the graph are distinct shingle sets, named by a 64-bit hash; doc_ids only name what is found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.llm.common import saved, shuffle_partitions
from parchment.llm.hashing import chain, grouped, mix, word_hashes

SHINGLE_WORDS = 5
LINK_PERCENT = 75
CHUNKS, CHUNK_LEN = 16, 4
BITS = 16
#: Ids of documents with candidates, and names of components, up to which they are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: One in so many sets is looked at for keys that very many have; how often such a key is met there, at least.
SAMPLED, FREQUENT = 16, 32
#: Members that a task compares with one copy of their hub.
MEMBERS_PER_TASK = 128
#: Members of a hub that have a shingle which the hub lacks, from which on it counts as common to them.
COMMON = 16
#: Pairs for each member that are compared without a further hub; rounds of further hubs; members of a hub paired in one task.
PAIRS_PER_MEMBER, ROUNDS, PAIRED = 16, 3, 256
#: Pairs for each member, as a bound has it, up to which they are listed to see how many there are; a list is numbers alone.
LISTED_PER_MEMBER = 256

N_HASHES = CHUNKS * CHUNK_LEN
_RANDOM = np.random.default_rng(20_240_229)
_FACTORS = _RANDOM.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, N_HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, with A-Z lower-cased: of all runs of five words, of the whole
    text if it has fewer, none if it has no word."""
    hashes, counts = word_hashes([t.lower() for t in texts])
    runs = chain(hashes, SHINGLE_WORDS) if len(hashes) >= SHINGLE_WORDS else hashes[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE_WORDS:
            out.append(np.unique(runs[at : at + n - SHINGLE_WORDS + 1]))
        else:
            out.append(mix(chain(hashes[at : at + n], n) + np.uint64(n)) if n else hashes[:0])
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The b-bit minhashes of each set that isn't empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), N_HASHES), np.uint16)
    for i in range(N_HASHES):
        least = np.minimum.reduceat(flat * _FACTORS[i] + _TERMS[i], starts)
        out[:, i] = mix(least) >> np.uint64(64 - BITS)
    return out


def lookup_keys(signature: np.ndarray) -> np.ndarray:
    """For each row of signatures, the keys under which it is looked up: each chunk without each of its minhashes."""
    chunks = signature.astype(np.uint64).reshape(len(signature), CHUNKS, CHUNK_LEN)
    keys = []
    for left_out in range(CHUNK_LEN):
        key = np.zeros((len(signature), CHUNKS), np.uint64)
        for i in range(CHUNK_LEN):
            if i != left_out:
                key = (key << np.uint64(BITS)) | chunks[:, :, i]
        keys.append(mix(key ^ (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK_LEN) + np.uint64(left_out)) << np.uint64(3 * BITS)))
    return np.concatenate(keys, axis=1).view(np.int64)


def _broadcast_if(few: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few else df


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_shingles, digest, signature) of each row; equal shingle sets have equal digests, empty ones none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, ids, hashes = 0, batch["doc_id"].tolist(), batch["t"].tolist()
            for texts in grouped(t.encode() for t in batch["text"]):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full) if full else ())
                yield pd.DataFrame({
                    "doc_id": ids[at : at + len(sets)], "t": hashes[at : at + len(sets)], "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "signature": [next(rows).tobytes() if len(s) else None for s in sets],
                })
                at += len(sets)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    return rows.mapInPandas(run, "doc_id string, t long, n_shingles long, digest binary, signature binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def keyed(reps: DataFrame) -> DataFrame:
    """(key, rep): a row for each lookup key of each representative."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                some = batch.iloc[at : at + 2000]
                keys = lookup_keys(np.frombuffer(b"".join(some["signature"]), np.uint16).reshape(len(some), N_HASHES))
                yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(some["rep"].to_numpy(), N_HASHES)})

    return reps.select("rep", "signature").mapInPandas(run, "key long, rep long")


def held_keys(reps: DataFrame) -> DataFrame:
    """(key, rep, size): the keys that more than one representative has, with how many have them.

    All keys are made and shuffled once. Those of very many sets, which some of the sets show, are dealt by set and counted
    by partial sums, so that they never meet in one task. They are MAX_BROADCAST_IDS at most, whatever the input.
    """
    some = reps.where(f"pmod(rep, {SAMPLED}) = 0")
    least = max(FREQUENT, some.count() * N_HASHES // MAX_BROADCAST_IDS + 1)
    frequent = saved(keyed(some).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).select("key", F.lit(True).alias("frequent")))
    keys = keyed(reps).join(F.broadcast(frequent), "key", "left")
    alone = F.when(F.col("frequent"), F.col("rep"))
    held = saved(keys.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("key", alone))).where("size > 1 or frequent"))
    many = held.where("frequent").drop("size")
    sizes = saved(many.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    return held.where("frequent is null").unionByName(many.join(F.broadcast(sizes), "key").select(held.columns)).select("key", "rep", "size")


def member_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shingles) of the sets that ids (rep, doc, digest) names and the document doc has; 8 bytes for each shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, digests = 0, batch["digest"].tolist()
            for texts in grouped(t.encode() for t in batch["text"]):
                sets = [s.tobytes() for s in shingle_sets(texts)]
                # rows that repeat an id may have another text
                own = [at + i for i, s in enumerate(sets) if hashlib.blake2b(s, digest_size=16).digest() == digests[at + i]]
                yield batch.iloc[own][["rep"]].assign(shingles=[sets[i - at] for i in own])
                at += len(sets)

    few = ids.count() <= MAX_BROADCAST_IDS
    met = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text is not null").join(F.broadcast(ids) if few else ids, "doc")
    return met.select("rep", "digest", "text").mapInPandas(run, "rep long, shingles binary")


def compare(pairs: DataFrame, sets: DataFrame, residues: bool = False) -> DataFrame:
    """(hub, rep, n, shared, linked, residue) of pairs (hub, rep) and of each hub with itself: the size of rep's set, how
    much of it hub has, whether that links them, and the shingles that hub lacks, 8 bytes each (null unless asked for).

    A task reads a hub's set and then those of its members one by one. A hub with many members is copied to several
    tasks. Sets are shuffled once, to these tasks, unless there are too many pairs to send to the sets.
    """
    few = 2 * pairs.count() <= MAX_BROADCAST_IDS  # a hub has no more copies than members
    tasks = pairs.groupBy("hub").agg(F.ceil((F.count(F.lit(1)) + 1) / MEMBERS_PER_TASK).cast("int").alias("tasks"))
    own = tasks.select("hub", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), F.col("hub").alias("rep"))
    theirs = pairs.join(_broadcast_if(few, tasks), "hub").select("hub", F.pmod(F.xxhash64("rep"), "tasks").cast("int").alias("task"), F.lit(1).alias("kind"), "rep")
    dealt = own.unionByName(theirs)
    met = sets.join(_broadcast_if(few, dealt), "rep")
    met = met.repartition(shuffle_partitions(pairs.sparkSession), "hub", "task").sortWithinPartitions("hub", "task", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for hub, task, kind, rep, shingles in batch.itertuples(index=False, name=None):
                these = np.frombuffer(shingles, np.uint64)
                if kind == 0:
                    base = these
                    if task == 0:
                        found.append((hub, hub, len(base), len(base), True, b"" if residues else None))
                    continue
                place = np.minimum(np.searchsorted(base, these), len(base) - 1)
                inside = base[place] == these
                shared, n = int(inside.sum()), len(these)
                linked = 100 * shared >= LINK_PERCENT * (len(base) + n - shared)
                residue = these[~inside].tobytes() if residues else None
                found.append((hub, rep, n, shared, linked, residue))
            yield pd.DataFrame(found, columns=["hub", "rep", "n", "shared", "linked", "residue"])

    return met.select("hub", "task", "kind", "rep", "shingles").mapInPandas(run, "hub long, rep long, n int, shared int, linked boolean, residue binary")


def _mate(df: DataFrame, *shared: str) -> DataFrame:
    """df with _b behind the names of all columns but the shared ones."""
    return df.select(*[F.col(c).alias(c if c in shared else f"{c}_b") for c in df.columns])


def _as_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("rep", "rep_b").alias("hub"), F.greatest("rep", "rep_b").alias("rep")).distinct()


def second_round(compared: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which members of one hub may be linked though not both are linked to it: pairs (hub, rep) of members that share a
    shingle which few have, and the members (hub, rep, n, most, linked) that may be linked through common shingles alone,
    to members with n of `most` at most. Pairs inside one of the components (node, component) are left out."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each shingle of a residue; the key stands for hub and shingle."""
        for batch in batches:
            for at in range(0, len(batch), 2000):
                some = batch.iloc[at : at + 2000]
                size = some["residue"].map(len).to_numpy() // 8
                hubs = mix(some["hub"].to_numpy().astype(np.uint64) + np.uint64(1))
                keys = mix(np.frombuffer(b"".join(some["residue"]), np.uint64) ^ np.repeat(hubs, size))
                yield pd.DataFrame({"key": keys.view(np.int64)} | {c: np.repeat(some[c].to_numpy(), size) for c in ("hub", "rep", "linked")})

    rows = compared.where("length(residue) > 0").select("hub", "rep", "linked", "residue").mapInPandas(split, "key long, hub long, rep long, linked boolean")
    # counted by partial sums and joined with, so that no key's rows have to meet in one task
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.count_if(~F.col("linked")).alias("apart"))
    shared = saved(shared.where(f"holders >= 2 and (holders >= {COMMON} or apart > 0)"))
    held = saved(rows.join(shared.drop("apart"), "key"))
    common = held.where(F.col("holders") >= COMMON).groupBy("hub", "rep").agg(F.count(F.lit(1)).cast("int").alias("more"))
    # from here on `shared` is what a document has of the hub's set and of what is common to the hub's members
    members = compared.select("hub", "rep", "n", "shared", "linked").join(common, ["hub", "rep"], "left")
    members = saved(members.withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0))).drop("more"))
    rare = held.where(F.col("holders") < COMMON).select("key", "hub", "rep").join(_labelled(members, component), ["hub", "rep"])
    room = F.least("shared", "shared_b") + F.least(F.col("n") - F.col("shared"), F.col("n_b") - F.col("shared_b"))
    possible = (7 * room >= 3 * (F.col("n") + F.col("n_b"))) & (F.col("component") != F.col("component_b"))
    meeting = _as_pairs(rare.join(_mate(rare.where("not linked"), "key", "hub"), ["key", "hub"]).where(possible))
    # without a rare shingle in common, both must have enough of what is common: n <= most_b and n_b <= most
    reach = members.withColumn("most", F.expr("7 * shared div 3") - F.col("n"))
    bounds = reach.groupBy("hub").agg(F.min("n").alias("least_n"), F.max(F.when(~F.col("linked"), F.col("most"))).alias("most_most"))
    few = members.count() <= MAX_BROADCAST_IDS
    near = reach.join(_broadcast_if(few, bounds), "hub").where((F.col("most") >= F.col("least_n")) & ((F.col("n") <= F.col("most_most")) | ~F.col("linked")))
    return meeting, near.select("hub", "rep", "n", "most", "linked")


def _labelled(members: DataFrame, component: DataFrame) -> DataFrame:
    """members with their component, which is the member itself where it has no links."""
    few = component.count() <= MAX_BROADCAST_IDS
    named = component.select(F.col("node").alias("rep"), "component")
    return members.join(_broadcast_if(few, named), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def size_class() -> Column:
    """Linked sets are of one class of sizes or of two next to each other."""
    return F.floor(F.log("n") / math.log(100.01 / LINK_PERCENT)).cast("int")


def _apart(near: DataFrame, few: bool) -> tuple[DataFrame, int, int]:
    """The labelled members of near that a member of another component, of a class of sizes next to theirs, may be linked to,
    with their class and how many such members there are; how many they are, and how many pairs at most. few: whether what
    is told of their hubs may be broadcast."""
    classed = near.withColumn("class", size_class())
    per = classed.groupBy("hub", "class").agg(
        F.min("n").alias("least_n"), F.max("most").alias("most_most"), F.min("component").alias("first"), F.max("component").alias("last"),
        F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("free"),
    )
    per = per.withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))).groupBy("hub", "class").agg(
        F.min("least_n").alias("least_n"), F.max("most_most").alias("most_most"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("members").alias("members"), F.sum("free").alias("free"),
    )
    other = (F.col("first") != F.col("component")) | (F.col("last") != F.col("component"))
    met = classed.join(_broadcast_if(few, per.where("free > 0")), ["hub", "class"]).where(other & (F.col("least_n") <= F.col("most")) & (F.col("most_most") >= F.col("n")))
    apart = saved(met.drop("least_n", "most_most", "first", "last", "free"))
    n, pairs = apart.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(~F.col("linked"), F.col("members"))), F.lit(0))).first()
    return apart, n, pairs


def _fits() -> Column:
    return (F.col("component") != F.col("component_b")) & (F.col("n") <= F.col("most_b")) & (F.col("n_b") <= F.col("most"))


def further_hubs(apart: DataFrame) -> DataFrame:
    """(hub, class, rep): for each hub and class of sizes the member that isn't linked to the hub and has most of its set in
    common with others."""
    free = apart.where("not linked")
    return free.groupBy("hub", "class").agg(F.max_by("rep", F.struct((F.col("most") / F.col("n")).alias("part"), "rep")).alias("rep"))


def with_further_hubs(apart: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs (hub, rep) of the chosen members with those of their hub that they may be linked to."""
    own = apart.join(chosen, ["hub", "class", "rep"]).withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)))
    return _as_pairs(apart.join(_mate(own, "hub", "class"), ["hub", "class"]).where(_fits()))


def pairs_apart(apart: DataFrame, few: bool) -> DataFrame:
    """All pairs of members of one hub that may be linked and aren't connected. A hub's members are dealt to as many tasks
    as it takes for each to pair PAIRED of them with the others. few: whether what is told of hubs may be broadcast."""
    tasks = F.ceil(F.col("members") / PAIRED).cast("int")
    copied = apart.where("not linked").withColumn("class", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))).select("hub", "class", "rep", "n", "most", "linked", "component")
    split = apart.groupBy("hub", "class").agg(F.max(tasks).alias("tasks"))
    copied = copied.join(_broadcast_if(few, split), ["hub", "class"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    dealt = apart.withColumn("task", F.pmod(F.xxhash64("rep"), tasks).cast("int"))
    return _as_pairs(dealt.join(_mate(copied, "hub", "class", "task"), ["hub", "class", "task"]).where(_fits()))


def relabelled(apart: DataFrame, links: DataFrame) -> DataFrame:
    """apart with the components that links (u, v) join under one name, as far as one step leads: members that agree in it
    are connected."""
    names = apart.select("rep", "component").distinct()
    u, v = names.select(F.col("rep").alias("u"), F.col("component").alias("cu")), names.select(F.col("rep").alias("v"), F.col("component").alias("cv"))
    joined = links.join(u, "u").join(v, "v").select(F.greatest("cu", "cv").alias("component"), F.least("cu", "cv").alias("lower")).where("component <> lower")
    lower = saved(joined.groupBy("component").agg(F.min("lower").alias("lower")))
    few = lower.count() <= MAX_BROADCAST_IDS  # as in classes(), a large component is a hot key
    return apart.join(_broadcast_if(few, lower), "component", "left").withColumn("component", F.coalesce("lower", "component")).drop("lower")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v): the smallest node reachable.

    Large-star and small-star steps in turn: every node hands its neighbours on to the smallest one, until all edges
    lead to the smallest node of their component. Each step takes the minimum of a node's neighbours by partial sums
    and joins it with the edges, which aren't shuffled for it while there are few; edges are written to the shared folder
    between steps.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        few = 2 * (now.count() if state is None else state[0]) <= MAX_BROADCAST_IDS  # an edge has two nodes
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(_broadcast_if(few, least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_broadcast_if(few, lowest), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u <> v").distinct())
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def find_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v): links between representatives by which all that are linked are connected."""
    held = held_keys(reps)
    degree = held.groupBy("rep").agg(F.sum("size").alias("degree"))
    candidates = saved(degree.join(reps.select("rep", "doc", "digest"), "rep"))
    few = candidates.count() <= MAX_BROADCAST_IDS
    sets = saved(member_sets(docs, candidates.select("rep", "doc", "digest")))
    # a key's hub is the best that any of its members meets under any key, so that a group of copies has few of them
    rank = F.struct("degree", F.col("rep").alias("hub"))
    top = held.join(_broadcast_if(few, candidates.select("rep", rank.alias("rank"))), "rep").groupBy("key").agg(F.max("rank").alias("top"))
    met = held.join(top, "key").groupBy("rep").agg(F.max("top").alias("met"))
    best = held.join(_broadcast_if(few, met), "rep").groupBy("key").agg(F.max("met").alias("best"))
    # members meet their key's own best as well: a document between two groups may have led their keys to the other's hub
    both = best.join(top, "key").select("key", F.explode(F.array_distinct(F.array("best.hub", "top.hub"))).alias("hub"))
    pairs = saved(held.join(both, "key").where("rep <> hub").select("hub", "rep").distinct())
    compared = saved(compare(pairs, sets, residues=True))
    links = _linked(compared)
    component = saved(components(links))
    meeting, near = second_round(compared, component)
    few = compared.count() <= MAX_BROADCAST_IDS
    later, found = open_pairs(_labelled(near, component), sets, few)
    rest = saved(meeting)
    links = links.unionByName(saved(_linked(compare(rest if later is None else rest.unionByName(later), sets))))
    return links if found is None else links.unionByName(found)


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("linked and hub <> rep").select(F.col("hub").alias("u"), F.col("rep").alias("v"))


def open_pairs(near: DataFrame, sets: DataFrame, few: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """The pairs (hub, rep) of labelled members that are still to be compared, and the links (u, v) found on the way. None: there are
    none.

    Where the bound on their number is high, they are listed to be counted, which compares no sets. Further hubs are taken
    only if there are many indeed.
    """
    links = None
    apart, n, bound = _apart(near, few)
    for left in range(ROUNDS, -1, -1):
        if not bound:
            return None, links
        if not left or bound <= LISTED_PER_MEMBER * n:
            pairs = saved(pairs_apart(apart, few))
            if not left or bound <= PAIRS_PER_MEMBER * n or pairs.count() <= PAIRS_PER_MEMBER * n:
                return pairs, links
        chosen = saved(further_hubs(apart))
        found = saved(_linked(compare(saved(with_further_hubs(apart, chosen)), sets)))
        links = found if links is None else links.unionByName(found)
        apart, n, bound = _apart(relabelled(apart.drop("class", "members"), found).join(chosen, ["hub", "rep"], "left_anti"), few)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_shingles, component_id) of each row of docs; t is a hash of its text."""
    rows = saved(sketch(docs))
    full = rows.where("digest is not null and doc_id is not null")
    reps = full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"))
    reps = saved(reps.withColumn("rep", F.xxhash64("digest")))
    found = saved(components(find_links(docs, reps)))
    few = found.count() <= MAX_BROADCAST_IDS  # a large component is a hot key, which isn't shuffled for as long as that can be helped
    members = reps.select("rep", "doc").join(_broadcast_if(few, found.withColumnRenamed("node", "rep")), "rep")
    first = members.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_rep = found.join(_broadcast_if(few, first), "component").select(F.col("node").alias("rep"), "component_id")
    named = reps.select("digest", "rep", "doc").join(_broadcast_if(few, by_rep), "rep", "left").select("digest", F.coalesce("component_id", "doc").alias("component_id"))
    out = rows.select("doc_id", "t", "n_shingles", "digest").join(saved(named), "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "t", "n_shingles", own.cast("long").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text; other columns are not looked at).

    Rows with equal shingle sets are one class. Links are those of 100 * intersection >= 75 * union of the whole sets, of
    64-bit hashes of shingles. A component is named by its smallest doc_id.

    Null and empty texts have no shingles and are their own component. Rows without doc_id are linked with nothing, have
    a null component and are kept. Rows that repeat a doc_id are documents of their own with one id. An empty table gives an
    empty result.
    """
    return classes(docs).drop("t").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of docs, that with the smallest doc_id, and all rows without doc_id.

    Where rows repeat that doc_id with several texts of the component, the text with the smallest hash stays; of rows that
    repeat a text as well, the first in order of a hash of all columns. Other components judge rows of that doc_id for
    themselves, empty texts of it among one another.
    """
    kept = classes(docs).where("doc_id = component_id").groupBy("component_id", (F.col("n_shingles") == 0).alias("bare")).agg(F.min("t").alias("_nd_kept"))
    kept = kept.select(F.col("component_id").alias("_nd_id"), "_nd_kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("_nd_row"), F.col("doc_id").alias("_nd_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_nd_text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_nd_order"))
    met = marked.join(kept, (F.col("_nd_doc") == F.col("_nd_id")) & (F.col("_nd_text") == F.col("_nd_kept")), "left_semi")
    order = W.partitionBy("_nd_doc", "_nd_text").orderBy("_nd_order")
    first = met.withColumn("_nd_place", F.row_number().over(order)).where("_nd_place = 1")
    return first.select(*[F.col(f"_nd_row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
