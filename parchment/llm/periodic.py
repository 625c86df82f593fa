"""Runs: stretches of words that repeat with a period.

The longest Lyndon word at each place is that up to the next smaller suffix, which a stack scanned from right to left holds; a
run has such words of its own period under the order of words or its inverse, so a run is found by extending each Lyndon
word to both sides as far as words one period apart are equal. Suffixes are compared, and Lyndon words extended, by their
longest common extension: some words directly, then a binary search over rolling hashes, whose answer is verified word by
word. There is no suffix array.

Most of a text can't be part of a run. A run of period q, w <= q < 2w, and at least four periods has at least 2w + 1 places in
a row where the w words from there on come again less than 2w words later. Hashes of words exclude all other places, for w
of 1, 2, 4 and so on and for many texts at once; where hashes collide, too much is scanned, never too little.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.hashing import grouped, mix, word_hashes

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words that are compared before hashes are.
DIRECT = 8
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
SCHEMA = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def may_repeat(hashes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches, apart from each other, outside of which no run lies; hashes of the words of texts, the k-th text's up to ends[k]."""
    text = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    gram = mix(hashes + text * np.uint64(_BASE))  # words of different texts are different
    alive, w, found = np.arange(len(gram)), 1, []
    near = np.flatnonzero(gram[:-1] == gram[1:])
    while True:
        if len(near):
            cut = np.flatnonzero(np.diff(near) > 1)
            first, last = near[np.append(0, cut + 1)], near[np.append(cut, len(near) - 1)] + 1
            long = last - first >= max(2 * w + 1, LEAST_LENGTH - 1 if w == 1 else 0)
            for at, to in zip(first[long].tolist(), last[long].tolist()):
                while at < to:
                    end = int(ends[np.searchsorted(ends, at, side="right")])
                    found.append((at, min(to + 3 * w, end)))
                    at = end
        alive = alive[alive < len(gram) - w]
        if not len(alive):
            break
        gram, w = mix(gram[:-w] * np.uint64(_BASE) + gram[w:]), 2 * w
        order = alive[np.argsort(gram[alive], kind="stable")]
        same = gram[order[:-1]] == gram[order[1:]]
        near = np.sort(order[:-1][same & (np.diff(order) < 2 * w)])
        alive = np.unique(np.concatenate([order[:-1][same], order[1:][same]]))
    begins, out = {0, *ends.tolist()}, []
    for first, last in sorted(found):
        if out and first <= out[-1][1] and first not in begins:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        elif out and first == out[-1][0]:
            out[-1] = (first, max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


class Words:
    """Words as numbers, with their longest common extensions."""

    def __init__(self, numbers: list[int]):
        self.n, self.at = len(numbers), numbers
        self.sums, self.powers = [0], [1]
        total, power = 0, 1
        for x in numbers:
            total = (total * _BASE + x + 1) & _MASK
            power = power * _BASE & _MASK
            self.sums.append(total)
            self.powers.append(power)
        #: By distance: the last stretch [from, to) known to equal the one that far to the right, and to end with `to`.
        self.known: dict[int, tuple[int, int]] = {}

    def hash(self, i: int, length: int) -> int:
        return (self.sums[i + length] - self.sums[i] * self.powers[length]) & _MASK

    def forward(self, i: int, j: int) -> int:
        """How many words from i and from j > i on are equal. Asked from right to left, so what is known of a distance is used."""
        at, most = self.at, self.n - j
        here = min(DIRECT, most)
        for k in range(here):
            if at[i + k] != at[j + k]:
                return k
        if here == most:
            return most
        known = self.known.get(j - i)
        bound = known[0] - i if known else most
        length = self._search(i, j, min(here, bound), bound, 1)
        if known and length == bound:
            length = known[1] - i
        self.known[j - i] = (i, i + length)
        return length

    def backward(self, i: int, j: int) -> int:
        """How many words up to and with i and j > i are equal."""
        return self._search(i, j, 0, i + 1, -1)

    def _search(self, i: int, j: int, low: int, high: int, step: int) -> int:
        """The longest extension from low to high, by binary search over hashes; all its words are compared then."""
        least = low
        while low < high:
            mid = (low + high + 1) // 2
            a, b = (i, j) if step > 0 else (i - mid + 1, j - mid + 1)
            if self.hash(a, mid) == self.hash(b, mid):
                low = mid
            else:
                high = mid - 1
        a, b = (i, j) if step > 0 else (i - low + 1, j - low + 1)
        if self.at[a : a + low] == self.at[b : b + low]:
            return low
        low = least  # hashes collided
        while self.at[i + step * low] == self.at[j + step * low]:
            low += 1
        return low


def find_runs(numbers: list[int], least: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least `least` words and `periods` periods (2 or more), ordered."""
    words, runs, n = Words(numbers), set(), len(numbers)
    at = words.at
    for sign in (1, -1):
        covered: dict[int, int] = {}  # by period: where its last run starts
        words.known.clear()
        following = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                a, b = at[i], at[j]
                if a == b:
                    k = words.forward(i, j)
                    if j + k == n:
                        break  # the later suffix is a prefix, and so the smaller one
                    a, b = at[i + k], at[j + k]
                if sign * a > sign * b:
                    break
                j = following[j]
            following[i] = j
            q = j - i
            # some root of a run starts in its first period, so at least periods - 2 whole periods follow the one after it
            if i + (periods - 1) * q > n or at[i] != at[i + (periods - 2) * q] or covered.get(q, n) <= i:
                continue
            right = words.forward(i, j) if j < n else 0
            if right < (periods - 2) * q:
                continue
            left = words.backward(i - 1, j - 1) if i else 0
            covered[q] = i - left
            length = left + q + right
            if length >= max(least, periods * q):
                runs.add((i - left, length, q))
    return sorted(runs)


def edit_place(doc_id: str | None, n: int) -> tuple[int, int] | None:
    """(a, p) of the contract: from word a on a text of n words repeats p words; None where it stays as it is."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _describe(runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, length, q in runs:
            drop[s + q] += 1
            drop[s + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def text_runs(texts: list[bytes], edited_as: list[str | None] | None = None) -> list[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """The runs and the words of each text; with the doc_ids in edited_as, after their edits."""
    hashes, counts = word_hashes(texts)
    split = [t.split() for t in texts]
    stops = np.cumsum(counts)
    for k, doc_id in enumerate(edited_as or []):
        if edit := edit_place(doc_id, len(split[k])):
            a, p = edit
            own = hashes[stops[k] - counts[k] : stops[k]]
            own[a:] = own[a + np.arange(len(own) - a) % p]
            period, rest = split[k][a : a + p], len(split[k]) - a
            split[k][a:] = (period * (rest // p + 1))[:rest]
    runs: list[list] = [[] for _ in texts]
    for first, last in may_repeat(hashes, stops) if len(hashes) else []:
        k = int(np.searchsorted(stops, first, side="right"))
        begin = first - int(stops[k] - counts[k])
        number: dict[bytes, int] = {}
        numbers = [number.setdefault(w, len(number)) for w in split[k][begin : begin + last - first]]
        runs[k] += [(begin + s, length, q) for s, length, q in find_runs(numbers)]
    return list(zip(runs, split))


def document_runs(docs: DataFrame, edited: bool = False) -> DataFrame:
    """For each document (doc_id, text): doc_id, n_runs, start, length, period and exponent_milli of its longest run (ties: smallest
    start, then period), runs_sha256 of all runs and collapsed_sha256 of the text without the repeats of its runs' first periods.
    With `edited`, texts are first changed as edit_place says.

    Null and empty texts have no words and no runs: four nulls, and the digests of empty strings. Rows without doc_id aren't
    edited. Repeated rows give repeated results. Of no documents there are no rows. Other columns are passed over.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out = batch["doc_id"].tolist(), []
            for texts in grouped(batch["text"]):
                own = ids[len(out) : len(out) + len(texts)]
                out += [(d, *_describe(*found)) for d, found in zip(own, text_runs(texts, own if edited else None))]
            frame = pd.DataFrame(out, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
            numbers = ["start", "length", "period", "exponent_milli"]
            yield frame.astype({c: "Int64" for c in numbers})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    return rows.mapInPandas(find, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
