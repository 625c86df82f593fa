"""SentencePiece encoding and decoding: the best and the N best segmentations over the lattice of pieces.

A piece of rank r has the log-probability of Zipf's law, -ln(r + 1) - ln(sum of 1 / r); the model file's scores are ranks.
A character that is no piece is spelt in byte pieces, which together are one edge of the lattice.

Pieces hold white space at their front alone, so every segmentation of a text is one of its units, runs of blanks with
what follows them, one after the other. A unit's best segmentations come from a backward A-star search that takes the
forward Viterbi scores as exact heuristic. Those of a text are its units' best ones but for a few units: each of the N - 1
next best texts departs from the best one, and the N - 1 units that lose least by departing already give as many.

The heuristic is exact, so of the edges that end at a place one keeps the promise of the state that is expanded; the search
follows it to the start at once, ties or not, and of all other states keeps only as many as segmentations are still
wanted. The work for a unit is N times its length, in bounded memory.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import give_back
from parchment.llm.hashing import mix

N_BEST = 4
UNKNOWN_PENALTY = 10.0
CACHED_UNITS, CACHED_CHARS = 300_000, 8_000_000
#: Units with more characters are taken one by one, shorter ones in batches.
LONG = 48
SPACE = "▁"
#: Rows of a batch that are taken from Arrow's buffers together.
AT_ONCE = 400
SCHEMA = "doc_id long, n_units long, n_tokens long, ids binary, score double, nbest array<struct<score: double, n_tokens: long, ids_crc32: long>>, decoded_equal boolean"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("score", pa.float64()),
    ("nbest", pa.list_(pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))), ("decoded_equal", pa.bool_()),
])
_STEP = np.uint64(0x9E3779B97F4A7C15)

_codecs: dict = {}


def units(text: str) -> list[str]:
    """The units of a text that has a blank put before it, each without its first blank."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], 0
    for part in parts[:-1]:
        if part:
            out.append(" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    out.append(" " * blanks + parts[-1])
    return out


class PieceCodec:
    """Segmentation, ids and decoding for one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.spelling = [p.encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            self.spelling[i] = bytes([b])
        assert len(self.byte_ids) == 256, "the model has no byte fallback"
        assert not any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain), "a piece has white space inside"
        ranks = np.array([-model.get_score(i) for i in plain])
        scores = -np.log1p(ranks) - np.log(np.sum(1 / (1 + np.arange(len(plain)))))
        self.scores = np.full(len(self.pieces), -np.inf)
        self.scores[plain] = scores
        self.unknown = float(scores[ranks < len(self.pieces)].min()) - UNKNOWN_PENALTY
        self.table = {self.pieces[i]: i for i in plain}
        self.prefixes = {p[:k] for p in self.table for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.table))
        hashes = self._hashes([self.pieces[i] for i in plain])
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(plain)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hashes & np.uint64((1 << 22) - 1)] = True
        # the place of each hash by its lowest bits; those few that lose theirs to another are looked for in order
        self.slots = np.zeros(1 << 22, np.int32)
        low = self.hashes & np.uint64((1 << 22) - 1)
        self.slots[low] = np.arange(len(low))
        lost = np.flatnonzero(self.slots[low] != np.arange(len(low)))
        self.shared = np.zeros(1 << 22, bool)
        self.shared[low[lost]] = True
        self.steps = np.append(self.scores, -np.inf)  # that of id -1 last
        self.widths = np.array([len(x) for x in self.spelling])
        self.forget()
        self.nbest_of: dict = {}

    def forget(self) -> None:
        """Known units: their places in the score, the loss of the second best, the ids, and what those decode to that don't give
        the unit back."""
        self.place, self.best, self.loss, self.ids, self.other_texts, self.chars = {}, np.zeros(0), np.zeros(0), [], {}, 0

    @staticmethod
    def _hashes(texts: list[str]) -> np.ndarray:
        """The hashes that solve() keeps up for growing substrings, of texts in any order."""
        out, length = np.zeros(len(texts), np.uint64), np.array([len(t) for t in texts])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            chars = np.frombuffer("".join(texts[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = h * _STEP + mix(chars[:, i].astype(np.uint64) + np.uint64(1))
            out[at] = mix(h)
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        h = mix(h)
        ids = np.full(h.shape, -1, np.int32)
        at = np.nonzero(self.maybe[h & np.uint64((1 << 22) - 1)])
        some = h[at]
        low = some & np.uint64((1 << 22) - 1)
        place = self.slots[low]
        if len(twice := np.flatnonzero(self.shared[low])):
            place[twice] = np.minimum(np.searchsorted(self.hashes, some[twice]), len(self.hashes) - 1)
        ids[at] = np.where(self.hashes[place] == some, self.hash_ids[place], -1)
        return ids

    def _spell(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def solve(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For units of about one length: the score of the best segmentation, what the second best loses, and the best ids.
        All units go through the forward Viterbi pass together, the shorter ones filled up with a character of no piece."""
        n, lengths = len(some), np.array([len(u) for u in some])
        length, rows = int(lengths.max()), np.arange(len(some))
        chars = np.frombuffer("".join(u.ljust(length, "\0") for u in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        letters = mix(chars.T.astype(np.uint64, order="C") + np.uint64(1))  # a row for each place, so that all units are read side by side
        found, h = [], np.zeros((length, n), np.uint64)
        for width in range(1, min(self.longest, length) + 1):
            h = h[: length - width + 1] * _STEP + letters[width - 1 :]
            found.append(self._find(h))
        held = [ids.max(axis=1) >= 0 for ids in found]
        best, second = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        back = np.zeros((length + 1, n), np.int16)
        best[0] = 0
        for end in range(1, length + 1):
            for width in range(1, min(self.longest, end) + 1):
                if width > 1 and not held[width - 1][end - width]:
                    continue
                step = self.steps[found[width - 1][end - width]]
                if width == 1:
                    step[np.isneginf(step)] = self.unknown
                first, other = best[end - width] + step, second[end - width] + step
                better = first > best[end]
                second[end] = np.maximum(np.maximum(second[end], other), np.where(better, best[end], first))
                best[end] = np.where(better, first, best[end])
                back[end][better] = width
        at, steps = lengths.copy(), []
        while (at > 0).any():
            width = back[at, rows]
            chosen = np.full(n, -2, np.int32)
            for w in np.unique(width[at > 0]):
                here = np.flatnonzero((width == w) & (at > 0))
                chosen[here] = found[w - 1][at[here] - w, here]
            steps.append(np.where(chosen == -1, -3 - (at - 1), chosen))
            at = at - np.where(at > 0, width, 0)
        steps = np.stack(steps[::-1], axis=1)
        keep = steps != -2
        plain = (steps >= -2).all(axis=1)
        ends = np.cumsum(keep.sum(axis=1)) * 4
        flat = steps[keep].astype("<i4").tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero(~plain).tolist():
            spelt = [x for s in steps[i][keep[i]].tolist() for x in ([s] if s >= 0 else self._spell(some[i][-3 - s]))]
            out[i] = np.array(spelt, "<i4").tobytes()
        return best[lengths, rows], best[lengths, rows] - second[lengths, rows], out

    def _edges(self, text: str) -> list[list[tuple[int, float, int]]]:
        """For each place of a text the pieces that start there: (end, score, id), id -1 for a character in byte pieces."""
        table, prefixes, scores, out = self.table, self.prefixes, self.scores, []
        for start in range(len(text)):
            here = []
            for end in range(start + 1, min(len(text), start + self.longest) + 1):
                piece = text[start:end]
                if piece in table:
                    here.append((end, float(scores[table[piece]]), table[piece]))
                elif end == start + 1:
                    here.append((end, self.unknown, -1))
                if piece not in prefixes:
                    break
            out.append(here)
        return out

    def _ids(self, text: str, steps: list[tuple[int, int]]) -> list[int]:
        """The ids of a segmentation from its (start, id) in order."""
        return [x for start, piece in steps for x in ([piece] if piece >= 0 else self._spell(text[start]))]

    def solve_long(self, text: str) -> tuple[float, float, bytes]:
        """What solve gives, for one unit of any length."""
        best, second, back = [0.0] + [-np.inf] * len(text), [-np.inf] * (len(text) + 1), [(0, 0)] * (len(text) + 1)
        for start, edges in enumerate(self._edges(text)):
            for end, weight, piece in edges:
                first, other = best[start] + weight, second[start] + weight
                if first >= best[end]:
                    second[end], best[end], back[end] = max(best[end], other), first, (start, piece)
                else:
                    second[end] = max(second[end], first)
        at, steps = len(text), []
        while at > 0:
            steps.append(back[at])
            at = back[at][0]
        return best[-1], best[-1] - second[-1], np.array(self._ids(text, steps[::-1]), "<i4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Adds units to what is known, short ones in batches of about one length."""
        some = sorted(new, key=len)
        n_short = bisect.bisect(some, LONG, key=len)
        best, loss, at = [self.best], [self.loss], 0
        while at < n_short:
            part = some[at : at + max(1, (1 << 18) // (len(some[at]) + 2))]
            part = part[: bisect.bisect(part, len(part[0]) + 1, key=len)]
            part = [u for u in part if len(u) <= LONG]
            solved = self.solve([SPACE + u.replace(" ", SPACE) for u in part])
            self._add(part, solved[2])
            best.append(solved[0])
            loss.append(solved[1])
            at += len(part)
        for unit in some[n_short:]:
            score, lost, ids = self.solve_long(SPACE + unit.replace(" ", SPACE))
            self._add([unit], [ids])
            best.append(np.array([score]))
            loss.append(np.array([lost]))
        self.best, self.loss = np.concatenate(best), np.concatenate(loss)

    def _add(self, part: list[str], ids: list[bytes]) -> None:
        self.place.update(zip(part, range(len(self.ids), len(self.ids) + len(part))))
        self.ids += ids
        for u, i in zip(part, ids) if not self._spelt_alike(part, ids) else ((u, i) for u, i in zip(part, ids) if SPACE in u):
            if (text := self._text(np.frombuffer(i, "<i4"))) != f" {u}":
                self.other_texts[u] = text
        self.chars += sum(map(len, part))

    def _spelt_alike(self, part: list[str], ids: list[bytes]) -> bool:
        """Whether the ids of each unit spell just that unit, by the bytes of all and by the number of bytes of each."""
        flat = np.frombuffer(b"".join(ids), "<i4")
        wanted = [(SPACE + u.replace(" ", SPACE)).encode("utf-8", "surrogatepass") for u in part]
        ends = np.cumsum([len(i) // 4 for i in ids])
        upto = np.cumsum(self.widths[flat])[ends - 1]
        return bool((upto == np.cumsum([len(w) for w in wanted])).all()) and b"".join(map(self.spelling.__getitem__, flat.tolist())) == b"".join(wanted)

    def learn(self, texts: list[list[str]]) -> None:
        wanted = set().union(*texts)
        new = wanted - self.place.keys()
        if len(self.place) + len(new) > CACHED_UNITS or self.chars > CACHED_CHARS:
            self.forget()
            new = wanted
        if new:
            self._learn(new)

    def nbest_unit(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a unit, best first: a backward A-star search from its end. A state is a place with
        the pieces after it; its promise is their score plus the forward Viterbi score up to the place, and is held as
        what it loses against the best segmentation."""
        return [(score, np.frombuffer(ids, "<i4").tolist()) for score, ids in self._nbest(unit, n)]

    def _nbest(self, unit: str, n: int) -> tuple[tuple[float, bytes], ...]:
        key = (unit, n)
        if key in self.nbest_of:
            return self.nbest_of[key]
        text = SPACE + unit.replace(" ", SPACE)
        ahead, ending = [0.0] + [-np.inf] * len(text), [[] for _ in range(len(text) + 1)]
        for start, edges in enumerate(self._edges(text)):
            for end, weight, piece in edges:
                ahead[end] = max(ahead[end], ahead[start] + weight)
                ending[end].append((weight, start, piece))
        heap, order, out = [(0.0, 0, len(text), None)], 0, []
        while heap and len(out) < n:
            lost, _, at, chain = heapq.heappop(heap)
            wanted = n - len(out) - 1
            while at > 0:  # the best edge loses nothing: its state would be the next to be expanded
                here = sorted((ahead[at] - ahead[start] - weight, start, piece) for weight, start, piece in ending[at])
                for less, start, piece in here[1 : wanted + 1]:
                    order += 1
                    heapq.heappush(heap, (lost + less, order, start, ((start, piece), chain)))
                chain, at = (here[0][1:], chain), here[0][1]
                if len(heap) > 64 + 4 * wanted:
                    heap = heapq.nsmallest(wanted, heap)
            steps = []
            while chain is not None:
                step, chain = chain
                steps.append(step)
            out.append((ahead[-1] - lost, np.array(self._ids(text, steps), "<i4").tobytes()))
        if len(unit) <= LONG:
            if len(self.nbest_of) > 50_000:
                self.nbest_of.clear()
            self.nbest_of[key] = tuple(out)
        return tuple(out)

    def encode(self, split: list[str], n: int) -> tuple[list[bytes], str, float, list[tuple[float, list[tuple[int, bytes]]]]]:
        """The best ids of each learnt unit of a text, what they decode to, their score, and for each of the text's n best
        segmentations the score and the units that differ from the best one, with their ids."""
        places = list(map(self.place.__getitem__, split))
        at = np.array(places, np.int64)
        score, loss = float(self.best[at].sum()), self.loss[at]
        ways: list[tuple[float, list[tuple[int, bytes]]]] = [(0.0, [])]
        for i in self._least(loss, min(n - 1, len(at))).tolist():
            if not np.isfinite(loss[i]):
                continue
            own = self._nbest(split[i], n)
            # among equal scores the search may come upon another one than the forward pass first
            others = [(s - own[0][0], ids) for s, ids in own]
            options = [(0.0, [])] + [(lost, [(i, ids)]) for lost, ids in others if ids != self.ids[places[i]]]
            ways = sorted(((a + b, x + y) for a, x in ways for b, y in options), key=lambda w: -w[0])[:n]
        other = self.other_texts
        decoded = " ".join(split) if not other or other.keys().isdisjoint(split) else "".join([other.get(u) or f" {u}" for u in split])[1:]
        return list(map(self.ids.__getitem__, places)), decoded, score, [(score + lost, changes) for lost, changes in ways]

    @staticmethod
    def _least(loss: np.ndarray, k: int) -> np.ndarray:
        """The places of the k least losses, the first ones among equals."""
        bound = np.partition(loss, k - 1)[k - 1] if k else -np.inf
        near = np.flatnonzero(loss <= bound)
        return near[np.argsort(loss[near], kind="stable")][:k]

    def _text(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.spelling.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").replace(SPACE, " ")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank that was put before it."""
        return self._text(ids)[1:]


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, n_units, n_tokens, ids (little-endian 32-bit), score, nbest and decoded_equal of each row of docs.

    ids and score are of the best segmentation of the whole text; nbest has score, number and crc32 of the ids of the n
    best, or of all there are; equal scores stand in the order of the search. decoded_equal tells whether the ids decode to
    the text; U+2581 itself decodes to a blank. Null and empty texts have no ids and one segmentation of score 0.
    Each row is encoded for itself; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                texts = some["text"].to_pylist()
                split = [units(t) for t in texts]
                own.learn(split)
                rows = []
                for doc_id, text, parts in zip(some["doc_id"].to_pylist(), texts, split):
                    best, decoded, score, ways = own.encode(parts, n)
                    ids, found = b"".join(best), []
                    for total, changes in ways:
                        other = ids
                        if changes:
                            each = best.copy()
                            for i, changed in changes:
                                each[i] = changed
                            other = b"".join(each)
                        found.append({"score": total, "n_tokens": len(other) // 4, "ids_crc32": zlib.crc32(other)})
                    rows.append((doc_id, len(parts), len(ids) // 4, ids, score, found, decoded == text))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ARROW)], schema=ARROW)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from doc_id and ids as encode_documents gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [own.decode(np.frombuffer(i, "<i4")) for i in batch["ids"]]})

    return encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))
