"""Packing of token ids into sequences of one length, best fit decreasing.

A document is encoded and cut into full windows; what is left of it, less than a window, waits with others. The longest
comes first and goes to the open window with the least room that still holds it, which a segment tree over rooms finds; if
there is none, a window is opened. Windows that are filled but for a small slack are sequences; the pieces of all others wait
on, and at the end of a task they are left over. What the tasks have left over, a window or two each, is dealt once more by
its number of tokens and packed in the same way; what then fills no window is cut to fill them, and the rest of less than
one window is cut at powers of two, as sequences of such lengths need no padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import saved
from parchment.llm.token_file import END_ID, TEXTS_AT_ONCE, encoder

WINDOW = 4096
#: A window with at most so much room is done; it is padded.
SLACK = 32
#: Tokens that wait in a task until they are packed, and that a task of the last round takes.
HELD_TOKENS = 1 << 22
ROWS, ROW_BYTES = 4000, 16 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    length: int
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        """The first `at` tokens and the others."""
        return self._replace(length=at, ids=self.ids[: 4 * at]), self._replace(length=self.length - at, start=self.start + at, ids=self.ids[4 * at :])


class Rooms:
    """Open windows by the room they have. A node of the tree says whether a room of its range has a window."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = True
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with at least that room, which is open no more; None if there is none."""
        node = least + self.leaves
        while not self.any[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.any[2 * node])
        room = node - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.any[node] = False
            while node > 1 and not self.any[node ^ 1]:
                node >>= 1
                self.any[node] = False
        return room, window


def best_fit(pieces: list[Piece], size: int = WINDOW) -> list[list[Piece]]:
    """The pieces in windows of at most size tokens, those with the longest pieces first; ties by doc_id, start and ids."""
    rooms, windows = Rooms(size), []
    for piece in sorted(pieces, key=lambda p: (-p.length, p.doc_id is None, p.doc_id or 0, p.start, p.ids)):
        room, window = rooms.take(piece.length) or (size, len(windows))
        if window == len(windows):
            windows.append([])
        windows[window].append(piece)
        rooms.add(room - piece.length, window)
    return windows


def filled(pieces: list[Piece], size: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """The pieces in order, cut into windows without room, and what is left for less than one."""
    windows, open_, room = [], [], size
    for piece in pieces:
        while piece.length >= room:
            first, piece = piece.cut(room)
            windows.append([*open_, first])
            open_, room = [], size
        if piece.length:
            open_.append(piece)
            room -= piece.length
    return windows, open_


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in sequences whose lengths are the powers of two in their sum, longest first."""
    total, out = sum(p.length for p in pieces), []
    for k in range(total.bit_length() - 1, -1, -1):
        if total >> k & 1:
            windows, rest = filled(pieces, 1 << k)
            out.append(windows[0])
            pieces = [p for w in windows[1:] for p in w] + rest
    return out


def pack(pieces: list[Piece], size: int, slack: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of the pieces, and the pieces that wait on; none if this is the last round. So that what waits can't pile
    up, windows are cut full where most tokens would wait."""
    windows = best_fit(pieces, size)
    done = [w for w in windows if size - sum(p.length for p in w) <= slack]
    rest = [p for w in windows if size - sum(p.length for p in w) > slack for p in w]
    if last or 2 * sum(p.length for p in rest) > HELD_TOKENS:
        full, rest = filled(rest, size)
        done += full
    if last:
        done, rest = done + powers_of_two(rest), []
    return done, rest


def _packed(pieces: Iterator[Piece], size: int, slack: int, last: bool) -> Iterator[pd.DataFrame]:
    """Rows of SCHEMA of all sequences; what is left over has none."""
    task, n, rows, n_bytes, held, waiting = TaskContext.get().partitionId(), 0, [], 0, [], 0

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        rows.clear()
        return made.astype({"doc_id": "Int64", "sequence_id": "Int64"})

    def sequences() -> Iterator[list[Piece]]:
        nonlocal held, waiting
        for piece in pieces:
            if piece.length == size:
                yield [piece]
                continue
            held.append(piece)
            waiting += piece.length
            if waiting >= HELD_TOKENS:
                done, held = pack(held, size, slack, False)
                waiting = sum(p.length for p in held)
                yield from done
        done, held = pack(held, size, slack, last)
        yield from done

    for sequence in sequences():
        offset = 0
        for p in sequence:
            rows.append((p.doc_id, p.start, p.length, p.ids, p.doc_tokens, (task << 32 | n) << 1 | last, offset))
            offset += p.length
        n, n_bytes = n + 1, n_bytes + 4 * offset
        if len(rows) >= ROWS or n_bytes >= ROW_BYTES:
            yield frame()
            n_bytes = 0
    rows += [(p.doc_id, p.start, p.length, p.ids, p.doc_tokens, None, None) for p in held]
    if rows:
        yield frame().astype({"offset": "Int64"})


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = WINDOW, slack: int = SLACK, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all pieces: `length` token ids (little-endian unsigned 32-bit
    integers) of a document from its id number `start` on, which stand at `offset` in sequence `sequence_id`.

    A sequence has from size - slack to size tokens, or a power of two of them. Every document ends with end_id, so null and
    empty texts have that id alone. Each row is a document for itself, also if it repeats another or has no doc_id. Of no
    documents there are no pieces. Other columns of docs are passed over. The sequences depend on how docs are partitioned.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[Piece]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.iloc[at : at + TEXTS_AT_ONCE]
                for doc_id, ids in zip(some["doc_id"], words.encode(some["text"].tolist(), end_id)):
                    n, doc_id = len(ids) // 4, None if pd.isna(doc_id) else int(doc_id)
                    for start in range(0, n, size):
                        yield Piece(min(size, n - start), doc_id, start, ids[4 * start : 4 * (start + size)], n)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[Piece]:
        for batch in batches:
            for length, doc_id, start, ids, n in zip(*[batch[c] for c in ("length", "doc_id", "start", "ids", "doc_tokens")]):
                yield Piece(length, None if pd.isna(doc_id) else int(doc_id), start, bytes(ids), n)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    packed = saved(rows.mapInPandas(lambda batches: _packed(encoded(batches), size, slack, False), SCHEMA))
    left = packed.where("sequence_id is null")
    tasks = math.ceil((left.agg(F.sum("length")).first()[0] or 0) / HELD_TOKENS)
    last = left.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(max(tasks, 1)).mapInPandas(lambda batches: _packed(again(batches), size, slack, True), SCHEMA)
    return packed.where("sequence_id is not null").unionByName(last)
