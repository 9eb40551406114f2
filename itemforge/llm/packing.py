"""Packing of tokenised documents into sequences of bounded length.

Each scan task cuts its documents into pieces and packs them batch by batch, so nothing is
shuffled and memory stays at one batch. Pieces of a full sequence stand alone. Of the others, a
batch is dealt over its windows by Karmarkar-Karp differencing: partial partitions are merged, the
two of the largest spread first, each one's largest windows onto the other's smallest. The number
of windows starts at what the tokens need and rises by one as long as a window is over capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import workspace
from itemforge.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def differencing(weights: list[int], k: int) -> list[list[int]]:
    """Positions of the weights in k groups of near-equal sums. Ties go by position."""
    if k == 1:
        return [list(range(len(weights)))]
    if len(weights) <= k:
        return [[i] for i in range(len(weights))] + [[] for _ in range(k - len(weights))]
    # Each run of k weights in order of size begins as a partial partition, a weight to a window.
    # Its sums are kept descending; nested tuples hold what was merged.
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    heap: list = []

    def push(sums: np.ndarray, groups: list, tie: int) -> None:
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tie, sums, groups))

    for at in range(0, len(order), k):
        part = order[at : at + k]
        sums = np.zeros(k, dtype=np.int64)
        sums[: len(part)] = [weights[i] for i in part]
        push(sums, [(i,) for i in part] + [()] * (k - len(part)), at)
    tie = len(order)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        sums = a + b[::-1]
        by = np.argsort(-sums, kind="stable")
        groups = [(of_a[i], of_b[k - 1 - i]) for i in by.tolist()]
        push(sums[by], groups, tie)
        tie += 1

    def leaves(node) -> list[int]:
        found, stack = [], [node]
        while stack:
            for x in stack.pop():
                if isinstance(x, tuple):
                    stack.append(x)
                else:
                    found.append(x)
        return sorted(found)

    return [leaves(g) for g in heap[0][3]]


def windows(weights: list[int], capacity: int) -> list[list[int]]:
    """Groups of near-equal sums, none over capacity; their number rises until all fit."""
    k = max(1, -(-sum(weights) // capacity))
    while True:
        groups = differencing(weights, k)
        if all(sum(weights[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def cut(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then pieces of at most a grain."""
    full = n - n % capacity
    found = [(s, capacity) for s in range(0, full, capacity)]
    return found + [(s, min(grain, n - s)) for s in range(full, n, grain)]


def tail_sizes(n: int, capacity: int) -> list[int]:
    """Powers of two within the capacity that make n, largest first."""
    top = 1 << capacity.bit_length() - 1
    return [top] * (n // top) + [1 << b for b in range(top.bit_length() - 2, -1, -1) if n >> b & 1]


class Packer:
    """Packs one task's documents. Rows come out as tuples in the order of SCHEMA."""

    def __init__(self, capacity: int, grain: int, batch: int, task: int):
        self.capacity, self.grain, self.batch = capacity, grain, batch
        self.sequence = task << 33
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held = 0

    def _row(self, piece: tuple, offset: int, size: int) -> tuple:
        doc, start, ids, n = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), n, self.sequence, offset, size

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        size, offset = sum(len(p[2]) // 4 for p in pieces), 0
        for p in pieces:
            yield self._row(p, offset, size)
            offset += len(p[2]) // 4
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        for start, length in cut(n, self.capacity, self.grain):
            piece = (doc, start, ids[4 * start : 4 * (start + length)], n)
            if length == self.capacity:
                yield from self._sequence([piece])
            else:
                self.open.append(piece)
                self.held += length
        if self.held >= 2 * self.batch * self.capacity:
            yield from self._pack(self.batch * self.capacity)

    def _pack(self, tokens: int) -> Iterator[tuple]:
        """Packs pieces of so many tokens, in their order."""
        size = end = 0
        while end < len(self.open) and size < tokens:
            size += len(self.open[end][2]) // 4
            end += 1
        now, self.open = self.open[:end], self.open[end:]
        self.held -= size
        for group in windows([len(p[2]) // 4 for p in now], self.capacity):
            yield from self._sequence([now[i] for i in group])

    def finish(self) -> Iterator[tuple]:
        """Packs the rest. What its windows would hold beyond 63 parts of 64 is cut off the end into
        sequences of powers of two, which need no padding; so the last windows are as full as others."""
        whole, tail = self.held // self.capacity, []
        keep = whole * self.capacity - whole * self.capacity // 64
        while self.held > keep:
            doc, start, ids, n = self.open.pop()
            length = len(ids) // 4
            drop = min(length, self.held - keep)
            if drop < length:
                self.open.append((doc, start, ids[: 4 * (length - drop)], n))
            tail.append((doc, start + length - drop, ids[4 * (length - drop) :], n))
            self.held -= drop
        if self.open:
            yield from self._pack(self.held)
        left = deque(reversed(tail))
        for size in tail_sizes(sum(len(p[2]) // 4 for p in left), self.capacity):
            pieces, room = [], size
            while room:
                doc, start, ids, n = left.popleft()
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], n))
                if take < len(ids) // 4:
                    left.appendleft((doc, start + take, ids[4 * take :], n))
                room -= take
            yield from self._sequence(pieces)


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), strict=True)))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 2048,
    grain: int = 512,
    batch: int = 256,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most `capacity`.

    Returns SCHEMA, a row for each piece: ids_crc32 is over the piece's ids, start counts its
    document's ids before it, offset the ids before it in its sequence. `grain` bounds the pieces
    that are dealt over windows, `batch` is the number of windows dealt at once. A null or empty
    text is a document of the end id alone; a null id stays null; repeated rows are packed each for
    itself; other columns are not read. An empty table gives no rows.
    """
    workspace.ship(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(tokenizer).encode_all, Packer(capacity, grain, batch, TaskContext.get().partitionId()), []
        for b in batches:
            for doc, found in zip(b.column(0).to_pylist(), encode(t.as_py() for t in b.column(1)), strict=True):
                rows += packer.add(doc, found + end)
                if len(rows) > 20_000:
                    yield _columns(rows, names)
                    rows = []
        rows += packer.finish()
        if rows:
            yield _columns(rows, names)

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA)
