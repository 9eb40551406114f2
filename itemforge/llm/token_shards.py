"""Token ids in shards of Re-Pair grammars.

A shard holds the ids of neighbouring documents as a grammar: the most frequent pairs of symbols give
way to new symbols, round after round, until no pair is left at `least` places. The rules and the
length of what each one stands for are stored with the sequence, so any range of ids is decoded
without the rest.

A round replaces many pairs at once: every pair at those of its places where no more frequent pair
overlaps it, so the result is what pairs taken singly would give but for ties in between. Counts are
kept up by place: a place takes part again only if its pair was frequent or holds a new symbol, since
the places of an old pair never grow in number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import ordered, workspace
from itemforge.llm.tokens import encoder

#: The first bytes of a shard, and its header: terminals, rules, symbols, bytes a symbol,
#: bytes a length.
MAGIC = b"RPG2"
HEADER = "<5I"
SHARD_SCHEMA = "part int, shard int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
RUN = 1 << 16
_NONE = np.uint32(0xFFFFFFFF)
#: The multiplier of the hash that counts pairs at first, and the bits of a slot.
_ODD, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 18


def _in_runs(seq: np.ndarray) -> np.ndarray:
    """The places of pairs of one symbol that overlap the one before: every second one of a run."""
    twice = np.flatnonzero(seq[1:] == seq[:-1])
    n = np.arange(len(twice))
    start = np.maximum.accumulate(np.where(np.diff(twice, prepend=-2) > 1, n, 0))
    return twice[(n - start) % 2 == 1]


def _frequent(places: np.ndarray, keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, ranks): pairs at `least` places or more, the most frequent first, and of each of
    their places which pair it is."""
    slot = (keys * _ODD >> np.uint64(64 - _SLOTS)).astype(np.int64)
    may = np.bincount(slot, minlength=1 << _SLOTS)[slot] >= least  # no pair is rarer than its slot says
    places, keys = places[may], keys[may]
    order = np.argsort(keys)
    places, keys = places[order], keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    count = np.diff(first, append=len(keys))
    often = np.flatnonzero(count >= least)
    often = often[np.argsort(-count[often], kind="stable")]
    rank = np.full(len(count), _NONE)
    rank[often] = np.arange(len(often), dtype=np.uint32)
    rank = np.repeat(rank, count)
    return keys[first[often]], places[rank != _NONE], rank[rank != _NONE]


def compress(ids: np.ndarray, terminals: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, their expansion lengths, symbols). Symbols from `terminals` on are rules. It ends when no
    pair stands at `least` places that do not overlap: by default, when no rule would pay for itself,
    since a rule takes the bytes of two or three symbols and each use saves one."""
    seq, lengths = ids.astype(np.uint32), np.ones(terminals, dtype=np.uint32)
    rules = [np.empty((0, 2), dtype=np.uint32)]
    active = np.ones(max(0, len(seq) - 1), dtype=bool)
    while True:
        runs, taking = _in_runs(seq), active.copy()
        taking[runs] = False
        places = np.flatnonzero(taking)
        pairs, places, ranks = _frequent(places, seq[places].astype(np.uint64) << np.uint64(32) | seq[places + 1], least)
        if not len(pairs):
            return np.concatenate(rules), lengths[terminals:], seq
        rank = np.full(len(seq) + 1, _NONE)  # of the places from -1 to the end
        rank[places + 1] = ranks
        here = rank[1:-1]
        found = np.flatnonzero((here != _NONE) & (here <= rank[:-2]) & (here <= rank[2:]))
        which = here[found]
        worth = np.bincount(which, minlength=len(pairs)) >= least  # the most frequent pair always is
        found, which = found[worth[which]], which[worth[which]]
        new = np.stack([pairs[worth] >> np.uint64(32), pairs[worth] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        live = here != _NONE
        live[runs] = live[found] = live[found[found > 0] - 1] = True
        seq[found] = (len(lengths) + np.cumsum(worth) - 1)[which].astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[found + 1] = False
        seq = seq[keep]
        active = np.append(live, True)[keep][: len(seq) - 1]
        lengths = np.concatenate([lengths, lengths[new].sum(axis=1, dtype=np.uint32)])
        rules.append(new)


def to_bytes(rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray, terminals: int) -> bytes:
    kind = np.dtype("<u2" if terminals + len(rules) <= 0x10000 else "<u4")
    size = np.min_scalar_type(int(lengths.max(initial=0))).newbyteorder("<")
    head = MAGIC + struct.pack(HEADER, terminals, len(rules), len(seq), kind.itemsize, size.itemsize)
    return head + rules.astype(kind).tobytes() + lengths.astype(size).tobytes() + seq.astype(kind).tobytes()


class Shard:
    """A shard for random access: any range of its ids, by the lengths that it stores."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.terminals, n_rules, n, width, size = struct.unpack_from(HEADER, payload, 4)
        kind, at = np.dtype(f"<u{width}"), 4 + struct.calcsize(HEADER)
        self.rules = np.frombuffer(payload, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.uint32)
        lengths = np.frombuffer(payload, f"<u{size}", n_rules, at + 2 * n_rules * width).astype(np.int64)
        self.seq = np.frombuffer(payload, kind, n, at + n_rules * (2 * width + size)).astype(np.uint32)
        self.lengths = np.concatenate([np.ones(self.terminals, dtype=np.int64), lengths])
        self.ends = np.cumsum(self.lengths[self.seq])
        # What each rule stands for, one after another; only rules of a lesser number stand in a rule.
        self.at = np.cumsum(lengths) - lengths
        self.flat = self._flat(int(lengths.sum()))

    def _flat(self, n: int) -> np.ndarray:
        flat = np.empty(n, dtype=np.uint32)
        place, symbol = np.repeat(self.at, 2), self.rules.reshape(-1)
        place[1::2] += self.lengths[self.rules[:, 0]]
        while len(symbol):
            rule = symbol >= self.terminals
            flat[place[~rule]] = symbol[~rule]
            place, inner = place[rule], self.rules[symbol[rule] - self.terminals]
            place = np.stack([place, place + self.lengths[inner[:, 0]]], axis=1).reshape(-1)
            symbol = inner.reshape(-1)
        return flat

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start+n; only the symbols that cover them are expanded."""
        first, last = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, start + n, side="left")
        seq = self.seq[first : last + 1]
        if not len(seq) or not n:
            return np.empty(0, dtype=np.uint32)
        size = self.lengths[seq]
        ends = np.cumsum(size)
        before = int(self.ends[first] - size[0])
        rule = seq >= self.terminals
        out = np.repeat(seq, size)
        if rule.any():
            inside = np.repeat(rule, size)
            from_rule = np.repeat(np.where(rule, self.at[np.where(rule, seq - np.uint32(self.terminals), 0)] - (ends - size), 0), size)
            out[inside] = self.flat[(from_rule + np.arange(len(out)))[inside]]
        return out[start - before : start - before + n]


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    terminals: int = 49_408,
    shard_tokens: int = 1 << 18,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Writes SHARD_SCHEMA as Parquet: every whole text's ids and the end id, in ascending order of
    id over parts and shards. A null or empty text is the end id alone; a null id comes first; rows
    of one id stand in the order of their texts; other columns are not read. An empty table gives
    no shard. A shard ends with the document that fills it.
    """
    spark = docs.sparkSession
    workspace.ship(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = workspace.partitions(spark)
    dealt = rows.repartitionById(n, ordered.bucket(F.col("id"), ordered.bounds(rows, "id", n)))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode_all, TaskContext.get().partitionId()
        ids: list = []
        texts: list[bytes] = []
        first = shard = held = 0

        def close() -> pa.RecordBatch:
            nonlocal first, shard, held, ids, texts
            lengths = [len(t) // 4 for t in texts]
            rules, sizes, seq = compress(np.frombuffer(b"".join(texts), "<u4"), terminals)
            row = {"part": part, "shard": shard, "first_token": first, "n_tokens": held, "doc_ids": ids, "doc_tokens": lengths, "payload": to_bytes(rules, sizes, seq, terminals)}
            first, shard, held, ids, texts = first + held, shard + 1, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            for doc, found in zip(b.column(0).to_pylist(), encode(t.as_py() for t in b.column(1)), strict=True):
                texts.append(found + end)
                ids.append(doc)
                held += len(texts[-1]) // 4
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))
    dealt.sortWithinPartitions(*order).mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def _crcs(shard: Shard, starts: np.ndarray, lengths: np.ndarray) -> Iterator[int]:
    """The crc32 of each document's ids; documents that begin within the same RUN ids are one access."""
    edges = np.append(np.flatnonzero(np.diff(starts // RUN, prepend=-1)), len(starts)).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        data = memoryview(shard.ids(int(starts[a]), int(lengths[a:b].sum())).astype("<u4").tobytes())
        at = (4 * (starts[a:b] - starts[a])).tolist()
        for k, n in zip(at, (4 * lengths[a:b]).tolist(), strict=True):
            yield zlib.crc32(data[k : k + n])


def read_documents(shards: DataFrame) -> DataFrame:
    """DOC_SCHEMA from shards: each document's place in the whole sequence, its number of ids and
    their unsigned crc32, read by random access, neighbouring documents of about RUN ids at a time. The driver gathers one total for each part, no more than there were
    tasks."""
    workspace.ship(shards.sparkSession)
    before, total = {}, 0
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_tokens")).collect())):
        before[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["payload"])
                starts = np.cumsum(row["doc_tokens"]) - row["doc_tokens"]
                crc = list(_crcs(shard, starts, np.array(row["doc_tokens"], dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + (before[row["part"]] + row["first_token"])), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, DOC_SCHEMA)
