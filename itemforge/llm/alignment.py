"""How the tokens of two tokenizers of one text lie against each other, and how often each pair meets.

A text is cut where both tokenizers must begin anew; a unit's tokens and links are found once and kept
in a bounded memo. A pair of linked ids is one 64-bit key. Each partition counts the documents of its
keys by np.unique, a range-partitioned sort brings equal keys together, their runs are summed, and the
sorted files of counts are searched by the tasks that read the documents' keys again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import sorted_shards, workspace

#: Before a space or a line end between two characters that are no white space both tokenizers begin
#: anew: the first's pattern starts a word there, the second has no piece with either inside.
_CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Longer units are not kept.
LONGEST = 64
#: Before a unit that is not named by its word: one with white space at an end, or this character at its start.
_RAW = "\0"


def _name(unit: str) -> str:
    """The memo's name of a unit: its word for a space and a word, itself for a line end and a word, else
    the whole unit after a mark."""
    word = unit[1:]
    plain = word and unit[0] in " \n" and not word[0].isspace() and not word[-1].isspace() and word[0] != _RAW
    return _RAW + unit if not plain else word if unit[0] == " " else unit


def _unit(name: str) -> str | None:
    """The unit of a name; None for a piece of text that is no unit's name, since it has white space at an
    end."""
    if name[:1] == _RAW:
        return name[1:]
    unit = name if name[:1] == "\n" else f" {name}"
    return unit if _name(unit) == name else None
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """The two tokenizers: a byte-level one of the `tokenizers` library, whose texts get a space before
    them, and a SentencePiece model that puts one there itself."""

    def __init__(self, path_a: str, path_b: str, limit: int = 300_000):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        of = {c: k for k, c in enumerate(self._byte_chars())}
        assert set(of) == set(pre_tokenizers.ByteLevel.alphabet())
        self.a_bytes = {k: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, k in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece reaches across words")
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, "<i8")
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], "<i8")
        # Each id in words: inside and at the end of its part of a group, for A and then for B.
        self.words = [f"{k}{end}" for n, ends in ((len(self.a_sizes), ",|"), (len(self.b_sizes), ",;")) for end in ends for k in range(n)]
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.limit = limit

    @staticmethod
    def _byte_chars() -> list[str]:
        """The character of each byte in a byte-level vocabulary: itself if it prints, else the next one
        from 256 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(256, 512))
        return [chr(k) if k in own else chr(next(rest)) for k in range(256)]

    def _ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of units, or of whole texts, with their first space or line end."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # The model's own space stands before a line end by itself, and is taken off again.
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return a, [x if u[0] == " " else x[1:] for u, x in zip(units, b, strict=True)]

    def _learn(self, units: set[str]) -> dict[str, tuple]:
        """What is new of a text's units, by their names, in one call of each library: (tokens of A, of B,
        groups, the groups in words, keys of the links). () for a name of none, or of a unit that the
        tokens do not spell."""
        new = {u: full for u in units if u not in self.old and (full := _unit(u)) is not None}
        got = dict.fromkeys(units, ())
        if new:
            full = [f.encode() for f in new.values()]
            a, b = self._ids(list(new.values()))
            if self._spelt(full, a, b):
                got |= zip(new, self._aligned(full, a, b), strict=True)
            else:
                for u, *one in zip(new, full, a, b, strict=True):
                    one = [[x] for x in one]
                    if self._spelt(*one):
                        got[u] = self._aligned(*one)[0]
        got |= {u: self.old[u] for u in units if u in self.old}
        for u, v in got.items():
            if len(u) <= LONGEST:
                if len(self.memo) >= self.limit:
                    self.old, self.memo = self.memo, {}
                self.memo[u] = v
        return got

    def _spelt(self, full: list[bytes], a: list[list[int]], b: list[list[int]]) -> bool:
        """Whether the tokens' bytes are those of each unit."""
        for f, x, y in zip(full, a, b, strict=True):
            if not b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == f:
                return False
        return True

    def _aligned(self, full: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[tuple]:
        """What _learn() says of each unit, by one pass over the bytes of all."""
        a, b = (np.fromiter(chain.from_iterable(ids), "<i8") for ids in (a_ids, b_ids))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Between two ends of tokens lies one token of each; no two tokens share two such stretches.
        ends = np.sort(np.concatenate([ends_a, ends_b]))
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
        i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        both = (ends_a[i] == ends) & (ends_b[j] == ends)
        keys = (a[i] << 32 | b[j]).tobytes()
        words = self._groups(a, b, i[both], j[both])
        unit_ends = np.cumsum([len(f) for f in full])
        links, groups = np.searchsorted(ends, unit_ends, "right").tolist(), np.searchsorted(ends[both], unit_ends, "right").tolist()
        out, link, group, word = [], 0, 0, 0
        for x, y, next_link, next_group in zip(a_ids, b_ids, links, groups, strict=True):
            next_word = word + len(x) + len(y)
            out.append((len(x), len(y), next_group - group, "".join(words[word:next_word])[:-1], keys[8 * link : 8 * next_link]))
            link, group, word = next_link, next_group, next_word
        return out

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The groups in words, token by token: the ids of A, a bar, the ids of B, and a semicolon. last_a and
        last_b are the places of each group's last tokens."""
        n_a, n_b = len(self.a_sizes), len(self.b_sizes)
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        a, b = a.copy(), b + 2 * n_a
        a[last_a] += n_a
        b[last_b] += n_b
        out = np.empty(len(a) + len(b), "<i8")
        out[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = b
        return list(map(self.words.__getitem__, out.tolist()))

    def _parts(self, names: list[str]) -> list[tuple]:
        parts = list(map(self.memo.get, names))
        if None in parts:
            got = self._learn({u for u, p in zip(names, parts, strict=True) if p is None})
            parts = [got[u] if p is None else p for u, p in zip(names, parts, strict=True)]
        return parts

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """(tokens of A, of B, groups, the groups' digest, keys of all links) of a text; all zero and
        empty for a null or empty one, and where the tokens' bytes are not the text's."""
        nothing = 0, 0, 0, "", np.empty(0, "<i8")
        if not text:
            return nothing
        # Most texts have no white space but single spaces and line ends, and are cut there.
        parts = self._parts(text.replace("\n", " \n").split(" "))
        if not all(parts):
            parts = self._parts(list(map(_name, _CUTS.split(f" {text}"))))
        if not all(parts):
            return nothing
        a, b, n, words, keys = zip(*parts, strict=True)
        return sum(a), sum(b), sum(n), sha256(";".join(words).encode()).hexdigest(), np.frombuffer(b"".join(keys), "<i8")


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One for each worker process, so that its memo outlives a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Pair(path_a, path_b)


def links(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's numbers of tokens, groups and links, the digest of its groups, and its distinct
    keys with how often each stands. The rows are written to the shared folder."""
    workspace.ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = pair(path_a, path_b).align
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, b, n, digest, keys = align(text.as_py())
                keys, times = np.unique(keys, return_counts=True)
                rows.append((doc, a, b, n, int(times.sum()), digest, keys, times.astype("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    path = workspace.folder(docs.sparkSession, "alignment")
    slim.mapInArrow(run, _ROWS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_ROWS).parquet(path)


def partial_counts(rows: DataFrame, held: int = 1 << 22) -> DataFrame:
    """(key, n): the number of rows whose array `pairs` has a key, for each partition, or for each
    `held` keys of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, "<i8")], [np.empty(0, "<i8")]

        def merge() -> None:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            keys[:], counts[:] = [k], [np.bincount(inverse, np.concatenate(counts), len(k)).astype("<i8")]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["key", "n"])

        for b in batches:
            k, n = np.unique(b.column(0).flatten().to_numpy(), return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) >= held:
                merge()
                if len(keys[0]) >= held // 2:
                    yield out()
                    keys[:], counts[:] = [np.empty(0, "<i8")], [np.empty(0, "<i8")]
        merge()
        yield out()

    return rows.select("pairs").mapInArrow(run, "key long, n long")


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """RESULT for every document, from its whole text.

    Tokens cover the bytes of a space and the text. Byte offsets where tokens of both end cut them into
    groups, and every two tokens whose bytes overlap are a link. A pair's count is how many documents
    have it linked; n_best counts a document's links whose pair no other pair of the same id of A
    exceeds, count_sum adds the counts of all its links. Null and empty texts, and texts that the tokens
    do not spell, have no tokens. Rows that repeat count each for itself, a null id is an id, other
    columns are not read, an empty table gives no rows.

    The counts of keys are no more than the product of the vocabularies, the best counts, which each
    task gets whole, no more than A has ids.
    """
    rows = links(docs, path_a, path_b, id_column, text_column)
    spark = docs.sparkSession
    counted = partial_counts(rows)
    files = sorted_shards.write(counted, "key", "n")
    if not files:
        return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    best = _best(spark, files)
    sent = spark.sparkContext.broadcast(best)
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in (f.split()[0] for f in RESULT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, most = sorted_shards.Lookup(files, "key"), sent.value
        for b in batches:
            pairs = b.column(6)
            keys, times = pairs.flatten().to_numpy(), b.column(7).flatten().to_numpy().astype("<i8")
            n = np.zeros(len(keys), "<i8")
            for which, at, table in lookup.find(keys):
                n[which] = table["n"].chunk(0).to_numpy()[at]
            edges = np.r_[0, np.cumsum(pairs.value_lengths().to_numpy())]
            along = lambda x, e=edges: np.diff(np.r_[0, np.cumsum(x)][e])  # noqa: E731 - sums of each document
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(along(times * (n == most[keys >> 32]))), pa.array(along(times * n)), b.column(5)], schema=schema)

    return rows.mapInArrow(run, RESULT)


def _best(spark, files: list[tuple[str, int]]) -> np.ndarray:
    """The highest count of each id of A: a maximum inside each file, then over the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                table = sorted_shards.Lookup([(path, first)], "key")._table(0)
                a, n = table["key"].chunk(0).to_numpy() >> 32, table["n"].chunk(0).to_numpy()
                starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(np.maximum.reduceat(n, starts))], names=["a", "n"])

    listed = spark.createDataFrame(files, "path string, first long").repartition(min(len(files), workspace.partitions(spark)))
    rows = listed.mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(1 + max(rows["a"].to_pylist()), "<i8")
    out[rows["a"].to_numpy()] = rows["n"].to_numpy()
    return out
