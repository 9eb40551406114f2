"""SentencePiece encoding and decoding over a trie of distinct words.

A text with its marks is cut where no piece can reach across. The distinct words of a batch are
sorted, which is a depth-first walk of their trie, and a forward pass over prefixes fills one state
for each node: a word starts with the states of the prefix that it shares with the word before.

For a unigram model the state is the best score of a prefix (Viterbi). For a BPE model it is the one
last piece that the model's merges leave of a prefix: a piece may follow another if merging the two
together gives just these two, so no later merge can reach across, and exactly one piece can end a
prefix in this way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import workspace

MARK = "▁"
_UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
UNIGRAM, BPE = 1, 2
_NORMAL, _USER, _BYTE, _UNUSED = 1, 4, 6, 5


class Model:
    """Pieces of a model file whose normalisation is the identity."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation are read")
        self.setup([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, spec.add_dummy_prefix)

    def setup(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True) -> None:
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.pieces, self.scores = [p for p, _, _ in pieces], [s for _, s, _ in pieces]
        self.ids = {p: k for k, (p, _, t) in enumerate(pieces) if t in (_NORMAL, _USER)}
        self.unknown = next((k for k, (_, _, t) in enumerate(pieces) if t == 2), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.of_byte = {k: b for b, k in self.bytes.items()}
        if any(t in (_USER, _UNUSED) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not read")
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.longest = max(map(len, self.ids), default=1)
        self.run = max((len(p) for p in self.ids if not p.strip(MARK)), default=1)
        self.penalty = min((self.scores[k] for k in self.ids.values()), default=0.0) - 10.0
        self.follows: dict[int, bool] = {}
        # Pieces from their last character backwards; under the empty key a node has its piece's id.
        self.backwards: dict = {}
        for piece, k in self.ids.items() if kind == BPE else ():
            if self.merged(piece) == [piece]:
                node = self.backwards
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = k

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int) -> Model:
        out = cls.__new__(cls)
        out.setup(pieces, kind)
        return out

    def merged(self, text: str) -> list[str]:
        """A short text's symbols after merging: the best-scored neighbours first, the left ones of
        equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, key: int) -> bool:
        """Whether of two pieces, a << 32 | b, the second may follow the first."""
        if len(self.follows) > 500_000:
            self.follows.clear()
        a, b = self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF]
        known = self.follows[key] = self.merged(a + b) == [a, b]
        return known

    def fallback(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]


class _Walk:
    """States of the prefixes of the word at hand: where the last piece starts, and its id, or -1 for
    a character that is no piece; for a unigram model the best score too."""

    def __init__(self, model: Model):
        self.model, self.word = model, ""
        self.start, self.piece, self.score = [0], [-1], [0.0]

    def go(self, word: str) -> list[int]:
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del self.start[shared + 1 :], self.piece[shared + 1 :], self.score[shared + 1 :]
        self.word = word
        if self.model.kind == BPE:
            self._merge_steps(word, shared)
        else:
            for i in range(shared + 1, len(word) + 1):
                self._best_step(word, i)
        out, i = [], len(word)
        while i:
            piece, j = self.piece[i], self.start[i]
            if piece >= 0:
                out.append(piece)
            else:
                out += reversed(self.model.fallback(word[j:i]))
            i = j
        out.reverse()
        return out

    def _merge_steps(self, word: str, shared: int) -> None:
        model, pieces, start = self.model, self.piece, self.start
        known, backwards, may_follow = model.follows.get, model.backwards, model.may_follow
        for i in range(shared + 1, len(word) + 1):
            node, j, found = backwards, i, -1
            while j:
                j -= 1
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get("")
                if t is None:
                    continue
                a = pieces[j]
                if j and a >= 0:
                    key = a << 32 | t
                    good = known(key)
                    if not (may_follow(key) if good is None else good):
                        continue
                found = t
                break
            start.append(j if found >= 0 else i - 1)
            pieces.append(found)

    def _best_step(self, word: str, i: int) -> None:
        model, best = self.model, None
        for j in range(max(0, i - model.longest), i):
            t = model.ids.get(word[j:i])
            if t is not None and (best is None or self.score[j] + model.scores[t] > best[0]):
                best = (self.score[j] + model.scores[t], j, t)
        if model.ids.get(word[i - 1 : i]) is None:
            value = self.score[i - 1] + model.penalty
            if best is None or value > best[0]:
                best = (value, i - 1, -1)
        self.score.append(best[0])
        self.start.append(best[1])
        self.piece.append(best[2])


#: Longer words leave the memo after their batch, which bounds its bytes.
LONGEST = 64


class Encoder:
    """Encodes and decodes texts; the ids of words stay in a bounded memo."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model, self.limit = model, limit
        self.memo: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The marked text cut into words; nothing for an empty text."""
        if not text:
            return []
        return _UNITS.findall((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK))

    def _runs(self, n: int) -> list[int]:
        """A run of n marks: the longest run pieces from the left."""
        size = self.model.run
        return [self.model.ids[MARK * size]] * (n // size) + ([self.model.ids[MARK * (n % size)]] if n % size else [])

    def learn(self, words: set[str]) -> None:
        """Ids of words that the memo lacks, in the order of their trie."""
        if len(self.memo) + len(words) > self.limit:
            self.memo = {}
        walk, ids = _Walk(self.model), self.model.ids
        runs = self.model.kind == BPE and all(MARK * k in ids for k in range(1, self.model.run + 1))
        for word in sorted(words - self.memo.keys()):
            bare = word.lstrip(MARK)
            marks = len(word) - len(bare)
            if runs and marks > 1:
                # Marks merge among themselves after all else; the last may go to the word.
                tail = walk.go(MARK + bare) if bare else []
                if tail and tail[0] != ids[MARK]:
                    found = self._runs(marks - 1) + tail
                else:
                    found = self._runs(marks) + tail[1:]
            else:
                found = walk.go(word)
            self.memo[word] = pack(f"<{len(found)}I", *found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self.units(t or "") for t in texts]
        words = set().union(*split) if split else set()
        self.learn(words)
        if not words <= self.memo.keys():  # the memo was begun anew
            self.learn(words)
        out = [b"".join(map(self.memo.__getitem__, s)) for s in split]
        for word in words:
            if len(word) > LONGEST:
                del self.memo[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks become spaces, the first of them goes, bytes come together."""
        pieces, of_byte, out = self.model.pieces, self.model.of_byte, bytearray()
        for k in np.frombuffer(ids, dtype="<u4").tolist():
            b = of_byte.get(k)
            if b is None:
                out += pieces[k].encode()
            else:
                out.append(b)
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Model(path))


SCHEMA = "doc_id long, ids binary, n_tokens long, ids_crc32 long, decoded string"


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = True) -> DataFrame:
    """SCHEMA for every document: the ids of its whole text, their number and unsigned crc32, and the
    text that they decode to. The best-scored segmentation (Viterbi) is what a unigram model asks for;
    under a BPE model it is not what the merges give, so there the same walk over the trie keeps for
    each prefix the one last piece that merging leaves, without scores. A text is given back whole unless it holds the mark itself, which
    decodes to a space. Null and empty texts have no ids; null ids stay null; repeated rows come out
    as often; other columns are not read; an empty table gives no rows."""
    workspace.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                ids = coder.encode(part.column(1).to_pylist())
                crc = pa.array([zlib.crc32(i) for i in ids], pa.int64())
                text = pa.array([coder.decode(i) for i in ids] if decode else [None] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), crc, text], names=["doc_id", "ids", "n_tokens", "ids_crc32", "decoded"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA)
