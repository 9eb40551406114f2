"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is a set of digests, one for each paragraph piece. A sketch adds each digest to three cells:
a count, the exclusive or of the digests and that of their check sums. Subtracting one sketch from
another leaves the digests in which the texts differ; peeling takes them out of cells that hold just
one. When cells stay, both sketches are built again with twice the cells.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import ordered, workspace

#: Cells of the fingerprint that is given out, and words of a paragraph piece at most.
CELLS, PIECE = 24, 16
_MASK = (1 << 64) - 1


def digests(text: str) -> list[int]:
    """The distinct digests of a text: one for each line's pieces of at most PIECE words, white space
    aside. A piece that comes again counts with its number, so that a set holds repeats. Of two pieces
    with one digest, which chance allows, the second is left out."""
    seen: dict[str, int] = {}
    out: dict[int, None] = {}
    for line in text.split("\n"):
        words = line.split()
        for k in range(0, len(words), PIECE):
            piece = " ".join(words[k : k + PIECE])
            n = seen.get(piece, 0)
            seen[piece] = n + 1
            out[xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"), n)] = None
    return list(out)


def _check(digest: int) -> int:
    """A check sum of a digest that tells it from an exclusive or of several."""
    x = (digest ^ digest >> 31) * 0x9FB21C651E98DF25 & _MASK
    return (x ^ x >> 29) >> 32


def _cells(digest: int, third: int) -> tuple[int, int, int]:
    """A digest's cells, one in each third of a sketch."""
    return digest % third, third + (digest >> 21) % third, 2 * third + (digest * 0xD6E8FEB86659FD93 & _MASK) // (1 << 32) % third


class Sketch:
    """Cells of counts, exclusive ors of digests, and exclusive ors of check sums."""

    def __init__(self, cells: int = CELLS):
        self.third = cells // 3
        self.count, self.sum, self.check = [0] * cells, [0] * cells, [0] * cells

    def add(self, found: list[int], sign: int = 1) -> Sketch:
        count, total, check, third = self.count, self.sum, self.check, self.third
        for d in found:
            c = _check(d)
            for k in _cells(d, third):
                count[k] += sign
                total[k] ^= d
                check[k] ^= c
        return self

    def subtract(self, other: Sketch) -> Sketch:
        out = Sketch(3 * self.third)
        out.count = [a - b for a, b in zip(self.count, other.count, strict=True)]
        out.sum = [a ^ b for a, b in zip(self.sum, other.sum, strict=True)]
        out.check = [a ^ b for a, b in zip(self.check, other.check, strict=True)]
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """The digests that only the first and only the second text had; nothing if cells stay.
        Empties the sketch as far as it comes."""
        count, total, check, third = self.count, self.sum, self.check, self.third
        mine: list[int] = []
        theirs: list[int] = []
        ready = [k for k, n in enumerate(count) if n in (1, -1)]
        while ready:
            k = ready.pop()
            n, d = count[k], total[k]
            if n not in (1, -1) or check[k] != _check(d) or k not in _cells(d, third):
                continue
            (mine if n == 1 else theirs).append(d)
            c = check[k]
            for j in _cells(d, third):
                count[j] -= n
                total[j] ^= d
                check[j] ^= c
                if count[j] in (1, -1):
                    ready.append(j)
        if any(count) or any(total) or any(check):
            return None
        return mine, theirs

    def text(self) -> str:
        """The sketch as a string of fixed length for its number of cells."""
        cells = zip(self.count, self.sum, self.check, strict=True)
        return base64.b64encode(b"".join(struct.pack("<iQI", n, s, c) for n, s, c in cells)).decode()


def difference(a: list[int], b: list[int], cells: int = CELLS) -> tuple[list[int], list[int]]:
    """The digests that only a and only b hold, by sketches, larger ones after each failure. No
    fewer cells are tried than the sizes alone ask for. Sketches of many times as many cells as there
    are digests fail only if digests share all their cells, at any size; then the sets themselves are
    subtracted."""
    while cells < abs(len(a) - len(b)):
        cells *= 2
    while cells <= 64 * (len(a) + len(b) + CELLS):
        if found := Sketch(cells).add(a).subtract(Sketch(cells).add(b)).peel():
            return found
        cells *= 2
    return list(set(a).difference(b)), list(set(b).difference(a))


def likeness(a: list[int], b: list[int]) -> float:
    """Twice the shared digests over all digests; 1 for two texts without any."""
    if not a and not b:
        return 1.0
    mine, theirs = difference(a, b)
    return 1.0 - (len(mine) + len(theirs)) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The text, its last half (rounded down) replaced by as many first code points of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """SCHEMA for every document: its sketch, that of its edited text, and its likeness to the edited
    text and to the next document in descending order of id, the first one's after the last.

    Null and empty texts are equal. Rows of one id stand in the order of their texts, null ids last.
    Other columns are not read, repeated rows come out as often, an empty table gives no rows; a
    single document is its own next.
    """
    spark = docs.sparkSession
    workspace.ship(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = workspace.partitions(spark)
    rows = rows.select("id", "text", ordered.bucket(F.col("id"), ordered.bounds(rows, "id", n)).alias("part"), F.xxhash64("text").alias("hash"))
    # Ranges of ids go down; the first document of a range is also what its upper neighbour looks
    # for after its own last one. The driver holds one id and one text hash for each range.
    key = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("i"), F.col("id").isNotNull().alias("k"), F.col("hash").alias("h"))
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.max(key).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    above = {p: order[(k - 1) % len(order)] for k, p in enumerate(order)}
    kind = "array<struct<part:int,top:struct<i:bigint,k:boolean,h:bigint>>>"
    known = [(above[p], tuple(tops[p])) if p in tops else None for p in range(n)]
    there = F.from_json(F.lit(json.dumps([k and {"part": k[0], "top": dict(zip("ikh", k[1], strict=True))} for k in known])), kind)[F.col("part")]
    own = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    ahead = F.when(there["top"] == key, F.struct(there["part"].alias("part"), F.lit(True).alias("ahead")))
    dealt = rows.select("id", "text", F.explode(F.filter(F.array(own, ahead), lambda x: x.isNotNull())).alias("to")).select("id", "text", "to.part", "to.ahead")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("ahead", F.col("id").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, done = None, [], False

        def row(now: tuple, following: tuple) -> dict:
            doc, text, mine = now
            changed = edited(text, following[1])
            theirs = digests(changed)
            return {
                "doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": Sketch().add(mine).text(), "edited_fingerprint": Sketch().add(theirs).text(),
                "near_edited": likeness(mine, theirs), "near_next": likeness(mine, following[2]),
            }

        for b in batches:
            for doc, text, ahead in zip(b.column(0).to_pylist(), b.column(1), b.column(3).to_pylist(), strict=True):
                if done:
                    continue  # the row after a range's last may be there more than once
                now = (doc, text.as_py(), digests(text.as_py()))
                if held is not None:
                    out.append(row(held, now))
                held, done = now, ahead
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out = []
        if held is not None and not done:
            raise RuntimeError(f"range {TaskContext.get().partitionId()} has no next document")

    return dealt.mapInArrow(run, SCHEMA)
