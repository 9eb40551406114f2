"""License notices by diagonal voting.

All rolling word k-gram hashes of a text meet the templates' in a Spark join. A hit at word p of the
text and word t of a template votes for the diagonal p - t, if the words themselves are the template's.
Neighbouring diagonals, which a word more or less leaves behind, are merged, and a span counts once
the template words it covers are enough.

A gram's hash is a polynomial over the bytes of its words, with one space between two, taken from sums
over the whole text as the window rolls, and mixed to 64 bits. Where it is one of the templates' hundred
or so, the gram's words go along, and a hit counts only if they are those of the template, so hashes
that collide, by chance or by design, make no span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import workspace

#: Phrases that count only whole, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of which a part may be missing or changed, and their labels.
NOTICES = {
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
}
#: Everything that ends a word becomes a space; what is left are a-z, 0-9 and bytes outside ASCII.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPANS = "array<struct<label:string,base:boolean,start:long,end:long,coverage:double>>"


def words(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


#: The odd base of the polynomial, its inverse modulo 2 to the 64th, and a multiplier.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Grams in one row of those sent, which bounds what a row of a very long text holds.
CHUNK = 1 << 16
#: What every document sends once, so that it comes through the join also without a hit.
_HERE = -1


@lru_cache(maxsize=32)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, at least n of each."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, dtype=np.uint64)))) for b in (_BASE, _BACK))


def gram_hashes(found: list[bytes], k: int) -> np.ndarray:
    """The hash of every k words in a row, as signed 64-bit numbers."""
    if len(found) < k:
        return np.empty(0, np.int64)
    line = np.frombuffer(b" ".join(found), np.uint8)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[: len(found) - k + 1], ends[k - 1 :] - 1
    power, back = _powers(1 << max(12, (len(line) + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum((line.astype(np.uint64) + np.uint64(1)) * power[: len(line)])))
        h = (sums[ends] - sums[starts]) * back[starts] + np.uint64(k)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return (h ^ (h >> np.uint64(32))).view(np.int64)


class Templates:
    """Templates as word lists, and the hashes of their grams."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], long_gram: int = 4, hashes: Callable[[list[bytes], int], np.ndarray] = gram_hashes):
        self.hashes = hashes
        self.items = [(p.encode().split(), label, True) for p, label in base.items()] + [(p.encode().split(), label, False) for p, label in notices.items()]
        self.by_template = [min(len(t), 2 if b else long_gram) for t, _, b in self.items]
        self.sizes = sorted(set(self.by_template))
        #: hash, template, position, words
        self.rows = [(h, number, at, b" ".join(t[at : at + k]).decode()) for number, ((t, _, _), k) in enumerate(zip(self.items, self.by_template, strict=True)) for at, h in enumerate(hashes(t, k).tolist())]

    def spans(self, votes: list[tuple[int, int, list[int]]], slack: int, least: float) -> list[dict]:
        """Verified spans from (template, diagonal, template positions of its grams)."""
        out, by = [], {}
        for number, diagonal, places in votes:
            by.setdefault(number, []).append((diagonal, places))
        for number, diagonals in sorted(by.items()):
            t, label, base = self.items[number]
            k, groups = self.by_template[number], []
            for diagonal, places in sorted(diagonals):
                if groups and not base and diagonal - groups[-1][-1][0] <= slack:
                    groups[-1].append((diagonal, places))
                else:
                    groups.append([(diagonal, places)])
            for group in groups:
                covered = {p + j for _, places in group for p in places for j in range(k)}
                coverage = len(covered) / len(t)
                if coverage >= (1.0 if base else least):
                    start = min(d + min(p) for d, p in group)
                    end = max(d + max(p) + k for d, p in group)
                    out.append({"label": label, "base": base, "start": start, "end": end, "coverage": coverage})
        return sorted(out, key=lambda s: (s["start"], s["end"], s["label"], s["base"]))


def scan(docs: DataFrame, templates: Templates | None = None, slack: int = 2, least: float = 0.75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) for every document; spans are in order of their first word, from 0,
    and end before `end`.

    A base phrase counts at each place where all its words stand; another notice where its words are
    covered to at least `least`, with at most `slack` words more or less between parts. Null and
    empty texts have no words. Repeated rows are scanned each for itself, a null id stays null, other
    columns are not read, and an empty table gives no rows. The templates are broadcast: they are a
    parameter and hold a row for each of their words at most.
    """
    spark = docs.sparkSession
    workspace.ship(spark)
    templates = templates or Templates(BASE, NOTICES)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("first", pa.int64()), ("hashes", pa.list_(pa.int64())), ("shown", pa.map_(pa.int32(), pa.string()))])
    known = np.unique(np.array([h for h, *_ in templates.rows], dtype=np.int64))

    def shown(found: list[bytes], first: int, k: int, h: np.ndarray) -> list[tuple[int, str]]:
        """The words of the grams whose hashes are among the templates'."""
        if not len(known):
            return []
        hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        return [(i, b" ".join(found[first + i : first + i + k]).decode()) for i in hit.tolist()]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = words(text.as_py())
                out.append((number, doc, len(found), 0, np.array([_HERE]), []))
                for k in templates.sizes:
                    for at in range(0, len(found) - k + 1, CHUNK):
                        h = templates.hashes(found[at : at + CHUNK + k - 1], k)
                        out.append((number, doc, len(found), at, h, shown(found, at, k, h)))
                        held += len(out[-1][4])
                        if held > 16 * CHUNK:
                            yield batch(out)
                            out, held = [], 0
                number += 1
            if out:
                yield batch(out)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
        for b in batches:
            votes = [[(v["template"], v["diagonal"], v["places"]) for v in row if v["template"] != _HERE] for row in b.column(2).to_pylist()]
            spans = pa.array([templates.spans(v, slack, least) for v in votes], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans], names=["doc_id", "n_words", "spans"])

    sent = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    sent = sent.mapInArrow(grams, "row long, doc_id long, n_words long, first long, hashes array<long>, shown map<int,string>")
    hits = sent.select("row", "doc_id", "n_words", "first", "shown", F.posexplode("hashes").alias("at", "hash"))
    places = spark.createDataFrame([*templates.rows, (_HERE, _HERE, 0, None)], "hash long, template int, place int, words string")
    same = (F.col("template") == _HERE) | (F.try_element_at("shown", F.col("at")) == F.col("words"))
    met = hits.join(F.broadcast(places), "hash").where(same).withColumn("diagonal", F.col("first") + F.col("at") - F.col("place"))
    keys = ["row", "doc_id", "n_words"]
    by_diagonal = met.repartition(F.col("row")).groupBy(*keys, "template", "diagonal").agg(F.array_sort(F.collect_set("place")).alias("places"))
    by_row = by_diagonal.groupBy(*keys).agg(F.collect_list(F.struct("template", "diagonal", "places")).alias("votes"))
    return by_row.select("doc_id", "n_words", "votes").mapInArrow(verify, f"doc_id long, n_words long, spans {SPANS}")
