"""SimHash fingerprints of word shingles and the search for near ones by pigeonring filtering.

A code is cut into segments that stand in a ring. If two codes differ in at most `budget` bits, some
segment begins a chain whose running differences never pass its proportional share of the budget:
over l segments at most floor(l * budget / segments). Codes meet in a bucket when they agree in
enough segments for such a chain; in the bucket the chain is followed first, and only pairs that
keep within it go to the full Hamming check. A bucket puts out links that join what it has joined,
not its pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm import tokens, workspace
from itemforge.llm.components import components
from itemforge.operators import known_hashes

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
#: Buckets of more codes than this are split; the second figure is for wide codes.
FULL, WIDE_FULL = 4096, 1 << 17


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a text's words (A-Z lower-cased, cut at white space), repeats
    included; the whole sequence where it is shorter; none for no words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1]
    return np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if n < 200:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of each hash (the finaliser of SplitMix64)."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(n)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def map_texts(docs: DataFrame, keys: dict[str, Column], text: Column, make: Callable, kind: str) -> DataFrame:
    """The key columns and `code`, what `make` gives for each text."""
    workspace.ship(docs.sparkSession)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], text.cast("string").alias("text"))
    schema = ", ".join([*[f"{k} {t}" for k, t in rows.dtypes if k != "text"], f"code {kind}"])
    arrow = {"long": pa.int64(), "binary": pa.binary()}[kind]
    names = [*keys, "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            codes = pa.array([make(t.as_py()) for t in b.columns[-1]], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], codes], names=names)

    return rows.mapInArrow(run, schema)


def masks(bits: int, segments: int) -> list[int]:
    """Each segment's bits."""
    at = [round(k * bits / segments) for k in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(at, at[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(code: Column, bits: int, segments: int, budget: int, ring: Column) -> Column:
    """A key for each set of segments that must agree."""
    parts = masks(bits, segments)
    sets = [sum(c) for c in combinations(parts, segments - budget)]
    return F.array(*[F.xxhash64(ring, F.lit(k), code.bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(sets)])


def chained(x: np.ndarray, parts: list[np.uint64], budget: int) -> np.ndarray:
    """Whether the differences x may lie on a chain of up to three segments from some start."""
    m = len(parts)
    apart = [np.bitwise_count(x & p) for p in parts]
    found = np.zeros(len(x), dtype=bool)
    for i in range(m):
        total, good = 0, True
        for length in range(1, min(3, m) + 1):
            total = total + apart[(i + length - 1) % m].astype(np.int16)
            good = good & (total <= length * budget // m)
        found |= good
    return found


def _join(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the given ones, one for each node but the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        old, low = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (old == label).all():
            break
    tied = label != np.arange(len(nodes))
    return nodes[label[tied]], nodes[tied]


class _Found:
    """Pairs found so far, cut down when they grow many: by `_join` to links that join the same nodes,
    or, where pairs have a distance, to a forest of true pairs."""

    #: Pairs held at most before they are cut down, which takes some hundred bytes for each.
    MANY = 500_000

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def put(self, *pairs: np.ndarray) -> None:
        self.held.append(pairs)
        self.size += len(pairs[0])
        if self.size > self.MANY:
            self.held = [self.links()]
            self.size = len(self.held[0][0])

    def links(self) -> tuple[np.ndarray, ...]:
        if not self.size:
            return tuple(np.empty(0, np.int64) for _ in (self.held[0] if self.held else "ab"))
        found = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        if len(found) == 2:
            return _join(*found)
        keep = np.union1d(forest(*found), nearest(*found))
        return tuple(x[keep] for x in found)


def nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int = 4) -> np.ndarray:
    """Which pairs are among the n nearest of one of their ends: more than a forest needs, so that a
    pair that turns out to be no link seldom parts what others join."""
    ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, d[pair], ends))
    first = np.flatnonzero(np.diff(ends[order], prepend=ends[order[:1]] - 1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return np.unique(pair[order[place < n]])


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs at distances are the least ones that join what all of them join (Boruvka's rounds): if one
    of them turns out to be no link, any other pair that would join its two sides is as far or farther."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    rank = np.empty(len(a), dtype=np.int64)
    rank[np.argsort(d, kind="stable")] = np.arange(len(a))
    live, chosen, none = np.arange(len(a)), [np.empty(0, np.int64)], np.iinfo(np.int64).max
    while len(live := live[label[x[live]] != label[y[live]]]):
        best = np.full(len(nodes), none)
        np.minimum.at(best, label[x[live]], rank[live])
        np.minimum.at(best, label[y[live]], rank[live])
        edge = np.full(len(a), -1, dtype=np.int64)
        edge[rank[live]] = live
        tied = np.flatnonzero(best < none)
        take = edge[best[tied]]
        chosen.append(take)
        other = np.where(label[x[take]] == tied, label[y[take]], label[x[take]])
        up = np.arange(len(nodes))
        up[tied] = other
        twice = tied[(up[other] == tied) & (tied < other)]
        up[twice] = twice
        while (up != up[up]).any():
            up = up[up]
        label = up[label]
    return np.unique(np.concatenate(chosen))


def _pairs(table: pa.Table, parts: list[np.uint64], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, sorted by key."""
    key, node = table["key"].to_numpy(), table["node"].to_numpy()
    code = table["code"].to_numpy().view(np.uint64)
    found, step = _Found(), 1
    at = np.flatnonzero(key[1:] == key[:-1])
    while len(at):
        for part in np.array_split(at, len(at) // 500_000 + 1):
            x = code[part] ^ code[part + step]
            pick = part[chained(x, parts, budget)]
            x = code[pick] ^ code[pick + step]
            pick = pick[np.bitwise_count(x) <= budget]
            found.put(node[pick], node[pick + step])
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
    return found.links()


class _Bucket:
    """Codes of one bucket whose pairs within `near` bits are to be found, or pairs that join the same
    codes. `parts` are the ring's segments in the chain's order after the one that all codes share;
    the first l + 2 segments of a chain have l + 1 differences at most."""

    #: A dense group of more codes than this is joined through pivots.
    DENSE = 1500

    def __init__(self, words: list[np.ndarray], code: np.ndarray, parts: list[int], near: int, put: Callable) -> None:
        self.words, self.code, self.parts, self.near, self.put = words, code, parts, near, put

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in self.words)

    def all_pairs(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every pair of two lists, or of one with itself."""
        first, second = [w[b] for w in self.words[:1]], [w[b] for w in self.words[1:2]]
        step = max(1, 250_000 // len(b))
        for k in range(0, len(a), step):
            some = a[k : k + step]
            d = np.bitwise_count(self.words[0][some][:, None] ^ first[0])
            for w in second:
                d += np.bitwise_count(self.words[1][some][:, None] ^ w)
            x, y = np.divmod(np.flatnonzero(d <= self.near), len(b))
            x, y = some[x], b[y]
            d = self.apart(x, y)
            pick = d <= self.near
            if same:
                pick &= x < y
            if pick.any():
                self.put(x[pick], y[pick], d[pick])

    def follow(self, a: np.ndarray, b: np.ndarray, same: bool, level: int = 0, used: int = 0) -> None:
        """Every pair whose chain keeps within its share, segment by segment while there are many."""
        if len(a) * len(b) <= 60_000 or level == len(self.parts):
            return self.all_pairs(a, b, same)
        mask = np.uint64(self.parts[level])
        sides = []
        for side in (a,) if same else (a, b):
            value = self.code[side] & mask
            order = np.argsort(value, kind="stable")
            values, starts = np.unique(value[order], return_index=True)
            sides.append((values, np.split(side[order], starts[1:])))
        (u, us), (v, vs) = sides[0], sides[-1]
        cost = used + np.bitwise_count(u[:, None] ^ v).astype(np.int64)
        for x, y in np.argwhere(cost <= level + 1).tolist():
            if not same or x <= y:
                self.follow(us[x], vs[y], same and x == y, level + 1, int(cost[x, y]))

    def gather(self, group: np.ndarray, pivot: int, rng: np.random.Generator) -> None:
        """Joins a dense group of codes within `near` of a pivot: all its pairs, or, if it is large,
        each code with the nearest of some further pivots that lies within `near`."""
        if len(group) <= self.DENSE:
            return self.all_pairs(group, group, True)
        pivots = np.unique(np.append(rng.choice(group, 64), pivot))
        far = np.stack([self.apart(group, np.full(len(group), p)) for p in pivots])
        far[group == pivots[:, None]] = 1 << 20  # a pivot's nearest is another one
        best = far.argmin(axis=0)
        d = far[best, np.arange(len(group))]
        good = d <= self.near
        self.put(pivots[best[good]], group[good], d[good])
        d = self.apart(group, np.full(len(group), pivot))
        other = group != pivot
        self.put(np.full(other.sum(), pivot), group[other], d[other])

    def join(self) -> None:
        """Dense groups first: those within `near` of a pivot are joined, only codes within twice `near`
        of it can have a pair among them, and then they are done with."""
        left, rng = np.arange(len(self.code)), np.random.default_rng(len(self.code))
        for pivot in rng.permutation(len(left))[:32].tolist() if len(left) > 500 else ():
            if left[min(np.searchsorted(left, pivot), len(left) - 1)] != pivot:
                continue
            d = self.apart(left, np.full(len(left), pivot))
            close = d <= self.near
            if close.sum() * 32 < len(left):
                continue
            group, rim = left[close], left[~close & (d <= 2 * self.near)]
            self.gather(group, pivot, rng)
            if len(rim):
                self.all_pairs(rim, group, False)
            left = left[~close]
            if not len(left):
                return
        self.follow(left, left, True)


def _budgets(rings: int, near: int) -> list[int]:
    """Bits for each ring; a pair beyond all of them differs in more than `near` bits."""
    return [(near + 1) // rings - 1 + (k < (near + 1) % rings) for k in range(rings)]


def _wide_pairs(table: pa.Table, rings: int, near: int) -> tuple[np.ndarray, ...]:
    """A forest of the pairs of whole buckets of wide codes, sorted by key."""
    key, node = table["key"].to_numpy(), table["node"].to_numpy()
    flat = b"".join(table["wide"].to_pylist())
    words = np.ascontiguousarray(np.frombuffer(flat, "<u8").reshape(len(node), -1).T)
    codes = np.frombuffer(flat, ">u4").reshape(len(node), -1).T
    found, budgets = _Found(), _budgets(rings, near)
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a < 2:
            continue
        ring, start = int(key[a]) >> 56, int(key[a]) >> 48 & 255
        parts = masks(32, budgets[ring] + 1)
        order = [(ring // 2 + 1 + k) % len(words) for k in range(len(words))]  # the ring's own word last
        here = node[a:b]
        _Bucket(
            [words[k, a:b] for k in order],
            codes[ring, a:b].astype(np.uint64),
            parts[start + 1 :] + parts[:start],
            near,
            lambda x, y, d, here=here: found.put(here[x], here[y], d),
        ).join()
    return found.links()[:2]


def _links(keyed: DataFrame, pairs: Callable) -> DataFrame:
    """What `pairs` finds in the buckets of keyed(key, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, 50_000

        def links(table: pa.Table) -> pa.RecordBatch:
            a, b = pairs(table)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last bucket may go on
            if cut:
                yield links(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(key) - cut
            enough = max(50_000, rows * 5 // 4)
        if rows:
            yield links(pa.Table.from_batches(held).combine_chunks())

    n = workspace.partitions(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_links(codes: DataFrame, bits: int = 64, budget: int = 3, segments: int = 5, full: int = FULL) -> DataFrame:
    """(a, b): links that join every two nodes that pairs within the budget join.

    codes: node long, ring int, code long. Codes are distinct, and two nodes are a pair when their
    codes of a ring differ in at most `budget` bits: none is missed. A bucket of more than `full`
    codes is searched again by 16 segments, whose buckets hold 2 to the 12th distinct 64-bit codes
    at most, so nothing is lost.
    """
    workspace.ship(codes.sparkSession)

    def links(keyed: DataFrame, segments: int) -> DataFrame:
        parts = [np.uint64(m) for m in masks(bits, segments)]
        return _links(keyed.select("key", "node", "code"), lambda table: _pairs(table, parts, budget))

    keyed = codes.select("ring", "node", "code", F.explode(_keys(F.col("code"), bits, segments, budget, F.col("ring"))).alias("key"))
    crowded = workspace.saved(keyed.groupBy("key").count().where(F.col("count") > full), "crowded")
    if crowded.isEmpty():
        return links(keyed, segments)
    again = keyed.join(crowded, "key").select("ring", "node", "code").distinct()
    fine = again.select("node", "code", F.explode(_keys(F.col("code"), bits, 16, budget, F.col("ring"))).alias("key"))
    return links(keyed.join(crowded, "key", "left_anti"), segments).union(links(fine, 16))


def _block(key: str, low: Column, high: Column) -> Column:
    """The key of a block of two parts: ring and start as in the bucket's key."""
    rest = F.lit((1 << 48) - 1)
    return F.col(key).bitwiseAND(F.lit(-1 << 48)) + F.xxhash64(key, low, high).bitwiseAND(rest)


def wide_links(classes: DataFrame, rings: int, near: int, full: int = WIDE_FULL) -> DataFrame:
    """(a, b): pairs among classes(node long, wide binary) whose codes differ in `near` bits or fewer,
    enough of them to join every two nodes that such pairs join. A code has 32 * rings bits; rings
    are even.

    The rings' budgets add up so that some ring of a pair keeps within its own. It is cut into one
    segment more than its budget, so a chain starts at a segment that agrees: a code goes to a bucket
    for each of its segments, and there chains are followed. The rows of a bucket of more than `full`
    codes are dealt over parts, and every two parts meet in a block, so nothing is lost. A task puts
    out the nearest of its pairs: those that join what all of them do, and four of each node.
    """
    workspace.ship(classes.sparkSession)
    keys = []
    for k, budget in enumerate(_budgets(rings, near)):
        ring = F.conv(F.hex(F.substring("wide", 4 * k + 1, 4)), 16, 10).cast("long")
        keys += [F.lit(k << 56 | i << 48) + ring.bitwiseAND(F.lit(m)) for i, m in enumerate(masks(32, budget + 1) if budget >= 0 else ())]
    keyed = classes.select("node", "wide", F.explode(F.array(*keys)).alias("key"))
    crowded = workspace.saved(keyed.groupBy("key").count().where(F.col("count") > full), "crowded")
    if not crowded.isEmpty():
        keyed = keyed.join(F.broadcast(crowded), "key", "left")
        parts = F.ceil(F.col("count") / full)
        mine = F.pmod(F.xxhash64(F.lit(0), "node"), parts)
        met = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: _block("key", F.least(mine, j), F.greatest(mine, j)))
        keyed = keyed.select("node", "wide", F.explode(F.coalesce(met, F.array("key"))).alias("key"))
    return _links(keyed.select("key", "node", "wide"), lambda table: _wide_pairs(table, rings, near))


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit fingerprints of word shingles, repeats included,
    linked at `budget` differing bits or fewer; component_id is the least id that links reach.

    A null or empty text has fingerprint zero and is linked like any other. A null id stays null and
    is never a component's least id while there is another. Repeated rows come out as often. Other
    columns are not read. An empty table gives no rows.
    """
    marks = workspace.saved(
        map_texts(docs, {"doc_id": F.col(id_column).cast("long")}, F.col(text_column), lambda t: _signed(majority(shingle_hashes(t, words))), "long"), "fingerprints"
    )
    classes = workspace.saved(marks.groupBy("code").agg(F.min("doc_id").alias("first")), "classes")
    tied = components(near_links(classes.select(F.col("code").alias("node"), F.lit(0).alias("ring"), "code"), budget=budget))
    rooted = classes.join(tied, classes.code == tied.node, "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    rooted = workspace.saved(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = workspace.saved(rooted.join(least, "root").select("code", "component_id"), "labels")
    return marks.join(labels, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def sketch(text: str | None, words: int, octets: int) -> bytes:
    """A text's wide code, a digest of its set of shingles, and the sorted set itself."""
    hashes = np.unique(shingle_hashes(text, words))
    with np.errstate(over="ignore"):
        code = struct.pack(f"<{octets // 8}Q", *[majority(mixed(hashes, k + 1)) for k in range(octets // 8)])
    return code + xxhash.xxh3_64_digest(hashes.tobytes())


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, code) with each text's sorted shingle hashes."""
    return map_texts(texts, {"node": F.col("node")}, F.col("text"), lambda t: np.unique(shingle_hashes(t, words)).tobytes(), "binary")


def verified(links: DataFrame, sets: DataFrame, similarity: float, salted: int = 256) -> DataFrame:
    """The links(a, b) whose sets(node, code binary of sorted hashes) have that Jaccard similarity. Two
    empty sets are equal.

    The end that has more links is the hub. Its links are dealt over parts of about `salted`, each
    with a copy of the hub's set, so a task holds one set at a time and no hub is one task's work.
    """
    n = workspace.partitions(links.sparkSession)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    n_a, n_b = (ends.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    met = links.join(n_a, "a").join(n_b, "b")
    a_first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    spokes = met.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("spoke"))
    spokes = workspace.saved(spokes, "spokes")
    hubs = spokes.groupBy("hub").agg(F.ceil(F.count("*") / salted).alias("parts"))
    part = F.pmod(F.xxhash64("spoke"), F.col("parts"))
    tips = spokes.join(hubs, "hub").select("hub", "spoke", part.alias("part"))
    tips = tips.join(sets.withColumnRenamed("node", "spoke"), "spoke").select("hub", "part", "spoke", "code")
    heads = hubs.join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("spoke"), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for hub, spoke, code in zip(batch["hub"].to_pylist(), batch["spoke"].to_pylist(), batch["code"], strict=True):
                theirs = np.frombuffer(code.as_buffer() or b"", np.uint64)
                if spoke is None:
                    mine = theirs.copy()
                    continue
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if both >= similarity * (len(mine) + len(theirs) - both) - 1e-9:
                    out.append((hub, spoke))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    dealt = heads.unionByName(tips).repartition(n, "hub", "part").sortWithinPartitions("hub", "part", F.col("spoke").asc_nulls_first())
    return dealt.select("hub", "spoke", "code").mapInArrow(run, "a long, b long")


def unconfirmed_links(members: DataFrame, sets: DataFrame, near: int, similarity: float, heavy: int = 1 << 21, many: int = 4096) -> DataFrame:
    """(a, b): links among members(node, wide, tied, root) within `near` bits whose sets have that Jaccard
    similarity, enough to join all that such pairs join. `tied` is what candidates join and `root` what
    confirmed links have joined already.

    Only nodes of one `tied` can be within `near` bits, and pairs of one root need no look, so groups of one
    root are done. The nodes of the others are dealt over blocks of about `heavy` bytes of sets or `many`
    nodes, a large root's over blocks of their own, and every two blocks but two of one large root meet
    in a task, which holds no others. It compares each pair whose ends it has not joined yet.
    """
    spark = members.sparkSession
    parted = members.groupBy("tied").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tied")
    rows = members.join(parted, "tied").join(sets, "node")
    rows = workspace.saved(rows.withColumn("weight", F.greatest(F.lit(1 / many), F.length("code") / heavy)), "parted")
    roots = rows.groupBy("tied", "root").agg(F.sum("weight").alias("weight"))
    sizes = roots.withColumn("own", F.when(F.col("weight") >= 1, F.col("root")))
    large = workspace.saved(sizes.where("own IS NOT NULL").select("tied", "own"), "large")
    parts = sizes.groupBy("tied", "own").agg(F.ceil(F.sum("weight")).alias("parts"))
    parts = workspace.saved(parts, "parts")
    owned = rows.join(large.select(F.col("tied").alias("__tied"), F.col("own")), (F.col("tied") == F.col("__tied")) & (F.col("root") == F.col("own")), "left").drop("__tied")
    o, q = owned.alias("o"), parts.alias("q")
    dealt = o.join(q, (F.col("o.tied") == F.col("q.tied")) & F.col("o.own").eqNullSafe(F.col("q.own")))
    dealt = dealt.select("node", "wide", "root", "code", F.col("o.tied").alias("tied"), F.xxhash64("o.own", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    blocks = parts.select("tied", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k"))
    blocks = blocks.select("tied", "own", F.xxhash64("own", "k").alias("block"))
    x, y = blocks.alias("x"), blocks.alias("y")
    met = x.join(y, (F.col("x.tied") == F.col("y.tied")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.own").isNull() | F.col("y.own").isNull() | (F.col("x.own") != F.col("y.own"))))
    met = met.select(F.col("x.tied").alias("tied"), F.col("x.block").alias("low"), F.col("y.block").alias("high"))
    sides = met.select("tied", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    n = workspace.partitions(spark)
    order = ("tied", "low", "high")
    there = dealt.join(sides, ["tied", "block"]).repartition(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def links() -> pa.RecordBatch:
            found = _confirmed(held, near, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in order):
                    yield links()
                    held = []
                held.append(row)
        if held:
            yield links()

    return there.select(*order, "block", "node", "wide", "root", "code").mapInArrow(run, "a long, b long")


def _confirmed(rows: list[dict], near: int, similarity: float) -> list[tuple[int, int]]:
    """Links of two blocks' nodes, or of one block's, that join roots."""
    words = np.ascontiguousarray(np.frombuffer(b"".join(r["wide"] for r in rows), "<u8").reshape(len(rows), -1).T)
    root = np.array([r["root"] for r in rows])
    sets = [np.frombuffer(r["code"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    start, (values, flat) = np.cumsum(size) - size, np.unique(np.concatenate(sets), return_inverse=True)
    first = np.array([r["block"] == r["low"] for r in rows])
    single, found, marked = first.all(), [], np.zeros(len(values), dtype=bool)
    others = np.flatnonzero(~first | single)
    for k in np.flatnonzero(first).tolist():
        d = sum(np.bitwise_count(w[others] ^ w[k]).astype(np.int64) for w in words)
        at = others[(d <= near) & (root[others] != root[k]) & (np.minimum(size[others], size[k]) >= similarity * np.maximum(size[others], size[k]) - 1e-9) & (size[others] > 0)]
        if single:
            at = at[at > k]
        mine = flat[start[k] : start[k] + size[k]]
        marked[mine] = True
        for some in np.array_split(at, size[at].sum() // 1_000_000 + 1):
            if not len(some):
                continue
            before = np.cumsum(size[some]) - size[some]
            both = np.add.reduceat(marked[flat[np.repeat(start[some] - before, size[some]) + np.arange(size[some].sum())]], before, dtype=np.int64)
            for j in some[both >= similarity * (size[some] + size[k] - both) - 1e-9].tolist():
                if root[j] != root[k]:
                    found.append((rows[k]["node"], rows[j]["node"]))
                    root[root == root[j]] = root[k]
        marked[mine] = False
    return found


def _pieces(links: DataFrame, grown: DataFrame) -> DataFrame:
    """(node, tied, root) of the nodes of links(a, b) whose links join several pieces of grown(node, root); a
    node that grown has not is a piece of its own. Pieces stand for their nodes, so only refused links
    between them are followed."""
    ends = [grown.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    pieces = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select("a", "b", *[F.coalesce(f"root_{c}", c).alias(f"root_{c}") for c in "ab"])
    between = pieces.where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    tied = components(between).toDF("root", "tied")
    nodes = pieces.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.col(f"root_{c}").alias("root")) for c in "ab"])).alias("e")).select("e.*").distinct()
    return nodes.join(tied, "root").select("node", "tied", "root")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, rings: int = 8, slack: float = 1.6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(locator, id, stays) of a located table: each row's place, its id, and whether it stays.

    Texts are near when the Jaccard similarity of their sets of shingles is at least `similarity`. The
    fingerprints of 32 * rings bits find the candidates: all pairs at no more bits than this
    similarity has on average and `slack` standard deviations above, so 95 of 100 pairs at the
    threshold itself and nearly all beyond it. Of the candidates each task puts forward a forest of
    the nearest, and every one of these is held against the sets themselves. Where a refused one leaves what
    candidates join in several pieces, all candidates between the pieces are held against the sets as
    well, so none is left out. What confirmed links join is a group; its row with the least id stays, of one id the one whose locator is first. Texts with
    equal sets are one class, and so are null and empty texts. Null ids come last.
    """
    octets, bits = 4 * rings, 32 * rings
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    near = int(bits * share + slack * (bits * share * (1 - share)) ** 0.5)
    keys = {"locator": workspace.locator(docs), "id": F.col(id_column).cast("long")}
    marks = map_texts(docs, keys, F.col(text_column), lambda t: sketch(t, words, octets), "binary")
    marks = workspace.saved(marks.select("locator", "id", "code", F.xxhash64("code").alias("node")), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "locator")).alias("first")
    classes = workspace.saved(marks.groupBy("node").agg(first, F.min(F.substring("code", 1, octets)).alias("wide")), "classes")
    links = wide_links(classes.select("node", "wide"), rings, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = workspace.saved(links.distinct(), "candidates")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = workspace.saved(classes.join(ends, "node", "left_semi").select("node", F.col("first.locator").alias("place")), "places")
    blocks = known_hashes.blocks_for(places.count())
    wanted = workspace.saved(known_hashes.build(places, "place", blocks), "wanted-filter")
    texts = known_hashes.maybe_known(docs.select(workspace.locator(docs).alias("place"), F.col(text_column).alias("text")), wanted, "place", blocks)
    texts = texts.where("maybe").join(places, "place").select("node", "text")  # the filter keeps other texts out of the shuffle
    sets = workspace.saved(_sets(texts, words), "sets")
    confirmed = workspace.saved(verified(links, sets, similarity), "confirmed")
    grown = components(confirmed)
    members = workspace.saved(_pieces(links, grown).join(classes.select("node", "wide"), "node"), "members")
    more = workspace.saved(unconfirmed_links(members, sets, near, similarity), "more")
    if not more.isEmpty():
        grown = components(grown.toDF("a", "b").union(more))
    tied = grown.withColumnRenamed("node", "tied")
    rooted = workspace.saved(classes.join(tied, F.col("node") == F.col("tied"), "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("best"))
    stays = rooted.join(least, "root").select("node", F.col("best.locator").alias("best"))
    return marks.join(stays, "node").select("locator", "id", (F.col("locator") == F.col("best")).alias("stays"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, rings: int = 8, slack: float = 1.6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies, as near_copies() tells them: of each group one row stays, also
    of rows that repeat id and text. All columns are kept; an empty table stays empty."""
    docs = workspace.located(docs)
    marks = near_copies(docs, words, similarity, rings, slack, id_column, text_column)
    return workspace.without(docs, workspace.saved(marks.where("not stays").select("locator"), "near-copies"))
