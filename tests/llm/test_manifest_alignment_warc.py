"""The Merkle manifest, the alignment of tokenizers and the WARC archives against brute force and round trips."""

import base64
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from itemforge.llm import alignment, merkle, sorted_shards, warc, workspace
from itemforge.llm.queries import tokenizer_path

BYTE_BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
CLASHES = ("g", "n", "pos", "node", "top", "path", "at", "part", "block", "items", "levels", "id", "tie", "key", "pairs", "times", "locator", "digest", "bytes", "_metadata")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """(root, the path of each node): a node's siblings level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for leaf, at in enumerate(where):
            run = runs[at // arity]
            paths[leaf].append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
        nodes, where = [h(*run) for run in runs], [at // arity for at in where]
    return nodes[0], paths


def folded(leaf, path):
    for left, right in path:
        leaf = h(left, leaf, right)
    return leaf


@pytest.mark.parametrize("arity, block_levels", [(2, 1), (2, 2), (3, 1), (2, 8)])
def test_manifest_is_the_tree_of_brute_force(spark, arity, block_levels):
    r = random.Random(arity)
    rows = [(k, r.choice(["a", "a", "a", "é", None, "only"] if k else ["only"]), r.choice([None, k]), r.choice(["", "é\n", "x" * 5000, None])) for k in range(60)]
    rows = [x for x in rows if x[1] != "only"] + [(900, "only", 1, "x"), (7, "a", 7, "same"), (7, "a", 7, "same"), (7, "a", 8, "tie"), (None, "a", None, None), (None, None, 3, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, lang string, size long, text string").repartition(3))
    columns = ["doc_id", "lang", "size", "text"]
    got = merkle.manifest(df, columns, "lang", "doc_id", {"twice": F.col("size") * 2}, arity, block_levels).withColumns({"folded": merkle.fold(F.col("leaf"), F.col("path")), "proof": merkle.path_hash(F.col("path"))}).collect()
    groups = {}
    for x in rows:
        groups.setdefault(x[1], []).append(((x[0] is not None, x[0] or 0), leaf_of(x), x))
    want = []
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([leaf for _, leaf, _ in sorted(groups[g])], arity) for g in names}
    root, above = tree([below[g][0] for g in names], arity)
    for g, up in zip(names, above, strict=True):
        for (_, leaf, x), path in zip(sorted(groups[g], key=lambda y: y[:2]), below[g][1], strict=True):
            assert folded(leaf, path + up) == root
            want.append((str(x[0]), leaf, below[g][0], root, h(*[a + b for a, b in path + up]), str(x[2] and x[2] * 2)))
    assert sorted((str(x.id), x.leaf, x.subroot, x.root, x.proof, str(x.twice)) for x in got) == sorted(want)
    assert all(x.folded == x.root for x in got)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(5, None)], "doc_id long, lang string")
    (x,) = merkle.manifest(one, ["doc_id", "lang"], "lang", "doc_id").withColumn("proof", merkle.path_hash(F.col("path"))).collect()
    assert x.leaf == x.subroot == x.root == h("1:5", "-") and x.path == [] and x.proof == h("")
    assert merkle.manifest(one.limit(0), ["doc_id", "lang"], "lang", "doc_id").count() == 0


def test_manifest_tells_rows_that_changed(spark):
    rows = spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("lang"), F.lit("text").alias("text"))
    kept = workspace.saved(merkle.manifest(rows, ["id", "text"], "lang", "id", block_levels=2), "kept")
    now = rows.withColumn("text", F.when(F.col("id") == 31, "Text").otherwise(F.col("text"))).union(spark.createDataFrame([(99, "0", "text")], rows.schema))
    assert {x.id for x in merkle.verify(now, kept, ["id", "text"], "id").where("not verified").collect()} == {31, 99}


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_alignment(a, b, text):
    """(ids, ids, groups, links) by comparing the byte ranges of every two tokens."""
    from tokenizers import decoders

    full = f" {text}".encode()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    alphabet = {c: k for k, c in enumerate(alignment.Pair._byte_chars())}
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    assert decoders.ByteLevel().decode([a.id_to_token(k) for k in ids_a]) == f" {text}"
    if b"".join(bytes_a) != full or b"".join(bytes_b) != full:
        return [], [], [], []
    at_a, at_b = (np.cumsum([0, *map(len, x)]).tolist() for x in (bytes_a, bytes_b))
    links = [(x, y) for x in range(len(ids_a)) for y in range(len(ids_b)) if at_a[x] < at_b[y + 1] and at_b[y] < at_a[x + 1]]
    ends = sorted(set(at_a[1:]) & set(at_b[1:]))
    groups, start = [], 0
    for end in ends:
        groups.append(tuple([ids[k] for k in range(len(ids)) if start <= at[k] and at[k + 1] <= end] for ids, at in ((ids_a, at_a), (ids_b, at_b))))
        start = end
    return ids_a, ids_b, groups, [(ids_a[x], ids_b[y]) for x, y in links]


def odd_texts():
    r = random.Random(5)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", "  ", " ", " ", "　", "​", "᠎", "\x1c", "\x85", "日本", "'s", "1", "22", ".", "-", "<|endoftext|>", "</s>", "<0x0A>", "ﬁ", "é", "😀", "the ", "of "]
    return [None, "", " ", "\n", "a", "▁", "a▁b", "x\n\ny", "\n a \n", " lead", "trail ", "tab\tin", "x" * 300, "日本" * 100, "same text here", "same text here"] + ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(400)]


def test_alignment_equals_brute_force(spark, libraries):
    texts = odd_texts()
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(5, texts[5])]
    got = alignment.align(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), BYTE_BPE, PIECES).collect()
    found = [(doc, *(brute_alignment(*libraries, t) if t else ([], [], [], []))) for doc, t in rows]
    count = Counter(link for *_, links in found for link in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    want = []
    for doc, a, b, groups, links in found:
        words = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        want.append((str(doc), len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(words.encode()).hexdigest() if a else ""))
    assert sorted((str(x[0]), *x[1:]) for x in map(tuple, got)) == sorted(want)


def test_alignment_of_no_rows_and_of_rows_without_tokens(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, BYTE_BPE, PIECES).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"), BYTE_BPE, PIECES).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_units_keep_their_tokens_when_the_memo_is_small(libraries):
    small, large = alignment.Pair(BYTE_BPE, PIECES, limit=3), alignment.Pair(BYTE_BPE, PIECES)
    for t in odd_texts():
        mine, theirs = small.align(t), large.align(t)
        assert mine[:4] == theirs[:4] and mine[4].tolist() == theirs[4].tolist()


def test_sorted_shards_sum_runs_over_file_borders(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 50 - 25 << 33, 1) for k in range(1000)], "key long, n long").repartition(5)
    counts = alignment.partial_counts(rows.select(F.array("key", "key").alias("pairs")), held=16)
    files = sorted_shards.write(counts, "key", "n", limit=4)
    lookup = sorted_shards.Lookup(files, "key", opened=2)
    asked = np.array([k - 30 << 33 for k in range(60)] * 2, dtype="<i8")
    got = np.zeros(len(asked), int)
    for which, at, table in lookup.find(asked):
        got[which] = table["n"].to_numpy()[at]
    assert got.tolist() == [40 if -25 <= k - 30 < 25 else 0 for k in range(60)] * 2
    assert len(files) > 4 and [f for _, f in files] == sorted(f for _, f in files)


def test_alignment_counts_do_not_depend_on_how_counts_are_held(spark, libraries):
    rows = spark.createDataFrame([([1, 5, 9],), ([5],), ([],), ([9, 5],)], "pairs array<long>").repartition(3)
    got = alignment.partial_counts(rows, held=2).groupBy("key").agg(F.sum("n").alias("n")).collect()
    assert {x.key: x.n for x in got} == {1: 1, 5: 3, 9: 2}


# WARC


@pytest.fixture(scope="module")
def page_rows():
    r = random.Random(9)
    body = ["<html><head><title>{}</title></head><body>{}</body></html>".format(k, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randint(5, 60)))) for k in range(80)]
    rows = [(k, f"https://site{k % 7}.example/é path?q={k}", b) for k, b in enumerate(body)]
    rows += [(200, None, body[3]), (201, "bad\r\nInjected: x", body[3]), (201, "again", body[3]), (None, "null id", body[3]), (300, "e", None), (301, "e", ""), (302, "e", ""), (400, "long", "é" * 300_000), (None, "n", "two null"), (None, "n", "two null"), (-5, "minus", "tiny"), (-4, "minus", "tiny"), (7, "x", "\r\n\r\nWARC/1.1\r\n")]
    return rows


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return clashing(spark.createDataFrame(page_rows, "page_id long, url string, html string").repartition(4))


SMALL = {"training": 12_000, "dictionary_bytes": 512, "archive_bytes": 6000, "stretch_bytes": 1500}


@pytest.mark.parametrize("least", [0, 5])
def test_archives_give_back_every_page(spark, pages, page_rows, least):
    stretches = warc.write(pages, workspace.folder(spark, "warc-test"), min_bytes=least, **SMALL)
    got = warc.read(stretches).collect()
    assert sorted((str(x.page_id), str(x.url), x.payload_bytes) for x in got) == sorted((str(p), str(u), len((t or "").encode())) for p, u, t in page_rows)
    groups = {}
    for p, _, t in page_rows:
        groups.setdefault((t or "").encode(), []).append(p)
    for x in got:
        if x.record_type == "response":
            assert len(x.payload) == x.payload_bytes and x.refers_to is None
            assert x.payload_digest == base64.b32encode(hashlib.sha1(x.payload).digest()).decode()
    by_digest = {base64.b32encode(hashlib.sha1(t).digest()).decode(): (t, ids) for t, ids in groups.items()}
    for digest, (t, ids) in by_digest.items():
        mine = [x for x in got if x.payload_digest == digest]
        first = [x for x in mine if x.record_type == "response"]
        top = max(ids, key=lambda k: (k is not None, k or 0))
        if len(t) < least:
            assert len(first) == len(ids)
        else:
            assert [x.page_id for x in first] == [top] and bytes(first[0].payload) == t
            assert all(x.refers_to == top and x.payload is None for x in mine if x.record_type == "revisit")
    assert stretches.select("path").distinct().count() > 1


def test_an_archive_is_one_stream_of_single_frames_after_its_dictionary(spark, pages):
    stretches = warc.write(pages.coalesce(1), workspace.folder(spark, "warc-test"), **SMALL).collect()
    for path in {x.path for x in stretches}:
        data = open(path.removeprefix("file:"), "rb").read() if not path.startswith("file://") else open(path.removeprefix("file://"), "rb").read()
        known = warc.head_dictionary(io.BytesIO(data))
        assert known is not None and len(known) > 0
        start = 8 + len(known)
        kinds = [headers["warc-type"] for headers, _ in warc.parse(warc.frames(data[start:], known))]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"}
        assert len(kinds) == 1 + sum(x.records for x in stretches if x.path == path)
        press, n = zstandard.ZstdDecompressor(dict_data=known), 0
        rest = data[start:]
        while rest:  # each record is a frame of its own
            one = press.decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = one.unused_data, n + 1
        assert n == len(kinds)


def test_a_dictionary_makes_small_records_smaller():
    samples = [warc.page_record(k, f"https://a.example/{k}", f"<html><body>page {k} of the archive</body></html>".encode(), str(k), "2024-01-01T00:00:00Z", None) for k in range(400)]
    made = warc.dictionary(samples, 4096)
    plain, with_it = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=3, dict_data=made)
    assert sum(len(with_it.compress(s)) for s in samples) < 0.6 * sum(len(plain.compress(s)) for s in samples)


def test_damage_is_told_and_odd_tables_pass(spark, pages):
    whole = warc.page_record(1, "u", b"payload", "l", "2024-01-01T00:00:00Z", None).replace(b"payload", b"PAYLOAD")
    with pytest.raises(ValueError, match="damaged"):
        [warc.page_row(*x) for x in warc.parse(io.BytesIO(whole))]
    with pytest.raises(ValueError, match="ends early"):
        list(warc.parse(io.BytesIO(whole[:-20])))
    none = warc.write(pages.limit(0), workspace.folder(spark, "warc-test"))
    assert none.count() == 0 and warc.read(none).count() == 0
