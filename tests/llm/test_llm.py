"""Operators against brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from itemforge.llm import chat_format, components, exact_dedup, fingerprint, license_scan, packing, pieces, simhash, token_shards, tokens, toxicity, url_filter, workspace
from itemforge.llm.queries import tokenizer_path

WORD_BPE = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
#: Columns that clash with names the operators use inside.
CLASHES = ("_metadata", "__at", "at", "place", "spoke", "hub", "node", "row", "id", "key", "part", "hash", "code", "label", "x", "score", "digest", "locator", "keep_id", "stays", "known", "votes")
SCHEMA = "doc_id long, text string"


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES})



def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    long_text = words(30_000, 1)
    base = words(200, 2)
    near = base.replace(base.split()[10], "changed", 1)
    rows = [(1, None), (2, ""), (3, "a"), (4, long_text), (5, long_text), (6, base), (7, base), (7, base), (8, near), (9, "É\tx\nmit License. MIT-LICENSE"), (None, "no id"), (10, "<|endoftext|> 日本 \\ é</s>"), (11, " \n ")]
    return rows + [(100 + k, words(40, 10 + k) + "\n" + words(30, 500 + k)) for k in range(60)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).transform(clashing).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).transform(clashing)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# Encoding


def test_encoder_equals_library_on_random_text(library):
    r, coder = random.Random(3), tokens.WordEncoder(WORD_BPE, limit=50)
    alphabet = "aAzZ .,'\n\t\r\x0b\x1c\x85\xa0\xad09²½ªßÀÿĀéΣσςİKﬁ'sT're!!<|endoftext|>​日🙂́"
    for _ in range(2000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_new_ascii_words_need_no_call_of_the_whole_tokenizer(library, monkeypatch):
    """They go to its model, without the steps before it; letters beyond ASCII still take the whole way."""
    encoder, calls = tokens.WordEncoder(tokenizer_path("word_bpe_49k.json")), []

    class Counted:
        def encode(self, text, add_special_tokens):
            calls.append(text)
            return library.encode(text, add_special_tokens=add_special_tokens)

    encoder.library = Counted()
    for text in ("Zqxj wvkk's 90% of <b>it</b>, isn't-it?!", "an\nUPPER line 'll'"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not calls
    assert np.frombuffer(encoder.encode("fjørd qvist"), "<u4").tolist() == library.encode("fjørd qvist", add_special_tokens=False).ids
    assert calls == ["fjørd"]


@pytest.mark.parametrize("size", [1, 40, 1 << 21])
def test_texts_encoded_together_equal_the_library_one_by_one(library, monkeypatch, size):
    """Whatever stands at their borders and wherever a long one is cut; contractions, digits and signs too."""
    monkeypatch.setattr(tokens, "SLICE", size)
    r, coder = random.Random(12), tokens.WordEncoder(WORD_BPE, limit=60)
    texts = ["", None, "'", "'s", "x'", "'re've'll", "''s", "!'s", "a'sb", "'r", "'l 'll", "É'T’s", "²3½", "a×b÷c", "<|endoftext|>", "日本's", "\n\n", " ", "x" * 200, "a\tb"]
    texts += ["".join(r.choice("aàÉzsrevmltd''' 0²!-×µ\n") for _ in range(r.randint(0, 90))) for _ in range(400)]
    r.shuffle(texts)
    found = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all(texts)]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_words_of_many_texts_are_one_call(library):
    """Each distinct word is told once, and those beyond ASCII go to the library together."""
    coder, calls, told = tokens.WordEncoder(WORD_BPE), [], []

    class Counted:
        def encode(self, text, add_special_tokens):
            calls.append(text)
            return library.encode(text, add_special_tokens=add_special_tokens)

    class Model:
        def tokenize(self, word):
            told.append(word)
            return library.model.tokenize(word)

    coder.library, coder.model = Counted(), Model()
    texts = [f"Fjørd{c} qvist {c}é fjørd" for c in "abcdefgh"] * 5
    found = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all(texts)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert told == ["qvist"]
    assert len(calls) == 1
    assert len(calls[0].split()) == 17


def test_documents_are_read_back_by_runs(monkeypatch):
    """Neighbouring documents of RUN ids are one access to the shard, and no document is cut."""
    r, opened = np.random.default_rng(8), []
    lengths = r.integers(1, 60, 400)
    ids = r.integers(0, 50, lengths.sum()).astype(np.uint32)
    shard = token_shards.Shard(token_shards.to_bytes(*token_shards.compress(ids, 50), 50))
    look = shard.ids
    monkeypatch.setattr(shard, "ids", lambda start, n: opened.append(n) or look(start, n))
    monkeypatch.setattr(token_shards, "RUN", 1000)
    starts = np.cumsum(lengths) - lengths
    want = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(starts, lengths, strict=True)]
    assert list(token_shards._crcs(shard, starts, lengths)) == want
    assert len(opened) <= len(ids) // 1000 + 1
    assert max(opened) < 1060


def test_repair_round_trip_and_ranges():
    r = np.random.default_rng(4)
    for ids in ([], [1], [1, 1], [5] * 1000, [1, 2] * 600, [3, 3, 3, 2] * 100, (r.zipf(1.5, 20_000) % 300).tolist()):
        ids = np.array(ids, dtype=np.uint32)
        rules, lengths, seq = token_shards.compress(ids, 500)
        shard = token_shards.Shard(token_shards.to_bytes(rules, lengths, seq, 500))
        for start, n in ((0, 0), (0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, 1), *((int(a), 7) for a in r.integers(0, len(ids) + 1, 50))):
            assert (shard.ids(start, n) == ids[start : start + n]).all()

        def spelt(symbol):
            return [symbol] if symbol < 500 else spelt(rules[symbol - 500][0]) + spelt(rules[symbol - 500][1])

        assert [len(spelt(500 + k)) for k in range(len(rules))] == lengths.tolist()
        assert [x for s in seq.tolist() for x in spelt(s)] == ids.tolist()
        # No pair is left at four places that do not overlap.
        counts, last = {}, {}
        for k, pair in enumerate(zip(seq.tolist(), seq.tolist()[1:], strict=False)):
            if last.get(pair) != k - 1 or pair[0] != pair[1]:
                counts[pair] = counts.get(pair, 0) + 1
                last[pair] = k
        assert max(counts.values(), default=0) < 4
    assert len(seq) < 0.6 * len(ids) and len(rules)


def test_token_shards(spark, odd, odd_rows, empty, library):
    path = workspace.folder(spark, "t")
    token_shards.write_shards(odd, path, WORD_BPE, shard_tokens=500)
    got = [tuple(r) for r in token_shards.read_documents(spark.read.parquet(path)).collect()]
    start, want = 0, []
    for doc, text in sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = encoded(library, text)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(path).count() > 5
    path = workspace.folder(spark, "t")
    token_shards.write_shards(empty, path, WORD_BPE)
    assert token_shards.read_documents(spark.read.schema(token_shards.SHARD_SCHEMA).parquet(path)).count() == 0


def test_differencing_is_near_equal_and_within_capacity():
    r = random.Random(5)
    for n, k in ((1, 1), (3, 5), (10, 3), (400, 40)):
        weights = [r.randint(1, 256) for _ in range(n)]
        groups = packing.differencing(weights, k)
        assert sorted(i for g in groups for i in g) == list(range(n)) and len(groups) == k
    sums = [sum(weights[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 8
    assert all(sum(weights[i] for i in g) <= 300 for g in packing.windows(weights, 300))


@pytest.mark.parametrize("capacity", [2048, 1000])
def test_packing(odd, odd_rows, empty, library, capacity):
    rows = packing.pack(odd, WORD_BPE, capacity=capacity).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in odd_rows:
        ids = encoded(library, text)
        parts = sorted((p for p in by_doc[doc]), key=lambda p: p.start)
        if doc == 7:  # the row stands twice
            parts = parts[::2]
        at = 0
        for p in parts:
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding < 0.03 * sum(r.length for r in rows)
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_pieces_equal_library_and_round_trip(odd, odd_rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode_documents(odd, PIECES).collect()
    want = sorted(((d, sp.encode(t or ""), t or "") for d, t in odd_rows), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in rows), key=repr) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert pieces.encode_documents(empty, PIECES).count() == 0
    r, coder = random.Random(6), pieces.Encoder(pieces.Model(PIECES), limit=40)
    texts = ["".join(r.choice("abthe  in.,\n\t日é🙂▁ '(){}=01") for _ in range(r.randint(0, 50))) for _ in range(1500)] + [" " * k + "a" for k in range(40)]
    for k in range(0, len(texts), 20):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts[k : k + 20])] == sp.encode(texts[k : k + 20])


def test_unigram_viterbi_against_all_segmentations():
    r = random.Random(7)
    vocabulary = {"▁": -3.0, "a": -4.0, "b": -4.5, "ab": -5.0, "▁a": -5.5, "ba": -6.1, "aba": -7.3, "bb": -9.0}
    model = pieces.Model.of([("<unk>", 0.0, 2), *[(p, s, 1) for p, s in vocabulary.items()]], pieces.UNIGRAM)
    coder = pieces.Encoder(model)

    def best(text):
        if not text:
            return 0.0
        return max((vocabulary.get(text[:k], -19.0 if k == 1 else -1e9) + best(text[k:]) for k in range(1, len(text) + 1)))

    for _ in range(200):
        text = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        ids = np.frombuffer(coder.encode([text])[0], "<u4").tolist()
        assert "".join(model.pieces[k] for k in ids) == "▁" + text
        assert sum(model.scores[k] for k in ids) == pytest.approx(best("▁" + text))


# Duplicates


def brute_dedup(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    top = {t: max(ids, key=lambda d: (d is not None, d or 0)) for t, ids in groups.items()}
    return sorted(((d, top[t or ""], len(groups[t or ""])) for d, t in rows), key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "short"])
@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_exact_dedup(spark, odd, odd_rows, digest, files_per_batch):
    path = workspace.folder(spark, "t")
    odd.repartition(3).write.parquet(path)
    got = exact_dedup.dedup_files(spark, path, digest, files_per_batch).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute_dedup(odd_rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in odd_rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_state_lasts(spark):
    """A second call with the same folder streams only the new files, on top of the state."""
    path, home = workspace.folder(spark, "t"), workspace.folder(spark, "home")
    first = [(1, "a"), (2, "b"), (3, None)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(path)
    assert sorted(r.keep_id for r in exact_dedup.dedup_files(spark, path + "/", home=home).collect()) == [1, 2, 3]
    more = [(4, "a"), (0, "b"), (5, "c"), (6, "")]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = exact_dedup.dedup_files(spark, path, home=home).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute_dedup(first + more)
    assert sum(r.kept for r in got) == 4
    again = exact_dedup.dedup_files(spark, path, home=home).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert exact_dedup.sha256 and spark.read.parquet(f"{home}/state").count() == 7  # three rows, then four changed


def test_drop_copies_keeps_columns(odd, odd_rows, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in odd_rows})
    assert exact_dedup.drop_copies(empty).count() == 0


def brute_fingerprint(text, n=3):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[k : k + n]) for k in range(max(1, len(parts) - n + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, budget):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_simhash_components(odd, odd_rows, empty):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(odd).collect()), key=repr)
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))
    codes = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(codes, 3)
    assert got == sorted(((d, f"{c:016x}", rows[k][0]) for (d, _), c, k in zip(rows, codes, label, strict=True)), key=repr)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("full", [simhash.FULL, 4])
def test_near_links_miss_nothing(spark, full):
    r = random.Random(8)
    codes = set()
    for _ in range(60):
        c = r.getrandbits(64)
        for _ in range(6):
            codes.add(c)
            for _ in range(r.randint(1, 4)):
                c ^= 1 << r.randrange(64)
    codes = sorted(codes)
    nodes = spark.createDataFrame([(simhash._signed(c), 0, simhash._signed(c)) for c in codes], "node long, ring int, code long")
    links = simhash.near_links(nodes, full=full)
    assert all((r.a ^ r.b) & (1 << 64) - 1 for r in links.collect())
    root = {r.node & (1 << 64) - 1: r.root for r in components.components(links).collect()}
    label = brute_components(codes, 3)
    for i, c in enumerate(codes):
        for j in range(i):
            same = root.get(c, f"alone{i}") == root.get(codes[j], f"alone{j}")
            assert same == (label[i] == label[j])


def test_components_write_few_links_to_few_files(spark, monkeypatch):
    """A file is made for every FILE_ROWS links, not for every partition."""
    written, save = [], workspace.saved
    monkeypatch.setattr(workspace, "saved", lambda df, name: written.append(save(df, name)) or written[-1])
    joined, kept = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(components, "FILE_ROWS", 60)
    try:
        spark.conf.set(joined, "false")
        _few_files(spark, monkeypatch, written)
    finally:
        spark.conf.set(joined, kept)


def _few_files(spark, monkeypatch, written):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 400, 2)] + [(1, 2), (5, 8)], "a long, b long")
    assert components.components(links).select("node").distinct().count() == 400
    assert len(written[1].inputFiles()) > 1
    written.clear()
    monkeypatch.setattr(components, "FILE_ROWS", 50_000)
    assert components.components(links).select("node").distinct().count() == 400
    assert [len(x.inputFiles()) for x in written[1:]] == [1] * (len(written) - 1)


def test_pieces_follow_refused_links_only(spark):
    """Of 1-2-3, 4-5 and 6-7 the link 2-4 was refused, and 8-9 too; what has one piece is not looked at."""
    links = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (4, 5), (6, 7), (8, 9)], "a long, b long")
    grown = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)], "node long, root long")
    assert sorted(map(tuple, simhash._pieces(links, grown).collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4), (8, 8, 8), (9, 8, 9)]


def test_pairs_held_are_cut_down_in_time():
    """A bucket's pairs are cut down before they take more than some hundred bytes for each of MANY."""
    r, found = np.random.default_rng(3), simhash._Found()
    a, b = r.integers(0, 3000, (2, 1_500_000))
    for x, y in zip(np.array_split(a, 30), np.array_split(b, 30), strict=True):
        found.put(x, y + 3000, (x + y) % 40)
        assert found.size <= 600_000
    one = simhash._Found()
    one.held, one.size = [(a, b + 3000, (a + b) % 40)], len(a)
    assert len(np.unique(np.stack(found.links()[:2]))) == len(np.unique(np.stack(one.links()[:2])))


def test_components_of_paths_and_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in components.components(path).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 200: 200, 201: 200}
    assert components.components(path.limit(0)).count() == 0


def _wide_classes(spark, codes, near, full):
    """The least number of each code's component, by wide_links and by brute force."""
    rows = [(k, c.to_bytes(32, "big")) for k, c in enumerate(codes)]
    links = simhash.wide_links(spark.createDataFrame(rows, "node long, wide binary"), 8, near, full)
    close = ((a, b) for a, b in itertools.combinations(range(len(codes)), 2) if (codes[a] ^ codes[b]).bit_count() <= near)
    return _least(len(codes), (tuple(r) for r in links.collect())), _least(len(codes), close)


def _least(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        if low != high:
            label = [low if x == high else x for x in label]
    return label


def test_records_with_half_surrogates_and_deep_nesting_are_read(spark):
    record = json.dumps({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]})
    rows = [(1, record.replace('"x"', '"a\\ud83d"')), (2, '{"messages": ' + "[" * 100_000 + "]" * 100_000 + "}"), (3, '{"\\ude00": 1}'), (4, record)]
    got = chat_format.from_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert {(r.conv_id, r.turn, r.text) for r in got if r.conv_id in (1, 4)} == {(1, 0, "a\ufffd"), (1, 1, "y"), (4, 0, "x"), (4, 1, "y")}
    assert {r.conv_id for r in got if r.mapping is None} == {2, 3} and len(got) == 6
    assert chat_format.from_records(spark.createDataFrame([], "conv_id long, record string")).count() == 0


def test_license_hits_are_told_by_their_words(spark):
    """With hashes that nearly all collide the spans are the same."""

    def few(found, k):
        return license_scan.gram_hashes(found, k) % 3

    texts = ["released under the MIT License today", "mit apache license mit license", "license mit general public license " * 3, words(400, 3), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    weak = license_scan.Templates(license_scan.BASE, license_scan.NOTICES, hashes=few)
    rows = lambda found: sorted((r.doc_id, r.n_words, str(r.spans)) for r in found.collect())
    assert rows(license_scan.scan(docs, weak)) == rows(license_scan.scan(docs))
    assert [s.label for s in license_scan.scan(docs, weak).where("doc_id = 1").first().spans] == ["apache", "mit"]


@pytest.mark.parametrize("full", [simhash.FULL, 4])
def test_wide_links_of_crowded_buckets(spark, full):
    rng = random.Random(5)
    codes = []
    for _ in range(60):  # all alike in the first ring; pairs are 42 bits apart, six in each other ring
        a = rng.getrandbits(224)
        codes += [a, a ^ sum(1 << (32 * k + j) for k in range(7) for j in rng.sample(range(32), 6))]
    got, want = _wide_classes(spark, codes, 45, full)
    assert got == want
    assert len(set(want)) == 60


@pytest.mark.parametrize(("near", "full"), [(45, simhash.WIDE_FULL), (45, 50), (6, 4)])
def test_wide_links_of_even_differences(spark, near, full):
    rng = random.Random(6)
    codes = [0] * 3
    for _ in range(40):  # a pair has its differences spread over all rings
        a = rng.getrandbits(256)
        codes += [a, a ^ sum(1 << (32 * k + j) for k in range(8) for j in rng.sample(range(32), near // 8 + (k < near % 8)))]
    for flips in (10, 30, 50):  # dense groups, loose ones, and two that a link joins at their rims
        a = rng.getrandbits(256)
        codes += [a ^ sum(1 << j for j in rng.sample(range(256), rng.randint(0, flips))) for _ in range(600)]
    got, want = _wide_classes(spark, codes, near, full)
    assert got == want


def test_drop_near_copies(spark, odd, empty):
    base = [words(300, 40 + k) for k in range(20)]
    rows = []
    for k, t in enumerate(base):
        parts = t.split()
        rows.append((10 * k, t))
        for j in range(3):
            changed = list(parts)
            changed[50 * (j + 1)] = f"edit{j}"
            rows.append((10 * k + 1 + j, " ".join(changed)))
    docs = spark.createDataFrame(rows, SCHEMA).transform(clashing)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(20)]
    assert simhash.drop_near_copies(odd).count() > 60
    assert simhash.drop_near_copies(empty).count() == 0


def _jaccard(a, b, n=5):
    x, y = ({tuple(t.split()[k : k + n]) for k in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def _pairs_around(share, n, seed):
    """Texts and edited copies whose similarity lies around a share."""
    r, rows = random.Random(seed), []
    for k in range(n):
        parts = words(r.randint(80, 300), 7000 + seed + k).split()
        changed, at = list(parts), 3
        while at < len(parts) - 3 and _jaccard(" ".join(parts), " ".join(changed)) > share + r.uniform(-0.06, 0.06):
            changed[r.randrange(len(parts))] = f"edit{k}x{at}"
            at += 1
        rows += [(2 * k, " ".join(parts)), (2 * k + 1, " ".join(changed))]
    return rows


def test_near_copies_against_exact_similarity(spark):
    rows = _pairs_around(0.82, 250, 20)
    docs = spark.createDataFrame(rows, SCHEMA).transform(clashing)
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).select("doc_id").collect()}
    gone = {d for d, _ in rows} - kept
    text = dict(rows)
    near = {2 * k + 1 for k in range(250) if _jaccard(text[2 * k], text[2 * k + 1]) >= 0.8}
    assert 100 < len(near) < 240
    assert gone <= near  # every removal is confirmed
    assert len(gone) >= 0.94 * len(near)


def test_near_copies_of_a_dense_group(spark):
    """A cloud of edits of one text: each removal has a confirmed link in its group."""
    r = random.Random(21)
    base, texts = words(150, 22).split(), {}
    for k in range(2500):
        changed = list(base)
        for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6))):
            changed[r.randrange(150)] = f"edit{k}x{r.random()}"
        texts[k] = " ".join(changed)
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    kept = {x.doc_id for x in simhash.drop_near_copies(docs).select("doc_id").collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for t in texts.values()]
    index = {}
    for s in sets:
        for g in s:
            index.setdefault(g, len(index))
    counts = np.zeros((2500, len(index)), dtype=np.float32)
    for k, s in enumerate(sets):
        counts[k, [index[g] for g in s]] = 1
    both = counts @ counts.T
    size = np.array([len(s) for s in sets])
    near = both >= 0.8 * (size[:, None] + size - both) - 1e-6
    np.fill_diagonal(near, False)
    label = _spread(near)
    assert all(near[k].any() for k in range(2500) if k not in kept)
    want = {int(np.flatnonzero(label == c)[0]) for c in set(label.tolist())}
    assert want <= kept  # no more goes than exact components say
    assert 2500 - len(kept) >= 0.93 * (2500 - len(want))


@pytest.mark.parametrize(("heavy", "many"), [(1 << 21, 4096), (20_000, 40)])
def test_near_copies_lose_no_candidate(spark, monkeypatch, heavy, many):
    """Clouds of edits, loose ones and two that a few links join: the groups are those of all pairs within the
    bits whose similarity suffices, also where the nearest candidates are refused."""
    look = simhash.unconfirmed_links
    monkeypatch.setattr(simhash, "unconfirmed_links", lambda *args: look(*args, heavy=heavy, many=many))
    r, texts = random.Random(31), []
    for cloud, edits in enumerate([(1, 2, 3, 4, 6), (3, 4, 5), (2, 3, 4)]):
        base = words(150, 50 + cloud).split()
        for k in range(220):
            changed = list(base)
            for _ in range(r.choice(edits)):
                changed[r.randrange(150)] = f"edit{cloud}x{k}x{r.random()}"
            texts.append(" ".join(changed))
    kept = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).select("doc_id").collect()}
    codes = [int.from_bytes(simhash.sketch(t, 5, 32)[:32], "big") for t in texts]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (codes[a] ^ codes[b]).bit_count() <= 47 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = _least(len(texts), pairs)
    assert 3 < len(set(want)) < 600
    assert kept == set(want)


def _spread(near):
    label = np.arange(len(near))
    while True:
        low = np.where(near, label, len(near)).min(axis=1)
        new = np.minimum(label, low)
        if (new == label).all():
            return label
        label = new


def test_verified_links_deal_a_hub_over_parts(spark):
    sets = [(0, np.arange(100, dtype=np.uint64))] + [(k, np.arange(k % 40, 100, dtype=np.uint64)) for k in range(1, 900)] + [(900, np.empty(0, np.uint64)), (901, np.empty(0, np.uint64))]
    table = spark.createDataFrame([(k, s.tobytes()) for k, s in sets], "node long, code binary")
    links = spark.createDataFrame([(0, k) for k in range(1, 900)] + [(900, 901), (0, 900)], "a long, b long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.verified(links, table, 0.8, salted=16).collect()}
    assert got == {(0, k) for k in range(1, 900) if k % 40 <= 20} | {(900, 901)}
    assert simhash.verified(links.limit(0), table, 0.8).count() == 0


# Conversations


def test_chat_layouts_become_equal_turns(spark):
    says = [("user", "hi <s> \\ [/INST]"), ("assistant", "</s>[INST] ok")]
    records = [
        {"messages": [{"role": a, "content": b} for a, b in says]},
        {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[a], "value": b} for a, b in says]},
        {"prompt": says[0][1], "completion": says[1][1], "other": {"x": 1}},
        {"instruction": says[0][1], "input": "", "output": says[1][1]},
        {"question": says[0][1], "answer": says[1][1]},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, "{"), (91, None), (92, '{"foo": 1}')]
    turns = chat_format.from_records(spark.createDataFrame(rows, "conv_id long, record string"))
    assert {r.conv_id for r in turns.where("mapping is null").collect()} == {90, 91, 92}
    segments = chat_format.formatted(turns)
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_format.parsed(segments).collect()) == sorted((k, n, a, b) for k in range(5) for n, (a, b) in enumerate(says))
    got = chat_format.digests(segments).collect()
    assert len({(r.turns_sha256, r.loss_sha256, r.formatted_chars) for r in got}) == 1
    assert got[0].loss_sha256 == hashlib.sha256(says[1][1].encode()).hexdigest() and got[0].loss_chars == len(says[1][1])
    inner = segments.select(F.regexp_extract("formatted", r"(?s)^<s>(.*)</s>$", 1).alias("t")).collect()
    assert all(r.t.count("[INST]") == 1 and "</s>" not in r.t for r in inner)


def test_chat_table_with_nulls_and_ties(spark):
    rows = [(1, None, None, None), (1, 0, "user", "é🙂"), (1, 0, "assistant", "b\\"), (None, 3, "assistant", ""), (2, 1, "tool", "x\ny")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"fingerprint": F.lit("f"), "mapping": F.lit(1)})
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(chat_format.from_table(table))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("\n\nassistant\nb\\\nuser\né🙂\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (2, 1, 0)
    assert chat_format.digests(chat_format.formatted(chat_format.from_table(table.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat_format.from_table(table.drop("role"))


# Licenses, URLs


def test_license_scan(odd, odd_rows, empty, spark):
    upper = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    got = license_scan.scan(odd).collect()
    want = []
    for doc, text in odd_rows:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        places = [i for p in license_scan.BASE for q in [p.split()] for i in range(len(found)) if found[i : i + len(q)] == q]
        want.append((doc, len(found), sorted(places)))
    assert sorted(((r.doc_id, r.n_words, sorted(s.start for s in r.spans if s.base)) for r in got), key=repr) == sorted(want, key=repr)
    assert license_scan.scan(empty).count() == 0
    notice = "x permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation y"
    texts = [(1, notice), (2, "licensed under"), (3, "general public license general public license")]
    by = {r.doc_id: r.spans for r in license_scan.scan(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert [(s.label, s.start) for s in by[1]] == [("mit", 1)] and 0.75 <= by[1][0].coverage < 1
    assert by[2] == [] and [s.start for s in by[3]] == [0, 3]


def test_license_spans_against_brute_force(spark):
    """Spans of texts made of a notice with words dropped, added and changed."""
    r, notice = random.Random(30), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    t, texts = notice.split(), []
    for k in range(120):
        parts = list(t)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(parts))
            r.choice((lambda at=at: parts.pop(at), lambda at=at: parts.insert(at, "more"), lambda at=at: parts.__setitem__(at, "other")))()
        texts.append((k, " ".join(["x"] * r.randint(0, 5) + parts + ["y"] * 3)))
    templates = license_scan.Templates({}, {notice: "mit"})
    got = {r.doc_id: r.spans for r in license_scan.scan(spark.createDataFrame(texts, SCHEMA), templates).collect()}
    for k, text in texts:
        found, by = text.split(), {}
        for p in range(len(found) - 3):
            for q in range(len(t) - 3):
                if found[p : p + 4] == t[q : q + 4]:
                    by.setdefault(p - q, []).append(q)
        groups = []
        for d in sorted(by):
            groups.append(groups.pop() + [d] if groups and d - groups[-1][-1] <= 2 else [d])
        want = []
        for g in groups:
            covered = {q + j for d in g for q in by[d] for j in range(4)}
            if len(covered) >= 0.75 * len(t):
                want.append((min(d + min(by[d]) for d in g), max(d + max(by[d]) + 4 for d in g), round(len(covered) / len(t), 9)))
        assert [(s.start, s.end, round(s.coverage, 9)) for s in got[k]] == sorted(want)
    assert 20 < sum(bool(s) for s in got.values()) < 120


def test_rolling_hashes_equal_each_windows_own():
    found = words(3000, 31).encode().split()
    for k in (1, 2, 4):
        assert license_scan.gram_hashes(found, k).tolist() == [int(license_scan.gram_hashes(found[i : i + k], k)[0]) for i in range(len(found) - k + 1)]
    assert len({int(license_scan.gram_hashes(f.split(), 2)[0]) for f in (b"a bc", b"ab c", b"a b", b"b a", b"a  b c")[:4]}) == 4


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = None
    for says, rule in url_filter.RULES:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (says, rule)
    return host, path, *(best or (None, None))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.NET/x?y", "http://net/", "http://net", "https://planet/", "http://x.example.net/en/1", "http://example.net/de/", "ftp://É.example.com/de/a#b", "http://a.org/fr/?q=://", "http://a.org/en/", "://x.org/fr/\nz", "http://casino-jackpot.example.com/en/1", "http://blog.example.com/en/2"]
    urls += [f"http://h{k % 9}.example.net/{'en' if k % 2 else 'fr'}/{k}" for k in range(80)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "text": F.lit("x"), "rule": F.lit(2)})
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path, says, rule = brute_url(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (says or got[k].verdict) and got[k].verdict in ("allow", "block")
    assert got[13].score < got[14].score
    # The threshold: the greatest score that at most one in fifty of the accepted texts is below.
    def text(url):
        host, path, says, rule = brute_url(url)
        if rule:
            site, rest = rule.split("/", 1)
            whole = host[: len(host) - len(site)] + "~" + path[len("/" + rest) :]
        else:
            whole = host + path
        whole = "".join(c.lower() if "A" <= c <= "Z" else c for c in whole)
        return "^" + re.sub("[^a-z0./_-]", "~", re.sub("[0-9]+", "0", whole)) + "$", says

    accepted = {}
    for k, url in enumerate(urls):
        t, says = text(url)
        if (says or ("block" if any(w in t for w in url_filter.REJECTED) else "allow")) == "allow":
            accepted[t, says] = got[k].score
    scores = sorted(accepted.values())
    free = [g for g in got.values() if g.rule is None]
    allowed, blocked = [g.score for g in free if g.verdict == "allow"], [g.score for g in free if g.verdict == "block"]
    assert max(blocked) < min(allowed)
    assert sum(s <= max(blocked) for s in scores) <= 0.02 * len(scores) + 1
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_with_a_hot_text_and_null_ids(spark):
    rows = [(k, f"http://a.com/en/{k}") for k in range(3000)] + [(None, "http://b.com/x"), (None, "http://b.com/x"), (5, None)] + [(k, f"http://h{'abcdefghij'[k % 10]}.com/{'klmnop'[k % 6]}") for k in range(60)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((r.page_id, r.host) for r in got if r.page_id is not None) == sorted((k, brute_url(u)[0]) for k, u in rows if k is not None)
    assert sum(r.page_id is None for r in got) == 2 and len({r.score for r in got if r.host == "a.com"}) == 1


def test_url_filter_reads_the_whole_url(spark):
    good = [f"https://www.{w}{k}.com/{s}/{k}" for k in range(20) for w in ("library", "museum", "weather") for s in ("en", "guide")]
    bad = ["https://www.casino-win.com/en/1", "http://www.a.org/casino/1", "https://poker.com/", "http://b.co/jackpot"]
    ruled = ["https://casino.net/en/1", "http://www.example.net/en/1"]
    pages = spark.createDataFrame(list(enumerate(good + bad + ruled)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[len(good) + k].verdict for k in range(4)] == ["block"] * 4
    assert sum(got[k].verdict == "allow" for k in range(len(good))) > 110
    assert max(got[len(good) + k].score for k in range(4)) < min(got[k].score for k in range(len(good)))
    text = url_filter.symbols(F.lit("www.example.net"), F.lit("/en/a/1"), F.lit("example.net/en/"))
    assert spark.range(1).select(text).first()[0] == "^www.~a/0$"


def test_url_model_against_brute_force(spark):
    examples = [("^ab$", True, 1.0), ("^abc$", True, 2.0), ("^xb$", False, 1.0), ("^x0$", False, 3.0)]
    model = {r.gram: r.ratio for r in url_filter.train(spark.createDataFrame(examples, "text string, accepted boolean, weight double"), 2).collect()}

    def p(gram, accepted):
        if not gram:
            return 1 / 35
        n, kinds = {}, set()
        for text, a, w in examples:
            for i in range(len(text) - len(gram) + 1):
                g = text[i : i + len(gram)]
                if a == accepted and g[:-1] == gram[:-1]:
                    n[g] = n.get(g, 0) + w
                    kinds.add(g)
        total, lower = sum(n.values()), p(gram[1:], accepted)
        return (n.get(gram, 0) + len(kinds) * lower) / (total + len(kinds)) if total else lower

    for gram, ratio in model.items():
        assert ratio == pytest.approx(np.log(p(gram, True) / p(gram, False)), abs=1e-8), gram
    score = url_filter.score(spark.createDataFrame([("^aq$",)], "text string"), spark.createDataFrame(list(model.items()), "gram string, ratio double"), 2).first().score
    assert score == pytest.approx((model["^"] + model["^a"] + 0 + model["$"]) / 4, abs=1e-8)


# Fingerprints


def test_sketches_peel_the_difference():
    r = random.Random(9)
    for n, d in ((0, 0), (5, 1), (50, 20), (400, 300)):
        shared = [r.getrandbits(64) for _ in range(n)]
        a, b = [r.getrandbits(64) for _ in range(d)], [r.getrandbits(64) for _ in range(d // 2)]
        mine, theirs = fingerprint.difference(shared + a, shared + b)
        assert sorted(mine) == sorted(a) and sorted(theirs) == sorted(b)
    assert len({fingerprint.Sketch().add(fingerprint.digests(t)).text() for t in ("a b\nc", "a  b\nc", "a b\nd")}) == 2


def test_fingerprints(odd, odd_rows, empty, spark):
    got = sorted((r for r in fingerprint.fingerprints(odd).collect()), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256), reverse=True)
    rows = sorted(((d, t or "") for d, t in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = fingerprint.edited(text, following)
        a, b, c = (set(fingerprint.digests(t)) for t in (text, changed, following))
        like = lambda x, y: 1.0 if not x | y else 1 - len(x ^ y) / (len(x) + len(y))
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got] == sorted(want, key=key, reverse=True)
    assert fingerprint.fingerprints(empty).count() == 0
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "x y")], SCHEMA)).first()
    assert alone.near_next == 1.0


# Toxicity


@pytest.fixture(scope="module")
def abuse(spark):
    r = random.Random(10)
    rows, labels = [], []
    for k in range(1500):
        parts = words(60, 2000 + k).split()
        toxic = k % 8 == 0
        if toxic:
            for _ in range(4):
                parts.insert(r.randrange(len(parts)), r.choice(["idiot", "scum", "pathetic", "zzgrunkel" + r.choice("abc"), "zzgrunkom"]) if k % 16 else "zzgrunk" + r.choice(["ela", "omb", "ist"]))
        rows.append((k, " ".join(parts)))
        if k % 3:
            labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out_accuracy(abuse):
    docs, labels = abuse
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0}
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_label_model_posterior_is_bayes_rule():
    r = np.random.default_rng(12)
    says = r.dirichlet(np.ones(3), (4, 2))
    model = toxicity.LabelModel(0.3, says, np.array([1.0, 0.5, 1.0, 0.25]))
    for vote in r.integers(-1, 2, (20, 4)):
        toxic, clean = 0.3, 0.7
        for v, s in enumerate(vote):
            toxic, clean = toxic * says[v, 1, s + 1] ** model.weight[v], clean * says[v, 0, s + 1] ** model.weight[v]
        assert model.posterior(vote[None])[0] == pytest.approx(toxic / (toxic + clean))


def test_label_model_sees_voters_that_repeat_each_other():
    r = np.random.default_rng(13)
    truth = r.random(20_000) < 0.3
    one = np.where(r.random(20_000) < 0.8, truth, ~truth) * 2 - 1
    votes = np.stack([one, one, *(np.where(r.random(20_000) < 0.8, truth, ~truth) * 2 - 1 for _ in range(3))], axis=1).astype(np.int8)
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    label = np.full(len(patterns), np.nan)
    model = toxicity.fit_label_model(patterns, count.astype(float), label, 0.3)
    assert model.weight[:2] == pytest.approx([0.5, 0.5], abs=0.1) and model.weight[2:].min() > model.weight[:2].max() + 0.1
    beyond = toxicity.correlations(patterns, count.astype(float), model.posterior(patterns))
    assert beyond[0, 1] > 0.9 and beyond[2, 3] < 0.5


def test_toxicity_scores_are_the_classifiers(spark, abuse):
    docs, labels = abuse
    mined = toxicity.mine(docs, labels)
    seen = toxicity.observed(docs, mined)
    classifier = toxicity.fit(seen, labels, mined)
    rows = {r.doc_id: r for r in docs.collect()}
    for r in toxicity.toxicity(docs, labels).collect()[:300]:
        x = toxicity.observe(rows[r.doc_id].text, mined)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(classifier.beta[0] + sum(b * v for b, v in zip(classifier.beta[1:], x, strict=True))))))
    # A document's votes do not depend on whether a word of some lexicon stands in it.
    a, b = toxicity.observe("you are stupidly wrong"), toxicity.observe("you are stupidly wrong, what a joke")
    k = toxicity.FEATURES.index("address")
    assert a[k] == b[k] > 0


def test_toxicity_ignores_held_out_labels(abuse):
    docs, labels = abuse
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 12)) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    kept = toxicity.drop_toxic(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    assert toxicity.drop_toxic(empty).count() == 0


def test_label_model_finds_accuracies():
    r = np.random.default_rng(11)
    truth = r.random(20_000) < 0.2
    votes = np.stack([np.where(r.random(20_000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.9, 0.85)], axis=1).astype(np.int8)
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, count.astype(float), np.full(len(patterns), np.nan), 0.2)
    assert abs(model.balance - 0.2) < 0.03
    assert [round(model.says[v, 1, 2], 1) for v in range(3)] == [0.9, 0.9, 0.9] or np.allclose(model.says[:, 1, 2], (0.95, 0.9, 0.85), atol=0.04)


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, workspace.saved(stage(spark, docs, sf_dir), name)
        counts.append(docs.select("doc_id").distinct().count())
        if name != "packing":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        if name == "exact_dedup":
            assert counts[-1] == before.select("text").distinct().count()
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]


def test_pipeline_stages_on_odd_rows(spark, odd, odd_rows, empty):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    for start, ids in ((odd, {d for d, _ in odd_rows}), (empty, set())):
        docs = workspace.saved(start, "t")
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, workspace.saved(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == before.columns
            ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()} if name != "packing" else ids
        assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids
    assert not ids


def test_two_pipelines_at_once_keep_to_their_own_folders(spark):
    from concurrent.futures import ThreadPoolExecutor

    def job(k):
        folders, rows = workspace.Folders(), spark.range(5)
        for n in range(3):
            with folders.stage(f"s{n}"):
                rows = workspace.saved(rows, f"job{k}")
            if n:
                folders.drop(f"s{n - 1}")
        return rows.count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(job, range(4))) == [5] * 4
