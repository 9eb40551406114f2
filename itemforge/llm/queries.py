"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import alignment, chat_format, exact_dedup, fingerprint, license_scan, merkle, packing, pieces, simhash, token_shards, toxicity, url_filter, warc, workspace


def tokenizer_path(name: str) -> str:
    """A public tokenizer file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    found = exact_dedup.dedup_files(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to shards in ascending doc_id order and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = workspace.folder(spark, "token-shards")
    token_shards.write_shards(docs, path, tokenizer_path("word_bpe_49k.json"))
    return token_shards.read_documents(spark.read.parquet(path))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, written, and read back, with one that says control strings."""
    says = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": r, "content": says} for r in ("user", "assistant")]})
    extra = chat_format.from_records(spark.createDataFrame([(-7, record)], "conv_id long, record string"))
    turns = chat_format.from_table(spark.read.parquet(f"{sf_dir}/conversations.parquet")).union(extra)
    return chat_format.digests(workspace.saved(chat_format.formatted(turns), "chat"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places of the base phrases, and the labels of all its notices."""
    found = license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by the rules and else by the character models."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048, a row for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint of 3-word shingles and its component at 3 bits."""
    return simhash.simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the piece model, and the digest of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, and its likeness to its edited text and to the next document."""
    return fingerprint.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from four fifths of the rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and roots, the digest of its proof, and the root that a row tampered with
    gives where its id's crc32 is divisible by 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    other = merkle.leaf_hash(*[F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in columns])
    found = merkle.manifest(docs, columns, "lang", "doc_id", {"tampered": F.when(hit, other)})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.path_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two tokenizers, their groups, and its links by corpus-wide counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    stretches = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), workspace.folder(spark, "warc"))
    return warc.read(stretches, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fingerprint": op9_fingerprint,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_alignment": op12_alignment,
    "op13_warc": op13_warc,
}



def _leaf_sql(n_chars: str) -> str:
    cells = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(cells)})"


#: The reflected CRC-32 of a text's bytes, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce([4294967295] || [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda s, c: list_reduce([xor(s, c)] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf,
                CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS tampered FROM documents),
            p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
            t AS (SELECT g, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY g
                UNION ALL SELECT g, level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)] FROM t WHERE len(nodes) > 1),
            s AS (SELECT g, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM t WHERE len(nodes) = 1),
            u AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
                UNION ALL SELECT level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)] FROM u WHERE len(nodes) > 1),
            w AS (SELECT p.doc_id, p.g, p.pos, t.level, (p.pos >> t.level) % 2 = 1 AS odd, t.nodes[xor(p.pos >> t.level, 1) + 1] AS sibling FROM p JOIN t ON t.g = p.g AND len(t.nodes) > 1
                UNION ALL SELECT p.doc_id, p.g, p.pos, s.height + u.level, (s.place >> u.level) % 2 = 1, u.nodes[xor(s.place >> u.level, 1) + 1] FROM p JOIN s ON s.g = p.g JOIN u ON len(u.nodes) > 1),
            h AS (SELECT g, pos, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof, count(*) AS levels, list(coalesce(sibling, '') ORDER BY level) AS siblings, list(odd ORDER BY level) AS odds FROM w GROUP BY g, pos),
            f AS (SELECT p.g, p.pos, 0 AS level, coalesce(tampered, leaf) AS node, coalesce(levels, 0) AS levels, siblings, odds FROM p LEFT JOIN h ON h.g = p.g AND h.pos = p.pos
                UNION ALL SELECT g, pos, level + 1, sha256(CASE WHEN odds[level + 1] THEN siblings[level + 1] || node ELSE node || siblings[level + 1] END), levels, siblings, odds FROM f WHERE level < levels)
        SELECT p.doc_id, p.leaf, s.subroot, r.nodes[1] AS root, sha256(coalesce(h.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = r.nodes[1] AS verified
        FROM p JOIN s ON s.g = p.g JOIN f ON f.g = p.g AND f.pos = p.pos AND f.level = f.levels LEFT JOIN h ON h.g = p.g AND h.pos = p.pos JOIN u r ON len(r.nodes) = 1""",
    "op13_warc": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keep FROM d)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM h""",
    "op3_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'),
            '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'),
            '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), '<|endoftext|>', '<\|endoftext|>') AS safe FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(safe) + 20) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
