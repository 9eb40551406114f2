"""Queries over the driver's tables and the SQL that must give the same rows.

The tables stand for a question bank: regions and nations are topics, customers and orders items,
line items options, events votes and stages, documents texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import keys, layout, relational, selection, topics, upsert
from itemforge.sources import files
from itemforge.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEED = 20_240
#: A lexicon of frequent words, some shared by two topics.
LEXICON = {
    "english": ("the", "and", "of", "with", "for", "en"),
    "french": ("le", "la", "les", "que", "qui", "de", "en"),
    "german": ("der", "die", "und", "nicht", "ver"),
    "spanish": ("los", "para", "que", "de", "ciudad", "cion"),
}
#: Normalised text in SQL.
NORM = r"lower(strip_accents(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))))"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _norm(column: str) -> str:
    return NORM.format(column)


# Text


@_query(r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS cleaned FROM documents")
def text_clean(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@_query(f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def text_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@_query(f"SELECT doc_id, trim(regexp_replace({_norm('text')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def text_slug(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@_query(r"SELECT page_id, regexp_replace(url, '\d+', '#', 'g') AS masked FROM pages")
def mask_digits(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.mask_digits(F.col("url")).alias("masked"))


@_query(f"SELECT doc_id, sha256(CASE WHEN coalesce(text, '') = '' THEN '' ELSE {_norm('text')} || chr(10) END || {_norm('lang')}) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text"), F.col("lang")).alias("hash"))


@_query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') AS escaped FROM pages")
def markup_escape(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.escape_markup(F.col("html")).alias("escaped"))


@_query(
    r"""SELECT doc_id, round(length(regexp_replace(s, '[^\p{L}\p{N}\s.,;:!?()\[\]{}"''`´/\\|@#$%&*+\-=<>_~^°ºª§–—…]', '', 'g')) / length(s), 6) AS share
    FROM (SELECT doc_id, substring(text, 1, 20000) AS s FROM documents) WHERE length(s) > 0"""
)
def legibility_ratio(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.round(T.legible_share(F.col("text")), 6).alias("share"))
    return rows.where("share IS NOT NULL")


@_query("SELECT conv_id AS doc_id, sum(length(coalesce(text, ''))) / count(DISTINCT turn) >= 120 AS has_text FROM conversations GROUP BY conv_id")
def has_text_layer(spark, sf_dir):
    pages = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return layout.has_text_layer(pages)


_SPACED = r"' ' || trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g'))"


@_query(f"SELECT doc_id FROM documents WHERE contains({_SPACED}, ' the') AND contains({_SPACED}, ' on') AND contains({_SPACED}, ' ea')")
def search_prefix_all_terms(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(T.matches_all(F.col("text"), '"The" on Eá')).select("doc_id")


@_query(
    r"""SELECT event_id, nullif(regexp_extract(upper(event_type || ' (' || substr('ABCDEFG', CAST(event_id % 7 AS INT) + 1, 1) || ')'), '\b([A-E])\b', 1), '') AS letter,
    CASE WHEN event_id % 9 BETWEEN 1 AND 6 THEN CAST(event_id % 9 AS INT) END AS number FROM events"""
)
def model_output_parsing(spark, sf_dir):
    letter = F.concat("event_type", F.lit(" ("), F.substring(F.lit("ABCDEFG"), (F.col("event_id") % 7 + 1).cast("int"), F.lit(1)), F.lit(")"))
    raw = F.concat(F.lit("topic "), (F.col("event_id") % 9).cast("string"), F.lit("."))
    return _table(spark, sf_dir, "events").select("event_id", T.answer_letter(letter).alias("letter"), T.answer_index(raw, F.lit(6)).alias("number"))


@_query("SELECT p_partkey, CASE WHEN p_size <= 26 THEN p_size - 1 ELSE ((p_size - 1) // 26 - 1 + 1) * 26 + (p_size - 1) % 26 END AS col, chr(CAST(65 + p_size % 26 AS INT)) AS letter FROM part")
def cell_reference_index(spark, sf_dir):
    n = F.col("p_size") - 1
    reference = F.concat(F.when(n >= 26, T.letter((n / 26).cast("int") - 1)).otherwise(""), T.letter(n % 26), F.lit("7"))
    return _table(spark, sf_dir, "part").select("p_partkey", T.column_index(reference).alias("col"), T.letter(F.col("p_size") % 26).alias("letter"))


# Duplicates


@_query(f"SELECT hash, count(*) AS n FROM (SELECT sha256({_norm('text')}) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return relational.duplicates(_table(spark, sf_dir, "documents").select(T.content_hash(F.col("text")).alias("hash")), "hash")


@_query(f"SELECT min(doc_id) AS doc_id, hash FROM (SELECT doc_id, sha256({_norm('text')}) AS hash FROM documents) GROUP BY hash")
def dedup_first_seen(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return relational.first_seen(rows, F.col("hash"), [F.col("doc_id")])


@_query(
    f"""SELECT min(page_id) AS page_id, hash FROM (SELECT page_id, sha256({_norm("regexp_extract(url, '://([^/?#]*)', 1)")}) AS hash FROM pages)
    WHERE hash NOT IN (SELECT sha256({_norm("lang || '.example.net'")}) FROM documents) GROUP BY hash"""
)
def dedup_against_known(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", T.content_hash(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("hash"))
    known = _table(spark, sf_dir, "documents").select(T.content_hash(F.concat("lang", F.lit(".example.net"))).alias("key"))
    return relational.first_seen(pages, F.col("hash"), [F.col("page_id")], known)


# Topics

_LEXICON_SQL = ", ".join(f"('{s}', '{t}')" for s, ts in LEXICON.items() for t in ts)
_SCORES_SQL = rf"""lex AS (SELECT * FROM (VALUES {_LEXICON_SQL}) v(slug, term)),
    w AS (SELECT slug, term, 1.0::DOUBLE / count(*) OVER (PARTITION BY term) AS weight FROM lex),
    d AS (SELECT doc_id, {_norm('text')} AS folded FROM documents),
    h AS (SELECT doc_id, slug, weight, len(regexp_extract_all(folded, '(^|[^a-z0-9])' || term)) AS hits FROM d, w),
    e AS (SELECT doc_id, slug, sum(weight * (1 + 0.25 * (hits - 1))) AS evidence FROM h WHERE hits > 0 GROUP BY ALL),
    s AS (SELECT doc_id, slug, round(evidence, 6) AS evidence, round(evidence / sum(evidence) OVER (PARTITION BY doc_id), 6) AS score FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, slug) AS rank FROM s)"""


def _lexicon(spark):
    return spark.createDataFrame([(s, t) for s, ts in LEXICON.items() for t in ts], "slug string, term string")


@_query(f"WITH lex AS (SELECT DISTINCT lang AS slug, unnest(string_split({_norm('text')}, ' ')) AS term FROM documents) SELECT slug, term, 1.0::DOUBLE / count(*) OVER (PARTITION BY term) AS weight FROM lex")
def lexicon_weights(spark, sf_dir):
    """Every word of the documents as a term of its language."""
    words = F.explode(F.split(T.normalize(F.col("text")), " ")).alias("term")
    return topics.weights(_table(spark, sf_dir, "documents").select(F.col("lang").alias("slug"), words))


@_query(f"WITH {_SCORES_SQL} SELECT doc_id, slug, evidence, score FROM s")
def lexicon_scores(spark, sf_dir):
    return topics.lexicon_scores(_table(spark, sf_dir, "documents"), _lexicon(spark))


@_query(f"WITH {_SCORES_SQL} SELECT doc_id, slug, score, CAST(rank AS INT) AS rank FROM r WHERE (rank = 1 OR score >= 0.45) AND rank <= 3")
def lexicon_top_topics(spark, sf_dir):
    return topics.top_topics(lexicon_scores(spark, sf_dir)).select("doc_id", "slug", "score", "rank")


@_query(
    f"""WITH {_SCORES_SQL}, b AS (SELECT doc_id, max(slug) FILTER (rank = 1) AS slug, max(score) FILTER (rank = 1) AS first, max(score) FILTER (rank = 2) AS second FROM r GROUP BY doc_id)
    SELECT doc_id, slug, first AS score, CASE WHEN first IS NULL THEN 'none' WHEN first >= 0.45 OR second IS NULL OR first >= 2 * second THEN 'lexicon' ELSE 'model' END AS decision
    FROM documents LEFT JOIN b USING (doc_id)"""
)
def cascade_decision(spark, sf_dir):
    return topics.cascade(_table(spark, sf_dir, "documents"), lexicon_scores(spark, sf_dir))


def _topics(spark, sf_dir):
    region = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nation = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("name"))
    return region.union(nation)


def _links(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), (F.col("c_nationkey") + 100).cast("long").alias("topic"))


_TOPICS_SQL = """t AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name FROM region
    UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation),
    l AS (SELECT c_custkey AS item, c_nationkey + 100 AS topic, c_acctbal > 0 AS usable FROM customer),
    reach AS (SELECT topic, item, usable FROM l UNION SELECT parent, item, usable FROM l JOIN t ON l.topic = t.id WHERE parent IS NOT NULL)"""


@_query(f"WITH {_TOPICS_SQL} SELECT id, count(DISTINCT item) AS total, count(DISTINCT item) FILTER (usable) AS available FROM t LEFT JOIN reach ON id = topic GROUP BY id")
def topic_counts_hierarchical(spark, sf_dir):
    usable = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("item"))
    return relational.topic_counts(_topics(spark, sf_dir), _links(spark, sf_dir), usable)


@_query(f"WITH {_TOPICS_SQL} SELECT id, parent, name FROM t")
def topic_tree(spark, sf_dir):
    return relational.tree_order(_topics(spark, sf_dir))


@_query(f"WITH {_TOPICS_SQL} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT item FROM reach WHERE topic = 2)")
def topic_children(spark, sf_dir):
    items = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), "c_custkey", "c_name")
    return relational.under_topic(items, _topics(spark, sf_dir), _links(spark, sf_dir), 2).select("c_custkey", "c_name")


@_query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def untagged_anti_join(spark, sf_dir):
    items = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "doc_id", "lang")
    return relational.untagged(items, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"))).select("doc_id", "lang")


@_query(
    """WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM v)
    SELECT user_id, event_type AS choice, round(n / total, 3) AS share FROM r WHERE k = 1"""
)
def vote_share(spark, sf_dir):
    return topics.vote_share(_table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), valid_only=False)


@_query(
    """WITH v AS (SELECT user_id, nullif(event_type, 'view') AS choice, count(*) AS n FROM events GROUP BY ALL),
    r AS (SELECT *, sum(n) FILTER (choice IS NOT NULL) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY choice IS NULL, n DESC, choice) AS k FROM v)
    SELECT user_id, choice, round(CASE WHEN choice IS NOT NULL THEN n END / total, 3) AS share FROM r WHERE k = 1"""
)
def topic_vote_share(spark, sf_dir):
    return topics.vote_share(_table(spark, sf_dir, "events"), ["user_id"], F.when(F.col("event_type") != "view", F.col("event_type")), valid_only=True)


# Read models

_MODEL_SQL = """m AS (SELECT o_orderkey AS id, o_custkey AS origin, c_name AS origin_name, n_name AS topic,
    CASE o_orderstatus WHEN 'F' THEN 'valida' WHEN 'O' THEN 'multipla' ELSE 'ausente' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'inferido_ml' WHEN '2-HIGH' THEN NULL ELSE 'manual' END AS source,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0::DOUBLE END AS confidence,
    o_orderkey % 11 <> 0 AS active, o_orderkey % 3 = 0 AS reviewed, coalesce(options, 0) AS options, letters
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0
    LEFT JOIN (SELECT l_orderkey, count(*) AS options, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS letters FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def _model(spark, sf_dir):
    orders, customer, nation, lines = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("options"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("letters"))
    # The topic's condition stands in the join, so that items without a principal topic stay.
    named = customer.join(nation, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > 0), "left")
    met = orders.join(named, F.col("o_custkey") == F.col("c_custkey"), "left").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
    return met.select(
        key.alias("id"), F.col("o_custkey").alias("origin"), F.col("c_name").alias("origin_name"), F.col("n_name").alias("topic"),
        F.when(F.col("o_orderstatus") == "F", "valida").when(F.col("o_orderstatus") == "O", "multipla").otherwise("ausente").alias("status"),
        F.when(priority == "1-URGENT", "inferido_ml").when(priority == "2-HIGH", None).otherwise("manual").alias("source"),
        F.when(key % 7 != 0, key % 100 / 100).alias("confidence"), (key % 11 != 0).alias("active"), (key % 3 == 0).alias("reviewed"),
        F.coalesce("options", F.lit(0)).alias("options"), "letters",
    )


@_query(f"WITH {_MODEL_SQL} SELECT * FROM m")
def wide_read_model(spark, sf_dir):
    return _model(spark, sf_dir)


@_query(f"WITH {_MODEL_SQL} SELECT id, topic FROM m WHERE active AND status IN ('valida', 'multipla') AND options >= 2 AND source <> 'inferido_ml'")
def eligible_pool(spark, sf_dir):
    return relational.eligible(_model(spark, sf_dir)).select("id", "topic")


@_query(f"WITH {_MODEL_SQL} SELECT id, confidence FROM m WHERE active AND source = 'inferido_ml' AND status IN ('valida', 'multipla')")
def suggestion_queue(spark, sf_dir):
    return relational.suggestion_queue(_model(spark, sf_dir)).select("id", "confidence")


@_query(f"WITH {_MODEL_SQL} SELECT id, confidence FROM m WHERE NOT reviewed AND active AND (confidence IS NULL OR confidence < 0.7)")
def review_queue(spark, sf_dir):
    return relational.review_queue(_model(spark, sf_dir)).select("id", "confidence")


@_query(f"WITH {_MODEL_SQL} SELECT id, topic IS NULL OR coalesce(confidence, 0) < 0.7 AS needs FROM m")
def importer_review_rule(spark, sf_dir):
    remarks = F.when(F.col("topic").isNull(), F.lit("no topic"))
    return _model(spark, sf_dir).select("id", relational.needs_review(remarks, F.col("confidence")).alias("needs"))


@_query(
    f"""WITH {_MODEL_SQL} SELECT id, CASE WHEN NOT active THEN 'inactive' WHEN status = 'ausente' THEN 'no key' WHEN options < 2 THEN 'too few options'
    WHEN source = 'inferido_ml' THEN 'inferred key' END AS reason FROM m"""
)
def ineligible_reasons(spark, sf_dir):
    c = F.col
    return _model(spark, sf_dir).select("id", relational.ineligible_reason(c("id"), c("active"), c("status"), c("options"), c("source")).alias("reason"))


@_query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS letters FROM lineitem GROUP BY l_orderkey")
def flat_answer_key(spark, sf_dir):
    return relational.joined_letters(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def paged_listing(spark, sf_dir):
    return relational.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 2)


@_query(f"WITH {_MODEL_SQL} SELECT status, count(*) AS n FROM m WHERE active AND topic IS NOT NULL GROUP BY status")
def count_by_filter(spark, sf_dir):
    return _model(spark, sf_dir).where("active AND topic IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"))


@_query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(o_orderkey % 5, 0), o_orderkey), o_orderkey) AS INT) AS position FROM orders")
def exam_question_order(spark, sf_dir):
    number = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 5)
    rows = selection.renumber(_table(spark, sf_dir, "orders"), "o_custkey", [F.coalesce(number, F.col("o_orderkey")), F.col("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", F.col("number").alias("position"))


# Selection and assembly


def _sql_key(*ids: str) -> str:
    return "sha256(concat_ws(':', '%d', %s))" % (SEED, ", ".join(f"CAST({i} AS VARCHAR)" for i in ids))


@_query(f"SELECT c_mktsegment, c_custkey, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_sql_key('c_custkey')}, c_custkey) AS k FROM customer) WHERE k <= 10")
def quota_draw_seeded(spark, sf_dir):
    return selection.draw_by_group(_table(spark, sf_dir, "customer"), "c_mktsegment", 10, SEED, "c_custkey").select("c_mktsegment", "c_custkey", "rank")


def _reach(spark, sf_dir):
    return relational.topic_reach(_topics(spark, sf_dir), _links(spark, sf_dir))


@_query(
    f"""WITH {_TOPICS_SQL}, a AS (SELECT item FROM reach WHERE topic = 103 ORDER BY {_sql_key('item')}, item LIMIT 5),
    b AS (SELECT item FROM reach WHERE topic = 1 AND item NOT IN (SELECT item FROM a) ORDER BY {_sql_key('item')}, item LIMIT 7)
    SELECT CAST(103 AS BIGINT) AS topic, item FROM a UNION ALL SELECT CAST(1 AS BIGINT), item FROM b"""
)
def quota_draw_scarcest_first(spark, sf_dir):
    return selection.draw_quotas(_reach(spark, sf_dir), [(1, 7), (103, 5), (4, 0)], SEED)[0].select("topic", "item")


@_query(f"WITH {_TOPICS_SQL} SELECT CAST(107 AS BIGINT) AS topic, CAST(100000 AS INT) AS wanted, CAST(count(DISTINCT item) AS INT) AS got FROM reach WHERE topic = 107 HAVING count(DISTINCT item) < 100000")
def quota_shortfall(spark, sf_dir):
    return selection.draw_quotas(_reach(spark, sf_dir), [(107, 100_000), (2, 3)], SEED)[1]


@_query(
    f"""WITH p AS (SELECT * FROM (VALUES (12, 0), (7, 1), (40, 2)) v(item, position)),
    d AS (SELECT c_custkey AS item, row_number() OVER (ORDER BY {_sql_key('c_custkey')}, c_custkey) AS position FROM customer WHERE c_acctbal > 0 QUALIFY position <= 50)
    SELECT CAST(item AS BIGINT) AS item, CAST(position AS INT) AS position, 0 AS source FROM p WHERE item IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT item, CAST(position AS INT), 1 FROM d WHERE item NOT IN (SELECT item FROM p)"""
)
def mixed_selection(spark, sf_dir):
    pool = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), "c_acctbal")
    picked = selection.requested([12, 7, 12, 40], pool).where("usable").select("item", "position")
    drawn = selection.draw_by_group(pool.where("c_acctbal > 0").withColumn("g", F.lit(1)), "g", 50, SEED).select("item", F.col("rank").alias("position"))
    return selection.mixed(picked, drawn)


@_query(f"SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY {_sql_key('turn')}, turn) AS INT) AS number FROM conversations")
def renumber_exam(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return selection.renumber(rows, "conv_id", [selection.draw_key(SEED, F.col("turn")), F.col("turn")])


def _options(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.select("l_orderkey", T.letter(F.col("l_linenumber") - 1).alias("letter"))


_SHUFFLE_SQL = f"""o AS (SELECT DISTINCT l_orderkey, chr(CAST(64 + l_linenumber AS INT)) AS letter FROM lineitem),
    s AS (SELECT l_orderkey, letter AS original, chr(CAST(64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_sql_key('l_orderkey', 'letter')}, letter) AS INT)) AS printed FROM o)"""


@_query(f"WITH {_SHUFFLE_SQL} SELECT l_orderkey, printed, original FROM s")
def option_shuffle_map(spark, sf_dir):
    return selection.shuffle_options(_options(spark, sf_dir), ["l_orderkey"], "letter", SEED)


@_query(
    f"""WITH {_SHUFFLE_SQL}, a AS (SELECT DISTINCT l_orderkey, chr(CAST(64 + l_linenumber AS INT)) AS letter FROM lineitem WHERE l_returnflag = 'R')
    SELECT a.l_orderkey, string_agg(printed, ',' ORDER BY printed) AS letters FROM a JOIN s ON a.l_orderkey = s.l_orderkey AND a.letter = s.original GROUP BY 1"""
)
def answer_sheet_translated(spark, sf_dir):
    right = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(T.letter(F.col("l_linenumber") - 1))).alias("letters"))
    maps = selection.letter_map(option_shuffle_map(spark, sf_dir), ["l_orderkey"])
    return selection.answer_sheet(right, maps, ["l_orderkey"])


_GRID_CELLS = ", ".join(f"max(number || ' ' || role) FILTER (col = {k}) AS c{k}" for k in range(5))


@_query(
    f"""WITH n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, ceil(count(*) OVER (PARTITION BY conv_id) / 5) AS h FROM conversations),
    p AS (SELECT *, CAST((number - 1) % h AS INT) AS row, CAST(floor((number - 1) / h) AS INT) AS col FROM n) SELECT conv_id, row, {_GRID_CELLS} FROM p GROUP BY ALL"""
)
def answer_grid(spark, sf_dir):
    rows = selection.renumber(_table(spark, sf_dir, "conversations"), "conv_id", [F.col("turn")])
    return selection.answer_grid(rows.select("conv_id", "number", F.col("role").alias("letters")), "conv_id")


# Answer keys

def _typed() -> str:
    """A line item as it is typed into its order's key: its number modulo 5, a mark, and its answer."""
    answer = "CASE l_returnflag WHEN 'A' THEN CASE l_suppkey % 2 WHEN 0 THEN 'A' ELSE 'a' END WHEN 'R' THEN CASE l_suppkey % 3 WHEN 0 THEN 'B/D' WHEN 1 THEN 'B e D' ELSE 'B ou D' END ELSE CASE l_suppkey % 3 WHEN 0 THEN 'ANULADA' WHEN 1 THEN '**' ELSE 'X' END END"
    n = "CAST(l_linenumber % 5 AS BIGINT)"
    return f"CASE l_partkey % 5 WHEN 0 THEN {n} || '-' || {answer} WHEN 1 THEN '0' || {n} || ' ' || {answer} WHEN 2 THEN {n} || ') ' || {answer} WHEN 3 THEN 'QUESTÃO ' || {n} || ': ' || {answer} ELSE {n} || '. ' || {answer} END"


#: What a key of three questions gives: orders are exams, those of odd numbers have no expected total, and lines of even
#: ones stand side by side.
_PARSED_SQL = """t AS (SELECT l_orderkey AS exam_id, CAST(l_linenumber % 5 AS INT) AS number, CASE WHEN l_orderkey % 3 > 0 THEN 3 END AS expected, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B,D' ELSE '' END AS letters FROM lineitem),
    p AS (SELECT exam_id, number, outcome, CASE WHEN outcome = 'read' THEN letters END AS letters, CASE WHEN outcome = 'read' THEN CASE letters WHEN '' THEN 'anulada' WHEN 'A' THEN 'valida' ELSE 'multipla' END END AS status FROM (
        SELECT exam_id, number, min(letters) AS letters, CASE WHEN number < 1 OR number > coalesce(expected, 999) THEN 'out of range' WHEN min(letters) <> max(letters) THEN 'conflict' ELSE 'read' END AS outcome FROM t GROUP BY exam_id, number, expected))"""


def _key_exams(spark, sf_dir):
    order = F.col("l_orderkey")
    typed = F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr(_typed()).alias("line"))))
    lines = F.transform(typed, lambda x: x["line"])
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(order % 2 == 0, F.array_join(lines, "   ")).otherwise(F.array_join(lines, "\n")).alias("text"))
    return rows.select(order.alias("exam_id"), F.when(order % 3 > 0, 3).alias("expected"), "text")


def _parsed(spark, sf_dir):
    return keys.parse_keys(_key_exams(spark, sf_dir))


@_query(f"WITH {_PARSED_SQL} SELECT exam_id, number, letters, status, outcome FROM p")
def key_parse_text(spark, sf_dir):
    return _parsed(spark, sf_dir).withColumn("letters", F.array_join("letters", ","))


@_query(f"WITH {_PARSED_SQL} SELECT exam_id, number, outcome FROM p WHERE outcome <> 'read'")
def key_conflicts(spark, sf_dir):
    return _parsed(spark, sf_dir).where("outcome <> 'read'").select("exam_id", "number", "outcome")


@_query(
    f"""WITH {_PARSED_SQL}, x AS (SELECT t.exam_id, coalesce(any_value(expected), max(p.number) FILTER (outcome = 'read'), 0) AS top FROM t LEFT JOIN p ON p.exam_id = t.exam_id GROUP BY t.exam_id)
    SELECT exam_id, CAST(n AS INT) AS number FROM (SELECT exam_id, unnest(range(1, top + 1)) AS n FROM x) q
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.exam_id = q.exam_id AND p.number = q.n AND outcome = 'read')"""
)
def key_missing_numbers(spark, sf_dir):
    return keys.missing_numbers(_parsed(spark, sf_dir), _key_exams(spark, sf_dir).select("exam_id", "expected"))


_KEYED_SQL = """k AS (SELECT l_orderkey % 1000 AS exam_id, l_linenumber AS number, l_orderkey AS item, ['A', 'N'] AS options, l_returnflag AS flag, l_linestatus AS side FROM lineitem),
    q AS (SELECT exam_id, number, min(item) AS item FROM k WHERE side = 'O' GROUP BY ALL),
    a AS (SELECT exam_id, number, max(flag) AS flag FROM k WHERE side = 'F' GROUP BY ALL),
    r AS (SELECT coalesce(q.exam_id, a.exam_id) AS exam_id, coalesce(q.number, a.number) AS number, item, flag,
        CASE WHEN item IS NULL THEN 'unknown number' WHEN flag IS NULL THEN 'no answer' WHEN flag = 'R' THEN 'letter outside options' ELSE 'applied' END AS outcome
        FROM q FULL OUTER JOIN a ON q.exam_id = a.exam_id AND q.number = a.number)"""


def _applied(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("exam_id"), F.col("l_linenumber").alias("number"), F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("side"))
    items = rows.where("side = 'O'").groupBy("exam_id", "number").agg(F.min("item").alias("item")).withColumn("options", F.array(F.lit("A"), F.lit("N")))
    answers = rows.where("side = 'F'").groupBy("exam_id", "number").agg(F.max("flag").alias("flag"))
    parsed = answers.select("exam_id", "number", F.array("flag").alias("letters"), F.lit("valida").alias("status"), F.lit("read").alias("outcome"))
    return keys.apply_keys(parsed, items)


@_query(f"WITH {_KEYED_SQL} SELECT exam_id, number, item, flag AS letters, outcome FROM r")
def key_apply_reconcile(spark, sf_dir):
    return _applied(spark, sf_dir).select("exam_id", "number", "item", F.array_join("letters", ",").alias("letters"), "outcome")


@_query(
    f"""WITH {_KEYED_SQL} SELECT exam_id, count(*) FILTER (outcome = 'applied') AS applied, CAST(0 AS BIGINT) AS annulled, count(*) FILTER (outcome = 'applied') AS available,
    count(*) FILTER (outcome = 'unknown number') AS unknown, count(*) FILTER (outcome = 'letter outside options') AS outside, count(*) FILTER (outcome = 'no answer') AS unanswered FROM r GROUP BY exam_id"""
)
def key_application_report(spark, sf_dir):
    return keys.application_report(_applied(spark, sf_dir))


@_query(
    """WITH c AS (SELECT l_orderkey AS exam_id, l_linestatus AS sheet, l_linenumber AS col, CAST(l_linenumber AS VARCHAR) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linestatus, l_linenumber),
    a AS (SELECT exam_id, sheet FROM c WHERE flag = 'A' GROUP BY ALL HAVING count(*) >= 2)
    SELECT exam_id, sheet, 0 AS row, n || ' A' AS line FROM c JOIN a USING (exam_id, sheet) WHERE flag = 'A'
    UNION ALL SELECT exam_id, sheet, 0, string_agg(n, ' ' ORDER BY col) FROM c GROUP BY ALL UNION ALL SELECT exam_id, sheet, 1, string_agg(flag, ' ' ORDER BY col) FROM c GROUP BY ALL"""
)
def sheet_pairing(spark, sf_dir):
    """A sheet for each status of an order: a row of line numbers, and their flags below."""
    cell = F.explode(F.array(F.struct(F.lit(0).alias("row"), F.col("l_linenumber").cast("string").alias("value")), F.struct(F.lit(1).alias("row"), F.col("flag").alias("value")))).alias("c")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    cells = lines.select(F.col("l_orderkey").alias("exam_id"), F.col("l_linestatus").alias("sheet"), F.col("l_linenumber").alias("col"), cell)
    return keys.sheet_lines(cells.select("exam_id", "sheet", "c.row", "col", "c.value"))


# Layout


def _lines(spark, sf_dir):
    """Documents' lines as pages: a source is a document, a text a page, a line's place its y."""
    rows = files.text_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("text"), ["doc_id", "source"])
    return rows.select("source", F.col("doc_id").alias("page"), (F.col("line_no") * 12.0).alias("y0"), T.line_key(F.col("line")).alias("key")).where("key <> ''")


_LINES_SQL = rf"""ln AS (SELECT source, doc_id AS page, (i - 1) * 12.0::DOUBLE AS y0, regexp_replace({_norm('line')}, '\d+', '#', 'g') AS key
    FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY source, key ORDER BY y0, page ROWS UNBOUNDED PRECEDING) AS band FROM (
        SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY source, key ORDER BY y0, page) > 20 THEN 1 ELSE 0 END AS fresh FROM (SELECT source, key, page, min(y0) AS y0 FROM ln WHERE key <> '' GROUP BY ALL)))"""


def _bands(spark, sf_dir):
    first = _lines(spark, sf_dir).groupBy("source", "key", "page").agg(F.min("y0").alias("y0"))
    return layout.band_facts(first.groupBy("source", "key", "y0").agg(F.count("*").alias("n")), ["source", "key"])


@_query(f"WITH {_LINES_SQL} SELECT source, sha256(key) AS key_hash, CAST(band AS INT) AS band, count(*) AS n, min(y0) AS y_min, max(y0) AS y_max FROM b GROUP BY source, key, band")
def band_islands(spark, sf_dir):
    return _bands(spark, sf_dir).select("source", F.sha2("key", 256).alias("key_hash"), "band", "n", "y_min", "y_max")


@_query(f"WITH {_LINES_SQL} SELECT source, sha256(key) AS key_hash, CAST(band AS INT) AS band, count(*) AS n, round(avg(y0), 2) AS y_mean, round(stddev_pop(y0), 2) AS y_sd FROM b GROUP BY source, key, band HAVING count(*) >= 2")
def noise_recurrence(spark, sf_dir):
    return _bands(spark, sf_dir).where("n >= 2").select("source", F.sha2("key", 256).alias("key_hash"), "band", "n", "y_mean", "y_sd")


def _fragments(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("doc_id"), (F.col("l_partkey") % 40).cast("int").alias("page"), F.col("l_quantity").alias("q"), "l_linenumber", "l_tax")
    x0 = F.when(F.col("l_linenumber") % 2 == 0, 300.0).otherwise(20.0)
    return rows.select("doc_id", "page", x0.alias("x0"), (F.col("q") * 16).alias("y0"), (x0 + 200 + F.col("l_tax") * 1000).alias("x1"), (F.col("q") * 16 + 12).alias("y1"))


_FRAGMENTS_SQL = """f AS (SELECT l_suppkey % 20 AS doc_id, CAST(l_partkey % 40 AS INT) AS page, CASE WHEN l_linenumber % 2 = 0 THEN 300.0 ELSE 20.0 END AS x0, l_quantity * 16 + 6 AS y,
    CASE WHEN l_linenumber % 2 = 0 THEN 300.0 ELSE 20.0 END + 200 + l_tax * 1000 AS x1 FROM lineitem),
    v AS (SELECT doc_id, page, count(*) FILTER (y > 842 * 0.08 AND y < 842 * 0.92) AS n, count(*) FILTER (y > 842 * 0.08 AND y < 842 * 0.92 AND x0 < 297.5 - 11.9 AND x1 > 297.5 + 11.9) AS c,
    count(*) FILTER (y > 842 * 0.08 AND y < 842 * 0.92 AND x1 <= 297.5 + 11.9) AS l, count(*) FILTER (y > 842 * 0.08 AND y < 842 * 0.92 AND x0 >= 297.5 - 11.9) AS r FROM f GROUP BY ALL),
    w AS (SELECT doc_id, page, CASE WHEN n >= 25 THEN c <= n * 0.05 AND l >= n * 0.2 AND r >= n * 0.2 END AS two_columns FROM v)"""


def _votes(spark, sf_dir):
    fragments = _fragments(spark, sf_dir)
    pages = fragments.select("doc_id", "page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    return layout.layout_votes(fragments, pages)


@_query(f"WITH {_FRAGMENTS_SQL} SELECT doc_id, page, two_columns FROM w")
def layout_vote(spark, sf_dir):
    return _votes(spark, sf_dir)


@_query(f"WITH {_FRAGMENTS_SQL} SELECT doc_id, coalesce(count(*) FILTER (two_columns) > count(two_columns) / 2, false) AS two_columns FROM w GROUP BY doc_id")
def layout_majority(spark, sf_dir):
    return layout.document_layout(_votes(spark, sf_dir))


@_query("SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lineitem GROUP BY l_returnflag")
def median_upper(spark, sf_dir):
    return relational.value_at(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"median": F.floor(F.col("n") / 2)})


@_query("SELECT o_orderpriority, s[CAST(least(floor(n * 0.05), n - 1) AS BIGINT) + 1] AS p5, s[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95 FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS s, count(*) AS n FROM orders GROUP BY 1)")
def percentile_positional(spark, sf_dir):
    at = {name: F.least(F.floor(F.col("n") * share), F.col("n") - 1) for name, share in (("p5", 0.05), ("p95", 0.95))}
    return relational.value_at(_table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", at)


@_query("SELECT l_suppkey, l_linenumber AS modal, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS k FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber)) WHERE k = 1")
def modal_value(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    best = counts.groupBy("l_suppkey").agg(F.max(F.struct("n", (-F.col("l_linenumber")).alias("early"))).alias("b"))
    return best.select("l_suppkey", (-F.col("b.early")).alias("modal"), "b.n")


# Logs and constraints


@_query("SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'info' END AS level, CAST(json_extract(props, '$.k') AS INT) % 5 AS code, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error', 'click') GROUP BY ALL")
def pipeline_log_levels(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind.isin("purchase", "error"), "error").when(kind == "click", "warning").otherwise("info")
    rows = _table(spark, sf_dir, "events").select(level.alias("level"), (F.from_json("props", "k int")["k"] % 5).alias("code"))
    return rows.where(files.at_least(F.col("level"), "warning")).groupBy("level", "code").agg(F.count("*").alias("n"))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stage_counts(spark, sf_dir):
    return ingest.stage_counts(_table(spark, sf_dir, "events"))


@_query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 1")
def constraint_unique_violations(spark, sf_dir):
    return upsert.unique_violations(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], F.col("l_returnflag") == "R")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def constraint_fk_orphans(spark, sf_dir):
    rich = _table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return upsert.orphans(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rich, "o_custkey", "c_custkey")


@_query("SELECT l_orderkey, l_linenumber, c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey")
def constraint_same_parent(spark, sf_dir):
    lines, orders, customer, supplier = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return upsert.same_parent_violations(met, F.col("c_nationkey"), F.col("s_nationkey")).select("l_orderkey", "l_linenumber", "c_nationkey", "s_nationkey")


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR l.doc_id IS NULL THEN lang ELSE 'labelled' END AS value, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS INT) AS seq FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_last_writer(spark, sf_dir):
    existing = _table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("value"), F.lit(1).alias("seq"))
    incoming = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(0).alias("seq"))
    return upsert.last_writer(existing, incoming, ["doc_id"], "seq")


@_query(
    """WITH e AS (SELECT doc_id AS item, CAST(quality AS BIGINT) AS topic, 0.9 AS score, CASE WHEN toxic = 1 THEN 'manual' ELSE 'ml' END AS origin, toxic AS principal FROM labels),
    i AS (SELECT doc_id AS item, t AS topic, (doc_id % 7 + t) / 10.0 AS score FROM documents, (VALUES (0), (1), (2)) x(t) WHERE lang <> 'en'),
    k AS (SELECT * FROM e WHERE item NOT IN (SELECT item FROM i) OR origin <> 'ml'),
    u AS (SELECT * FROM k UNION ALL SELECT item, topic, score, 'ml', 0 FROM i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.item = i.item AND k.topic = i.topic))
    SELECT item, CAST(topic AS BIGINT) AS topic, CAST(score AS DOUBLE) AS score, origin, CAST(CASE WHEN item NOT IN (SELECT item FROM i) OR item IN (SELECT item FROM k WHERE origin = 'manual' AND principal = 1) THEN principal
        ELSE topic = 2 END AS INT) AS principal FROM u"""
)
def replace_by_origin_keep_manual(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    existing = labels.select(F.col("doc_id").alias("item"), F.col("quality").cast("long").alias("topic"), F.lit(0.9).alias("score"), F.when(F.col("toxic") == 1, "manual").otherwise("ml").alias("origin"), F.col("toxic").alias("principal"))
    incoming = _table(spark, sf_dir, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("topic"))
    incoming = incoming.withColumn("score", (F.col("item") % 7 + F.col("topic")) / 10)
    return upsert.replace_by_origin(existing, incoming, "ml")


@_query("SELECT o_custkey, coalesce(max(o_orderkey % 10), -1) + 1 AS next FROM orders GROUP BY o_custkey")
def next_ordinal(spark, sf_dir):
    return upsert.next_ordinal(_table(spark, sf_dir, "orders").withColumn("ordinal", F.col("o_orderkey") % 10), "o_custkey", "ordinal")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return upsert.cascade_delete(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey", "o_orderkey")


@_query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def restricted_delete(spark, sf_dir):
    gone = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return upsert.restricted(gone, _table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@_query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def patch_rows(spark, sf_dir):
    changes = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return upsert.patch(_table(spark, sf_dir, "documents").select("doc_id", "lang"), changes, ["doc_id"], ["lang"])


@_query("SELECT doc_id AS item, coalesce(l.quality, -1) AS quality FROM documents LEFT JOIN labels l USING (doc_id)")
def insert_absent(spark, sf_dir):
    existing = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), "quality")
    return upsert.insert_absent(existing, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.lit(-1).alias("quality")), ["item"])
