"""Queries over a question bank made of the driver's tables: documents are questions, turns of
conversations their options, nations exams, regions and nations topics, labels links."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemforge.operators import admission, bank, keys, known_hashes, models, search_index, selection
from itemforge.plans import assembly, catalogue, classification
from itemforge.plans.catalogue import _norm, _query, _table
from itemforge.sources import shared

_AT = "2024-06-01"
_BANK_SQL = f"""ex AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, CASE WHEN n_regionkey = 0 THEN 'erro' ELSE 'processado' END AS status, TIMESTAMP '2024-01-01' + n_nationkey * INTERVAL 1 DAY AS created_at FROM nation),
    tp AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS name, {_norm('r_name')} AS folded FROM region
        UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name, {_norm('n_name')} FROM nation),
    qs AS (SELECT doc_id AS id, doc_id % 25 AS exam, CAST(doc_id // 25 AS INT) AS number, lang AS support, text AS statement, source AS command, (n_chars % 100) / 100.0::DOUBLE AS confidence, lang = 'fr' AS reviewed, lang <> 'de' AS active FROM documents),
    op AS (SELECT conv_id * 1000 + turn AS id, conv_id AS question, chr(CAST(65 + turn AS INT)) AS letter, text, CAST(turn AS INT) AS ordinal, role FROM conversations),
    ky AS (SELECT doc_id AS id, doc_id AS question, CASE WHEN toxic IS NULL THEN 'ausente' WHEN toxic = 0 THEN 'valida' ELSE 'multipla' END AS status,
        CASE WHEN toxic IS NULL THEN NULL WHEN quality = 1 THEN 'manual' ELSE 'inferido_ml' END AS source FROM documents LEFT JOIN labels USING (doc_id)),
    kl AS (SELECT question, id AS option FROM op WHERE role = 'assistant'),
    lk AS (SELECT doc_id AS question, CAST(100 + doc_id % 25 AS BIGINT) AS topic, 0.9 AS score, CASE WHEN toxic = 1 THEN 'manual' ELSE 'ml' END AS origin, toxic = 0 AS principal FROM labels)"""
_LISTED = "(SELECT question, list(text ORDER BY ordinal, letter, text) AS texts FROM {0} GROUP BY question)"


def _hash_sql(parts: str) -> str:
    return f"sha256(array_to_string([{_norm('x')} FOR x IN {parts} IF x IS NOT NULL AND x <> ''], chr(10)))"


def _content_sql(questions: str, options: str, statement: str = "statement") -> str:
    parts = f"list_concat([support, {statement}, command], coalesce(texts, []))"
    return f"SELECT id, {_hash_sql(parts)} AS content_hash FROM {questions} LEFT JOIN {_LISTED.format(options)} ON question = id"


def _bank(spark, sf_dir) -> bank.Bank:
    t = {n: _table(spark, sf_dir, n) for n in ("nation", "region", "documents", "conversations", "labels", "pages")}
    c, null = F.col, lambda kind: F.lit(None).cast(kind)
    topic = lambda i, p, n: [i.cast("long").alias("id"), n.alias("name"), catalogue.T.slug(n).alias("slug"), p.cast("long").alias("parent"), F.lit(True).alias("active")]
    marked = t["documents"].select("doc_id").join(t["labels"], "doc_id", "left")
    options = t["conversations"].select(
        (c("conv_id") * 1000 + c("turn")).alias("id"), c("conv_id").alias("question"), catalogue.T.letter(c("turn")).alias("letter"), "text", c("turn").cast("int").alias("ordinal"), "role"
    )
    status = F.when(c("toxic").isNull(), "ausente").when(c("toxic") == 0, "valida").otherwise("multipla")
    source = F.when(c("toxic").isNull(), None).when(c("quality") == 1, "manual").otherwise("inferido_ml")
    return {
        "exams": t["nation"].select(
            c("n_nationkey").cast("long").alias("id"), c("n_name").alias("uuid"), null("string").alias("institution"), c("n_name").alias("title"), null("int").alias("year"), F.sha2("n_name", 256).alias("file_hash"),
            F.when(c("n_regionkey") == 0, "erro").otherwise("processado").alias("status"), null("string").alias("key_path"), F.timestamp_add("DAY", c("n_nationkey"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        ),
        "topics": t["region"].select(*topic(c("r_regionkey"), null("long"), c("r_name"))).unionByName(t["nation"].select(*topic(c("n_nationkey") + 100, c("n_regionkey"), c("n_name")))),
        "questions": t["documents"].select(
            c("doc_id").alias("id"), c("doc_id").cast("string").alias("uuid"), (c("doc_id") % 25).alias("exam"), (c("doc_id") / 25).cast("int").alias("number"), c("lang").alias("support"), c("text").alias("statement"), c("source").alias("command"),
            catalogue.T.content_hash(c("lang"), c("text"), c("source")).alias("content_hash"), (c("n_chars") % 100 / 100).alias("confidence"), null("string").alias("remarks"), (c("lang") == "fr").alias("reviewed"), (c("lang") != "de").alias("active"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
        ),
        "options": options.drop("role"),
        "keys": marked.select(c("doc_id").alias("id"), c("doc_id").alias("question"), status.alias("status"), source.alias("source"), null("double").alias("confidence")),
        "key_letters": options.where("role = 'assistant'").select("question", c("id").alias("option")),
        "links": t["labels"].select(c("doc_id").alias("question"), (c("doc_id") % 25 + 100).alias("topic"), F.lit(0.9).alias("score"), F.when(c("toxic") == 1, "manual").otherwise("ml").alias("origin"), (c("toxic") == 0).alias("principal")),
        "media": t["pages"].select(c("page_id").alias("id"), c("page_id").alias("question"), c("url").alias("path")),
    }


def _at():
    return F.lit(_AT).cast("timestamp")


_MODEL_SQL = f"""{_BANK_SQL}, md AS (SELECT q.*, ex.title, tp.name AS topic, ky.status, ky.source, letters, coalesce(o.n, 0) AS options, coalesce(m.n, 0) AS media FROM qs q
    LEFT JOIN ex ON q.exam = ex.id LEFT JOIN lk ON lk.question = q.id AND principal LEFT JOIN tp ON tp.id = lk.topic LEFT JOIN ky ON ky.question = q.id
    LEFT JOIN (SELECT kl.question, string_agg(letter, ',' ORDER BY letter) AS letters FROM kl JOIN op ON op.id = option GROUP BY 1) l ON l.question = q.id
    LEFT JOIN (SELECT question, count(*) AS n FROM op GROUP BY 1) o ON o.question = q.id LEFT JOIN (SELECT page_id AS question, count(*) AS n FROM pages GROUP BY 1) m ON m.question = q.id)"""
_WORDS_SQL = r"' ' || trim(regexp_replace(lower(strip_accents(concat_ws(' ', support, statement, command))), '[^\p{L}\p{N}]+', ' ', 'g'))"
_FOUND_SQL = f"contains({_WORDS_SQL}, ' the') AND contains({_WORDS_SQL}, ' en')"


@_query(f"WITH {_MODEL_SQL} SELECT id, exam, number, title, topic, status, source, letters, options, media FROM md")
def bank_read_model(spark, sf_dir):
    return bank.read_model(_bank(spark, sf_dir)).select("id", "exam", "number", "title", "topic", "status", "source", "letters", "options", "media")


@_query(f"WITH {_MODEL_SQL} SELECT id, topic FROM md WHERE {_FOUND_SQL} AND id IN (SELECT question FROM lk WHERE topic = 1 OR topic IN (SELECT id FROM tp WHERE parent = 1)) ORDER BY id LIMIT 20 OFFSET 20")
def library_search(spark, sf_dir):
    b = _bank(spark, sf_dir)
    return bank.search(bank.read_model(b), b, page=1, size=20, text="The en", topic=1).select("id", "topic")


@_query(f"WITH {_MODEL_SQL} SELECT count(*) AS n FROM md WHERE active AND status IN ('valida', 'multipla') AND options >= 2 AND source <> 'inferido_ml' AND exam = 3")
def library_search_count(spark, sf_dir):
    b = _bank(spark, sf_dir)
    return bank.search_count(bank.read_model(b), b, exam=3, eligible_only=True)


@_query(f"WITH {_MODEL_SQL} SELECT id, title FROM md WHERE {_FOUND_SQL} AND id NOT IN (SELECT question FROM lk)")
def library_search_untagged(spark, sf_dir):
    b = _bank(spark, sf_dir)
    return bank.matching(bank.read_model(b), b, text="The en", untagged=True).select("id", "title")


@_query(f"WITH {_MODEL_SQL} SELECT id FROM md WHERE active AND status = 'ausente' AND options >= 2")
def pending_inference(spark, sf_dir):
    return bank.pending_inference(bank.read_model(_bank(spark, sf_dir))).select("id")


@_query(f"WITH {_BANK_SQL} SELECT id, title, created_at FROM ex WHERE status = 'processado'")
def exam_list(spark, sf_dir):
    return bank.exam_list(_bank(spark, sf_dir)["exams"], "processado").select("id", "title", "created_at")


@_query(f"WITH {_BANK_SQL} SELECT min(id) AS id, {_hash_sql('[support, statement, command]')} AS content_hash FROM qs GROUP BY content_hash HAVING count(*) > 1")
def lookup_by_hash(spark, sf_dir):
    questions = _bank(spark, sf_dir)["questions"]
    twice = questions.groupBy(F.col("content_hash").alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    return bank.lookup(questions, "content_hash", twice).select("id", "content_hash")


@_query(f"WITH {_BANK_SQL} SELECT 'named' AS found, id, name FROM tp WHERE name = 'ASIA' OR folded = 'asia' UNION ALL SELECT 'child', id, name FROM tp WHERE parent = 2")
def topic_lookup(spark, sf_dir):
    topics = _bank(spark, sf_dir)["topics"]
    named, below = bank.topic_named(topics, "asia"), bank.children(topics, 2)
    return named.select(F.lit("named").alias("found"), "id", "name").unionByName(below.select(F.lit("child").alias("found"), "id", "name"))


@_query(f"WITH {_BANK_SQL}, r AS (SELECT topic, question FROM lk UNION SELECT parent, question FROM lk JOIN tp ON lk.topic = tp.id WHERE parent IS NOT NULL) SELECT topic AS id, count(DISTINCT question) AS total FROM r GROUP BY topic")
def topics_with_questions(spark, sf_dir):
    b = _bank(spark, sf_dir)
    links = b["links"].select(F.col("question").alias("item"), "topic")
    return bank.topics_with(catalogue.relational.topic_counts(b["topics"], links, links.select("item"))).select("id", "total")


@_query(f"WITH {_BANK_SQL}, e AS (SELECT id, support, CASE WHEN quality = 1 THEN 'Corrected  statement' ELSE statement END AS statement, command FROM qs LEFT JOIN labels ON doc_id = id) {_content_sql('e', 'op')}")
def text_edit(spark, sf_dir):
    b = _bank(spark, sf_dir)
    changed = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("support"), F.when(F.col("quality") == 1, "Corrected  statement").alias("statement"), F.lit(None).cast("string").alias("command"))
    every = b["questions"].select("id").join(changed, "id", "left")
    return bank.edit_texts(b, every, _at())["questions"].select("id", "content_hash")


_CORRECTED_SQL = """cr AS (SELECT question, letter, CASE WHEN role = 'user' THEN 'new ' || letter ELSE text END AS text, ordinal FROM op
    UNION ALL SELECT question, 'Y', 'one more', max(ordinal) + 1 FROM op GROUP BY question UNION ALL SELECT question, 'Z', 'and another', max(ordinal) + 2 FROM op GROUP BY question)"""


def _corrected(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    letter = catalogue.T.letter(F.col("turn"))
    old = rows.where("role = 'user'").select(F.col("conv_id").alias("question"), F.concat(F.lit(" "), F.lower(letter)).alias("letter"), F.concat(F.lit("new "), letter).alias("text"))
    new = rows.select(F.col("conv_id").alias("question")).distinct().select("question", F.explode(F.array(*[F.struct(F.lit(a).alias("letter"), F.lit(b).alias("text")) for a, b in (("Z", "and another"), ("Y", "one more"))])).alias("o"))
    blank = rows.select(F.col("conv_id").alias("question"), F.lit(" ").alias("letter"), F.lit("no option").alias("text"))
    lost = rows.select((-1 - F.col("conv_id")).alias("question"), F.lit("A").alias("letter"), F.lit("of no question").alias("text"))
    return bank.correct_options(_bank(spark, sf_dir), old.unionByName(new.select("question", "o.letter", "o.text")).unionByName(blank).unionByName(lost), _at())


@_query(f"WITH {_BANK_SQL}, {_CORRECTED_SQL} SELECT question, letter, text, CAST(ordinal AS INT) AS ordinal FROM cr")
def option_correction(spark, sf_dir):
    return _corrected(spark, sf_dir)["options"].select("question", "letter", "text", "ordinal")


@_query(f"WITH {_BANK_SQL}, {_CORRECTED_SQL} {_content_sql('(SELECT * FROM qs WHERE id IN (SELECT question FROM op))', 'cr')}")
def option_correction_hash(spark, sf_dir):
    return _corrected(spark, sf_dir)["questions"].where(F.col("updated_at") == _at()).select("id", "content_hash")


_LEFT_SQL = "lo AS (SELECT * FROM op WHERE role <> 'system')"


@_query(f"WITH {_BANK_SQL}, {_LEFT_SQL} {_content_sql('(SELECT * FROM qs WHERE id IN (SELECT question FROM op WHERE role = $$system$$))', 'lo')}")
def option_removal(spark, sf_dir):
    gone = _table(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").alias("question"), catalogue.T.letter(F.col("turn")).alias("letter"))
    return bank.remove_options(_bank(spark, sf_dir), gone, _at())["questions"].where(F.col("updated_at") == _at()).select("id", "content_hash")


_ANSWERS_SQL = "an AS (SELECT question, CASE WHEN count(*) > 6 THEN list_append(list(letter ORDER BY letter) FILTER (role = 'assistant'), 'Q') ELSE coalesce(list(letter ORDER BY letter) FILTER (role = 'assistant'), []) END AS letters FROM op GROUP BY question)"


def _answers(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("question")).agg(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", catalogue.T.letter(F.col("turn"))))).alias("l"), F.count("*").alias("n"))
    letters = F.when(F.col("n") > 6, F.concat("l", F.array(F.lit("Q")))).otherwise(F.col("l"))
    return bank.define_keys(_bank(spark, sf_dir), rows.select("question", letters.alias("letters"), F.lit(1.0).alias("confidence")), "manual")


@_query(
    f"""WITH {_BANK_SQL}, {_ANSWERS_SQL} SELECT ky.question, CASE WHEN good IS NULL THEN status WHEN good = 0 THEN 'anulada' WHEN good = 1 THEN 'valida' ELSE 'multipla' END AS status, CASE WHEN good IS NULL THEN source ELSE 'manual' END AS source
    FROM ky LEFT JOIN (SELECT question, len(letters) AS good FROM an WHERE NOT list_contains(letters, 'Q')) g ON g.question = ky.question"""
)
def key_write(spark, sf_dir):
    return _answers(spark, sf_dir)[0]["keys"].select("question", "status", "source")


@_query(f"WITH {_BANK_SQL}, {_ANSWERS_SQL} SELECT question, 'Q' AS letter FROM an WHERE list_contains(letters, 'Q')")
def key_write_refused(spark, sf_dir):
    return _answers(spark, sf_dir)[1]


@_query(f"WITH {_BANK_SQL}, {_ANSWERS_SQL} SELECT kl.question, letter FROM kl JOIN op ON op.id = option")
def key_letters_replaced(spark, sf_dir):
    b, _ = _answers(spark, sf_dir)
    return b["key_letters"].join(b["options"].select(F.col("id").alias("option"), "letter"), "option").select("question", "letter")


@_query(
    f"""WITH {_BANK_SQL}, ch AS (SELECT DISTINCT conv_id AS question, CAST(103 AS BIGINT) AS topic FROM conversations)
    SELECT question, topic, score, origin, CASE WHEN question IN (SELECT question FROM ch) THEN false ELSE principal END AS principal FROM lk WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.question = lk.question AND ch.topic = lk.topic)
    UNION ALL SELECT question, topic, 1.0, 'manual', true FROM ch"""
)
def manual_topic(spark, sf_dir):
    chosen = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), F.lit(103).cast("long").alias("topic"))
    return bank.set_topics(_bank(spark, sf_dir)["links"], chosen)


@_query(f"WITH {_BANK_SQL} SELECT id, reviewed OR toxic IS NOT NULL AS reviewed, CASE WHEN toxic IS NOT NULL THEN TIMESTAMP '{_AT}' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM qs LEFT JOIN labels ON doc_id = id")
def flag_update(spark, sf_dir):
    ids = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return bank.set_flags(_bank(spark, sf_dir)["questions"], ids, _at(), reviewed=True).select("id", "reviewed", "updated_at")


@_query(
    f"""WITH {_BANK_SQL}, g AS (SELECT id FROM ex WHERE status = 'erro'), l AS (SELECT id FROM qs WHERE exam IN (SELECT id FROM g))
    SELECT 'questions' AS rows, count(*) AS n FROM qs WHERE exam NOT IN (SELECT id FROM g) UNION ALL SELECT 'options', count(*) FROM op WHERE question NOT IN (SELECT id FROM l)
    UNION ALL SELECT 'links', count(*) FROM lk WHERE question NOT IN (SELECT id FROM l) UNION ALL SELECT 'exams', count(*) FROM ex WHERE id NOT IN (SELECT id FROM g)"""
)
def exam_deletion(spark, sf_dir):
    b = _bank(spark, sf_dir)
    left = bank.delete_exams(b, b["exams"].where("status = 'erro'").select("id"))
    parts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("rows"), "n") for t in ("questions", "options", "links", "exams")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query(f"WITH {_BANK_SQL} SELECT id, CASE WHEN parent <> 2 THEN parent END AS parent FROM tp WHERE id <> 2")
def topic_deletion(spark, sf_dir):
    b = _bank(spark, sf_dir)
    return bank.delete_topics(b, b["topics"].where("id = 2").select("id"))["topics"].select("id", "parent")


@_query(
    f"""WITH {_BANK_SQL} SELECT * FROM (SELECT 'options' AS "table", 'reference question' AS rule, count(*) AS n FROM op WHERE question NOT IN (SELECT id FROM qs)
    UNION ALL SELECT 'media', 'reference question', count(*) FROM pages WHERE page_id NOT IN (SELECT id FROM qs)
    UNION ALL SELECT 'key_letters', 'option of the question', count(*) FROM kl JOIN op ON op.id = option WHERE kl.question <> op.question
    UNION ALL SELECT 'keys', 'unique question', count(*) FROM (SELECT question FROM ky GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'links', 'reference topic', count(*) FROM lk WHERE topic NOT IN (SELECT id FROM tp WHERE parent IS NULL OR parent <> 3)) WHERE n > 0"""
)
def bank_constraints(spark, sf_dir):
    b = _bank(spark, sf_dir)
    return bank.constraint_violations(b | {"topics": b["topics"].where("parent IS NULL OR parent <> 3")})


@_query(
    f"""WITH {catalogue._SHUFFLE_SQL}, o2 AS (SELECT DISTINCT l_orderkey, chr(CAST(64 + l_linenumber AS INT)) AS letter FROM lineitem WHERE l_linestatus = 'O' UNION SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
    SELECT s.l_orderkey AS item, printed, original, 'text ' || original AS text FROM s JOIN o2 ON o2.l_orderkey = s.l_orderkey AND o2.letter = original
    UNION ALL SELECT l_orderkey, chr(CAST(65 + count(*) AS INT)), 'X', 'text X' FROM s GROUP BY l_orderkey"""
)
def reapply_map(spark, sf_dir):
    maps = selection.letter_map(catalogue.option_shuffle_map(spark, sf_dir), ["l_orderkey"]).withColumnRenamed("l_orderkey", "item")
    lines = _table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("item"), catalogue.T.letter(F.col("l_linenumber") - 1).alias("letter")).distinct()
    late = maps.select("item", F.lit("X").alias("letter"))
    options = lines.unionByName(late).withColumn("text", F.concat(F.lit("text "), F.col("letter")))
    return selection.apply_map(maps, options, ["item"])


@_query(f"WITH {_BANK_SQL} SELECT lk.question AS item, coalesce(CASE topic WHEN 105 THEN 0 WHEN 101 THEN 1 END, 2) AS place FROM lk")
def final_order(spark, sf_dir):
    links = _bank(spark, sf_dir)["links"].select(F.col("question").alias("item"), "topic")
    return selection.final_order(links.select("item"), links, [105, 101]).select("item", "place")


@_query(
    f"""WITH {_BANK_SQL}, j AS (SELECT id, array_to_string([x FOR x IN [support, statement, command, array_to_string(texts, chr(10))] IF x IS NOT NULL AND x <> ''], chr(10)) AS t FROM qs LEFT JOIN {_LISTED.format('op')} ON question = id WHERE active)
    SELECT id AS doc_id, sha256(substring(t, 1, 1500)) AS shown FROM j"""
)
def classifier_text(spark, sf_dir):
    return classification.question_text(_bank(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("shown"))


@_query(
    """WITH v AS (SELECT user_id AS item, CAST(event_id AS INT) AS round, CASE event_type WHEN 'view' THEN NULL ELSE chr(CAST(65 + CAST(json_extract(props, '$.k') AS INT) % 3 AS INT)) END AS letter FROM events),
    c AS (SELECT item, letter, count(*) AS n, min(round) AS first FROM v GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY item) AS total, row_number() OVER (PARTITION BY item ORDER BY letter IS NULL, n DESC, first) AS k FROM c)
    SELECT item, letter, CASE WHEN letter IS NOT NULL THEN round(n / total, 3) END AS share, CASE WHEN letter IS NOT NULL AND round(n / total, 3) >= 0.4 THEN 'suggested' ELSE 'discarded' END AS outcome FROM r WHERE k = 1"""
)
def answer_votes(spark, sf_dir):
    letter = catalogue.T.letter(F.from_json("props", "k int")["k"] % 3)
    raw = F.when(F.col("event_type") == "view", "no idea").otherwise(F.concat(F.lit("I say ("), letter, F.lit(").")))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").cast("int").alias("round"), raw.alias("raw"))
    return models.answer_votes(rows, 0.4)


@_query(
    f"""WITH {_BANK_SQL} SELECT q.id, coalesce(support, '') || chr(10) || statement || chr(10) || string_agg(letter || ') ' || o.text, chr(10) ORDER BY letter) || chr(10) || 'Answer with one letter.' AS prompt
    FROM qs q JOIN op o ON o.question = q.id WHERE statement <> '' GROUP BY q.id, support, statement"""
)
def answer_prompts(spark, sf_dir):
    b = _bank(spark, sf_dir)
    options = b["options"].groupBy(F.col("question").alias("id")).agg(F.array_sort(F.collect_list(F.struct("letter", "text"))).alias("options"))
    rows = b["questions"].where("statement <> ''").join(options, "id")
    return rows.select("id", models.answer_prompt(F.concat_ws("\n", F.coalesce("support", F.lit("")), "statement"), F.col("options")).alias("prompt"))


@_query(
    f"""WITH {catalogue._PARSED_SQL} SELECT exam_id, count(*) FILTER (outcome = 'read') AS "read", count(*) FILTER (status = 'anulada') AS annulled, count(*) FILTER (outcome = 'conflict') AS conflicts,
    count(*) FILTER (outcome = 'out of range') AS outside FROM p GROUP BY exam_id"""
)
def key_report_counts(spark, sf_dir):
    return keys.report_counts(catalogue._parsed(spark, sf_dir))


@_query(
    f"""WITH h AS (SELECT doc_id, coalesce(text, '') = '' AS blank, sha256({_norm('text')}) AS hash FROM documents), n AS (SELECT sha256({_norm('text')}) AS hash FROM benchmark),
    o AS (SELECT doc_id, CASE WHEN blank THEN 'rejected' WHEN hash IN (SELECT hash FROM n) OR doc_id > min(doc_id) OVER (PARTITION BY hash) THEN 'duplicate' ELSE 'recorded' END AS outcome FROM h)
    SELECT doc_id, outcome FROM o"""
)
def import_outcomes(spark, sf_dir):
    none = F.array().cast("array<struct<letter:string,text:string>>")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("number"), F.coalesce("text", F.lit("")).alias("statement"), none.alias("options"))
    known = _table(spark, sf_dir, "benchmark").select(catalogue.T.content_hash(F.col("text")).alias("hash"))
    return assembly.record(rows, known).select("doc_id", "outcome")


_BATCH_SQL = f"""r AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, [CASE WHEN text <> '' THEN 't' || {_norm('text')} END, 'u' || substr(sha256(CAST(n_chars // 5 AS VARCHAR)), 1, 8), CASE WHEN quality IS NOT NULL THEN 'e' || (doc_id % 7) || ' ' || (n_chars % 97) END] AS keys,
        CASE WHEN quality = 0 AND toxic = 1 THEN 'check confidence' WHEN lang = 'es' AND source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND doc_id % 2 = 0) THEN 'reference source' END AS fault FROM documents LEFT JOIN labels USING (doc_id)),
    s(k, doc_id, broken, taken, holders) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])
        UNION ALL SELECT r.k, r.doc_id, coalesce(fault, ['unique text', 'unique uuid', 'unique exam, number'][x]), CASE WHEN fault IS NULL AND x IS NULL THEN list_concat(taken, [y FOR y IN keys IF y IS NOT NULL]) ELSE taken END,
            CASE WHEN fault IS NULL AND x IS NULL THEN list_concat(holders, [r.doc_id FOR y IN keys IF y IS NOT NULL]) ELSE CASE WHEN fault IS NULL THEN list_concat(holders, []) ELSE holders END END
        FROM (SELECT s.taken, s.holders, r.*, CASE WHEN list_contains(taken, keys[1]) THEN 1 WHEN list_contains(taken, keys[2]) THEN 2 WHEN list_contains(taken, keys[3]) THEN 3 END AS x FROM s JOIN r ON r.k = s.k + 1) r)"""


@_query(f"WITH RECURSIVE {_BATCH_SQL} SELECT s.doc_id, s.broken, CASE WHEN s.broken LIKE 'unique%' THEN a.holder END AS blocker FROM s JOIN r ON r.doc_id = s.doc_id LEFT JOIN LATERAL (SELECT CASE s.broken WHEN 'unique text' THEN s.holders[list_position(s.taken, r.keys[1])] WHEN 'unique uuid' THEN s.holders[list_position(s.taken, r.keys[2])] ELSE s.holders[list_position(s.taken, r.keys[3])] END AS holder) a ON true WHERE s.k > 0")
def import_verdicts(spark, sf_dir):
    """Documents as a batch of questions, in order of id, with texts, uuids and numbers of exams that many
    of them share: which are taken, and which rule and which row refuses each other."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    uuid = F.substring(F.sha2(F.floor(F.col("n_chars") / 5).cast("string"), 256), 1, 8)
    rows = docs.select("doc_id", "text", "lang", "source", "quality", "toxic", catalogue.T.normalize(F.col("text")).alias("norm"), uuid.alias("uuid"), (F.col("doc_id") % 7).alias("exam"), F.when(F.col("quality").isNotNull(), F.col("n_chars") % 97).alias("number"))
    rows = rows.withColumn("spanish", F.when(F.col("lang") == "es", F.col("source")))
    known = rows.where("lang = 'en' AND doc_id % 2 = 0").select("source").distinct()
    rules = admission.Rules({"confidence": "NOT (quality = 0 AND toxic = 1)"}, [("spanish", known, "source")], {"text": (["norm"], "text <> ''"), "uuid": (["uuid"], None), "exam, number": (["exam", "number"], "number IS NOT NULL")})
    found = admission.admit(rows, ["doc_id"], rules, name="doc_id")
    return found.select("doc_id", F.when(F.col("broken") == "reference spanish", "reference source").otherwise(F.col("broken")).alias("broken"), "blocker")


_MANY_SQL = f"""{catalogue._TOPICS_SQL}, q AS (SELECT s_suppkey AS exam, topic, wanted, place FROM (SELECT s_suppkey, unnest([CAST(s_nationkey + 100 AS BIGINT), CAST(s_nationkey % 5 AS BIGINT), CAST((s_nationkey + 7) % 25 + 100 AS BIGINT)]) AS topic, unnest([3, 5, 40]) AS wanted, unnest([0, 1, 2]) AS place FROM supplier)),
    n AS (SELECT topic, count(DISTINCT item) AS n FROM reach GROUP BY topic),
    a AS (SELECT exam, q.topic, wanted, row_number() OVER (PARTITION BY exam ORDER BY coalesce(n, 0), place) AS turn FROM q LEFT JOIN n ON n.topic = q.topic),
    w(exam, turn, topic, wanted, taken, got) AS (SELECT DISTINCT exam, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM a
        UNION ALL SELECT exam, turn, topic, wanted, taken, coalesce(list(item ORDER BY key, item) FILTER (item IS NOT NULL AND NOT list_contains(taken, item)), [])[1:wanted] FROM (
            SELECT a.exam, a.turn, a.topic, a.wanted, list_concat(w.taken, w.got) AS taken, r.item, sha256(a.exam || ':' || r.item) AS key FROM w JOIN a ON a.exam = w.exam AND a.turn = w.turn + 1 LEFT JOIN (SELECT DISTINCT topic, item FROM reach) r ON r.topic = a.topic) GROUP BY exam, turn, topic, wanted, taken)"""


def _many(spark, sf_dir):
    nation = F.col("s_nationkey").cast("long")
    each = F.explode(F.array(*[F.struct(t.alias("topic"), F.lit(n).alias("wanted"), F.lit(k).alias("place")) for k, (t, n) in enumerate(((nation + 100, 3), (nation % 5, 5), ((nation + 7) % 25 + 100, 40)))])).alias("q")
    quotas = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("exam"), F.col("s_suppkey").alias("seed"), each).select("exam", "seed", "q.topic", "q.wanted", "q.place")
    return catalogue._reach(spark, sf_dir), quotas


@_query(f"WITH RECURSIVE {_MANY_SQL} SELECT exam, topic, item, CAST(rank AS INT) AS rank FROM (SELECT exam, topic, unnest(got) AS item, generate_subscripts(got, 1) AS rank FROM w WHERE turn > 0)")
def many_exams(spark, sf_dir):
    """An exam for each supplier, drawn from three topics that share items, all in one go."""
    return selection.draw_many(*_many(spark, sf_dir))[0]


@_query(f"WITH RECURSIVE {_MANY_SQL} SELECT exam, topic, wanted, CAST(len(got) AS INT) AS got FROM w WHERE turn > 0 AND len(got) < wanted")
def many_exams_shortfall(spark, sf_dir):
    return selection.shortfall(*_many(spark, sf_dir))


@_query(catalogue.ORACLE_SQL["search_prefix_all_terms"])
def indexed_search(spark, sf_dir):
    """search_prefix_all_terms by an index of words that grew by two appends."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    path = shared.folder(spark, "index")
    search_index.append(docs.join(labelled, "id", "left_semi"), path)
    search_index.append(search_index.absent(docs, spark, path), path)
    return search_index.find(search_index.open_index(spark, path), docs, '"The" on Eá').select(F.col("id").alias("doc_id"))


@_query(f"WITH k AS (SELECT sha256({_norm('text')}) AS hash FROM documents JOIN labels USING (doc_id)) SELECT doc_id FROM (SELECT doc_id, sha256({_norm('text')}) AS hash FROM documents) WHERE hash NOT IN (SELECT hash FROM k)")
def unknown_by_filter(spark, sf_dir):
    """Documents whose text no labelled document has, told by a filter of these and a join for its hits."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", catalogue.T.content_hash(F.col("text")).alias("hash"))
    known = rows.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("hash")
    return known_hashes.unknown(rows, shared.saved(known_hashes.build(known), "filter"), known).select("doc_id")


@_query(f"WITH {_BANK_SQL} SELECT question, topic, score::DOUBLE AS score, origin, principal FROM lk WHERE question NOT IN (SELECT conv_id FROM conversations)")
def topic_link_removal(spark, sf_dir):
    links = _bank(spark, sf_dir)["links"]
    gone = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question")).distinct().join(links.select("question", "topic"), "question")
    return bank.remove_topics(links, gone)


@_query(
    f"""WITH {_BANK_SQL}, ch AS (SELECT DISTINCT conv_id AS question, CAST(103 AS BIGINT) AS topic FROM conversations)
    SELECT question, topic, score::DOUBLE AS score, origin, principal FROM lk WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.question = lk.question AND ch.topic = lk.topic)
    UNION ALL SELECT ch.question, ch.topic, 1.0::DOUBLE, 'manual', coalesce(principal, false) FROM ch LEFT JOIN lk ON lk.question = ch.question AND lk.topic = ch.topic"""
)
def manual_topic_beside(spark, sf_dir):
    """A topic set by hand that does not become the principal one."""
    chosen = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), F.lit(103).cast("long").alias("topic"), F.lit(False).alias("principal"))
    return bank.set_topics(_bank(spark, sf_dir)["links"], chosen)
