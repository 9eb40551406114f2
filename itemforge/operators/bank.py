"""The question bank: its tables, its read model, searches over it, and the writes that correct it.

A bank is a dict of DataFrames by table name, with the columns of TABLES. Writes are snapshots: they take
tables and give back the tables that take their place. Ids are longs that the caller numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import admission, keys, relational, upsert

Bank = dict[str, DataFrame]

TABLES = {
    "exams": "id long, uuid string, institution string, title string, year int, file_hash string, status string, key_path string, created_at timestamp",
    "topics": "id long, name string, slug string, parent long, active boolean",
    "questions": "id long, uuid string, exam long, number int, support string, statement string, command string, content_hash string, confidence double, remarks string, reviewed boolean, active boolean, updated_at timestamp",
    "options": "id long, question long, letter string, text string, ordinal int",
    "keys": "id long, question long, status string, source string, confidence double",
    "key_letters": "question long, option long",
    "links": "question long, topic long, score double, origin string, principal boolean",
    "media": "id long, question long, path string",
}
#: What the tables allow. A condition must hold in each row, null counts as allowed.
STATUSES, SOURCES, EXAM_STATUSES = ("valida", "multipla", "anulada", "ausente"), ("pdf", "manual", "inferido_ml"), ("pendente", "processando", "processado", "erro", "revisado")
CHECKS = {
    "exams": {"year": "year BETWEEN 1950 AND 2100", "status": f"status IN {EXAM_STATUSES}"},
    "questions": {"confidence": "confidence BETWEEN 0 AND 1"},
    "options": {"letter": "length(letter) = 1", "ordinal": "ordinal >= 0"},
    "keys": {"status": f"status IN {STATUSES}", "source": f"source IN {SOURCES}", "confidence": "confidence BETWEEN 0 AND 1"},
    "links": {"score": "score BETWEEN 0 AND 1"},
}
UNIQUE = {
    "exams": [(["id"], None), (["file_hash"], None)], "topics": [(["id"], None), (["name"], None), (["slug"], None)],
    "questions": [(["id"], None), (["uuid"], None), (["exam", "number"], "number IS NOT NULL")],
    "options": [(["id"], None), (["question", "letter"], None), (["question", "ordinal"], None)], "keys": [(["id"], None), (["question"], None)],
    "key_letters": [(["question", "option"], None)], "links": [(["question", "topic"], None), (["question"], "principal")], "media": [(["id"], None)],
}
REFERENCES = [("questions", "exam", "exams"), ("options", "question", "questions"), ("keys", "question", "questions"), ("key_letters", "question", "questions"), ("key_letters", "option", "options"), ("links", "question", "questions"), ("links", "topic", "topics"), ("media", "question", "questions"), ("topics", "parent", "topics")]


# Reading


def read_model(bank: Bank) -> DataFrame:
    """One row for each question with its exam, principal topic, key, and numbers of options and media.
    The topic's condition stands in the join, so questions without a principal topic stay."""
    counted = lambda table, name: bank[table].groupBy(F.col("question").alias("id")).agg(F.count("*").alias(name))
    principal = bank["links"].where("principal").select(F.col("question").alias("id"), F.col("topic").alias("topic_id"))
    topics = bank["topics"].select(F.col("id").alias("topic_id"), F.col("name").alias("topic"))
    answers = bank["key_letters"].join(bank["options"].select(F.col("id").alias("option"), "letter"), "option")
    letters = relational.joined_letters(answers, "question", "letter").withColumnRenamed("question", "id")
    key = bank["keys"].select(F.col("question").alias("id"), "status", "source", F.col("confidence").alias("key_confidence"))
    exams = bank["exams"].select(F.col("id").alias("exam"), "institution", "title", "year")
    rows = bank["questions"].join(exams, "exam", "left").join(principal, "id", "left").join(topics, "topic_id", "left").join(key, "id", "left").join(letters, "id", "left")
    rows = rows.join(counted("options", "options"), "id", "left").join(counted("media", "media"), "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("options", "media")})


def matching(model: DataFrame, bank: Bank, text: str | None = None, topic: int | None = None, untagged: bool = False, exam: int | None = None, eligible_only: bool = False) -> DataFrame:
    """The read model's rows that meet every condition given: words of the text, a topic or one of its
    children, no topic at all, an exam; of all questions, inactive ones too, or of those an exam can
    use."""
    rows = relational.eligible(model) if eligible_only else model
    links = bank["links"].select(F.col("question").alias("item"), "topic")
    if text is not None and text.strip():
        rows = rows.where(T.matches_all(F.concat_ws(" ", "support", "statement", "command"), text))
    if exam is not None:
        rows = rows.where(F.col("exam") == exam)
    if topic is not None:
        rows = relational.under_topic(rows.withColumn("item", F.col("id")), bank["topics"], links, topic).drop("item")
    if untagged:
        rows = relational.untagged(rows.withColumn("item", F.col("id")), links).drop("item")
    return rows


def search(model: DataFrame, bank: Bank, page: int = 0, size: int = 100, **conditions) -> DataFrame:
    """A page of matching() in order of id."""
    return relational.page(matching(model, bank, **conditions), ["id"], page, size)


def search_count(model: DataFrame, bank: Bank, **conditions) -> DataFrame:
    """(n): how many rows search() has on all pages."""
    return matching(model, bank, **conditions).agg(F.count("*").alias("n"))


def lookup(questions: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The question of each wanted(value) by id, uuid or content hash; of equal ones the least id."""
    met = questions.join(wanted.select(F.col("value").alias("__value")).distinct(), F.col(column) == F.col("__value"), "left_semi")
    first = met.groupBy(column).agg(F.min_by(F.struct(*questions.columns), "id").alias("row"))
    return first.select("row.*")


def pending_inference(model: DataFrame, exam: int | None = None) -> DataFrame:
    """Active questions without an answer and with two options at least, of one exam or of all."""
    rows = model.where(F.col("active") & (F.col("status") == "ausente") & (F.col("options") >= 2))
    return (rows if exam is None else rows.where(F.col("exam") == exam)).orderBy(F.coalesce("number", "id"), "id")


def exam_list(exams: DataFrame, status: str | None = None) -> DataFrame:
    """Exams, of one status or of all, the newest first."""
    rows = exams if status is None else exams.where(F.col("status") == status)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc())


def topic_named(topics: DataFrame, key: str) -> DataFrame:
    """The topic of that name or slug."""
    return topics.where((F.col("name") == key) | (F.col("slug") == key))


def children(topics: DataFrame, parent: int) -> DataFrame:
    return topics.where((F.col("parent") == parent) & F.col("active")).orderBy("name", "id")


def topics_with(counts: DataFrame, column: str = "total") -> DataFrame:
    """Topics that have questions, or with `available` questions that an exam can use."""
    return counts.where(F.col(column) > 0)


# Writing


def content(questions: DataFrame, options: DataFrame) -> DataFrame:
    """questions with the content hash of their texts and of their options' in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "letter", "text"))), lambda o: o["text"])
    listed = options.groupBy(F.col("question").alias("id")).agg(texts.alias("__texts"))
    met = questions.join(listed, "id", "left")
    parts = F.concat(F.array("support", "statement", "command"), F.coalesce("__texts", F.array().cast("array<string>")))
    return met.withColumn("content_hash", T.content_hash_array(parts)).select(*questions.columns)


def _touched(bank: Bank, ids: DataFrame, at: Column, questions: DataFrame | None = None, options: DataFrame | None = None) -> Bank:
    """The bank with the questions ids(id) hashed and dated anew."""
    questions = bank["questions"] if questions is None else questions
    options = bank["options"] if options is None else options
    mine = ids.select(F.col("id").alias("__id")).distinct()
    on = F.col("id") == F.col("__id")
    again = content(questions.join(mine, on, "left_semi"), options.join(mine, F.col("question") == F.col("__id"), "left_semi"))
    rest = questions.join(mine, on, "left_anti")
    return bank | {"questions": rest.unionByName(again.withColumn("updated_at", at)), "options": options}


def write_questions(bank: Bank, questions: DataFrame, options: DataFrame, at: Column) -> Bank:
    """New questions with their options, each with a key that is still absent. A number that the exam has
    already, or a uuid that is taken, is refused by constraint_violations() before the snapshot is put in place."""
    top = bank["keys"].agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("top"))
    each = number(questions.select(F.col("id").alias("question")), ["question"]).join(F.broadcast(top))  # one row
    born = each.select((F.col("top") + F.col("__number")).alias("id"), "question", F.lit("ausente").alias("status"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("confidence"))
    grown = bank | {"keys": bank["keys"].unionByName(born)}
    return _touched(grown, questions, at, bank["questions"].unionByName(questions), bank["options"].unionByName(options))


def edit_texts(bank: Bank, changes: DataFrame, at: Column) -> Bank:
    """changes(id, support, statement, command): texts that are not null take the place of the old."""
    edited = upsert.patch(bank["questions"], changes, ["id"], ["support", "statement", "command"])
    return _touched(bank, changes, at, questions=edited)


def correct_options(bank: Bank, changes: DataFrame, at: Column) -> Bank:
    """changes(question, letter, text): an option of that letter gets the text, a letter that the question
    lacks becomes an option at the next ordinal, several in order of their letters. Ids of new options
    follow the greatest one. Changes with a blank letter, and those of questions that the bank lacks,
    make nothing."""
    given = changes.select("question", T.tidy_letter(F.col("letter")).alias("letter"), F.col("text").alias("__text")).where("letter <> ''")
    given = given.join(bank["questions"].select(F.col("id").alias("question")), "question", "left_semi")
    given = given.groupBy("question", "letter").agg(F.max("__text").alias("__text"))
    options = bank["options"]
    kept = options.join(given, ["question", "letter"], "left").withColumn("text", F.coalesce("__text", "text")).select(*options.columns)
    fresh = given.join(options.select("question", "letter"), ["question", "letter"], "left_anti").join(upsert.next_ordinal(options, "question", "ordinal"), "question", "left")
    place = F.row_number().over(Window.partitionBy("question").orderBy("letter")) - 1
    fresh = fresh.withColumn("ordinal", (F.coalesce("next", F.lit(0)) + place).cast("int"))
    top = options.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("top"))
    fresh = number(fresh, ["question", "letter"]).join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("__number")).withColumn("text", F.col("__text"))  # one row
    return _touched(bank, given.select(F.col("question").alias("id")), at, options=kept.unionByName(fresh.select(*options.columns)))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __number from 1 in an order: ranges are sorted apart, and each begins after the rows of
    those before it, so no task sorts all."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parted = relational.cut(parted)
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parted.join(before.select("__part", "__before"), "__part").withColumn("__number", F.col("__before") + here).drop("__part", "__before")


def remove_options(bank: Bank, gone: DataFrame, at: Column) -> Bank:
    """gone(question, letter): these options and the key letters that name them go."""
    options = bank["options"].join(gone.select("question", "letter"), ["question", "letter"], "left_anti").select(*bank["options"].columns)
    ids = bank["options"].join(gone.select("question", "letter"), ["question", "letter"], "left_semi")
    letters = upsert.cascade_delete(bank["key_letters"], ids, "option", "id")
    return _touched(bank | {"key_letters": letters}, gone.select(F.col("question").alias("id")), at, options=options)


def define_keys(bank: Bank, answers: DataFrame, source: str) -> tuple[Bank, DataFrame]:
    """(bank, refused) with the keys of answers(question, letters array, confidence) written.

    The status follows from the number of letters, and the letters replace those before. A question whose
    options lack a letter keeps its key; refused(question, letter) has these letters, and a row without
    a letter for each question that the bank lacks. Ids of new keys follow the greatest one.
    """
    met = answers.join(bank["questions"].select(F.col("id").alias("__known")), F.col("question") == F.col("__known"), "left")
    unknown = met.where("__known IS NULL").select("question", F.lit(None).cast("string").alias("letter"))
    answers = met.where("__known IS NOT NULL").drop("__known")
    asked = answers.select("question", F.explode("letters").alias("letter"))
    known = asked.join(bank["options"].select("question", "letter", F.col("id").alias("option")), ["question", "letter"], "left")
    refused = known.where("option IS NULL").select("question", "letter")
    good = answers.join(refused.select("question").distinct(), "question", "left_anti")
    fresh = good.select("question", keys.status_of(F.col("letters")).alias("status"), F.lit(source).alias("source"), "confidence")
    table = bank["keys"]
    met = fresh.join(table.select("question", "id"), "question", "left")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("top"))
    born = number(met.where("id IS NULL"), ["question"]).join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("__number"))  # one row
    new = met.where("id IS NOT NULL").unionByName(born.select(*met.columns))
    kept = table.join(fresh.select("question"), "question", "left_anti")
    letters = bank["key_letters"].join(good.select("question"), "question", "left_anti")
    named = known.join(good.select("question"), "question", "left_semi").select("question", "option").distinct()
    return bank | {"keys": kept.unionByName(new.select(*table.columns)), "key_letters": letters.unionByName(named)}, refused.unionByName(unknown)


def apply_key_text(bank: Bank, exam: int, parsed: DataFrame, at: Column, source: str = "pdf", path: str | None = None) -> tuple[Bank, DataFrame, DataFrame]:
    """(bank, applied, log) of a parsed key (see keys.parse_keys) for one exam: keys that fit are written
    with confidence 1, `applied` tells what became of each number, `log` is one row of counts. If any
    was applied, the exam keeps the path of the key's file."""
    letters = bank["options"].groupBy(F.col("question").alias("item")).agg(F.collect_set("letter").alias("options"))
    items = bank["questions"].where((F.col("exam") == exam) & F.col("number").isNotNull() & F.col("active")).select(F.col("exam").alias("exam_id"), "number", F.col("id").alias("item"))
    items = items.join(letters, "item", "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))
    applied = relational.cut(keys.apply_keys(parsed.withColumn("exam_id", F.lit(exam).cast("long")), items))
    answers = applied.where("outcome = 'applied'").select(F.col("item").alias("question"), "letters", F.lit(1.0).alias("confidence"))
    done, _ = define_keys(bank, answers, source)
    report = keys.application_report(applied)
    detail = F.to_json(F.struct(*[c for c in report.columns if c != "exam_id"]))
    log = report.select("exam_id", F.lit("gabarito").alias("stage"), F.when(F.col("unknown") + F.col("outside") > 0, "warning").otherwise("info").alias("level"), F.lit("key applied").alias("message"), detail.alias("detail"), F.lit(0).cast("long").alias("duration_ms"), at.alias("at"))
    if path is not None:
        some = report.where("applied > 0").select(F.col("exam_id").alias("__exam"))
        exams = bank["exams"].join(some, F.col("id") == F.col("__exam"), "left")
        done = done | {"exams": exams.withColumn("key_path", F.when(F.col("__exam").isNotNull(), F.lit(path)).otherwise(F.col("key_path"))).drop("__exam")}
    return done, applied, log


def confirm(bank: Bank, question: int, letters: list[str]) -> tuple[Bank, DataFrame]:
    """A person's answer to one question, be it a correction or the confirmation of a suggestion: manual,
    of confidence 1. There is no form for many on purpose."""
    spark = bank["keys"].sparkSession
    rows = spark.createDataFrame([(question, list(letters), 1.0)], "question long, letters array<string>, confidence double")
    return define_keys(bank, rows, "manual")


def set_topics(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """links with chosen(question, topic, and perhaps principal) set by hand: each is a manual link of score
    1. Unless a row says that it is not principal, it becomes the only principal one of its question,
    the last of several by topic id."""
    if "principal" not in chosen.columns:
        chosen = chosen.withColumn("principal", F.lit(True))
    picked = chosen.groupBy("question", "topic").agg(F.bool_or(F.coalesce("principal", F.lit(True))).alias("__first"))
    last = picked.where("__first").groupBy("question").agg(F.max("topic").alias("__main"))
    before = links.join(picked.select("question", "topic"), ["question", "topic"], "left_semi").select("question", "topic", F.col("principal").alias("__was"))
    kept = links.join(picked, ["question", "topic"], "left_anti")
    new = picked.join(before, ["question", "topic"], "left").select("question", "topic", F.lit(1.0).alias("score"), F.lit("manual").alias("origin"), F.coalesce("__was", F.lit(False)).alias("principal"))
    both = kept.select(*new.columns).unionByName(new).join(last, "question", "left")
    return both.withColumn("principal", F.when(F.col("__main").isNull(), F.col("principal")).otherwise(F.col("topic") == F.col("__main"))).select(*links.columns)


def remove_topics(links: DataFrame, gone: DataFrame) -> DataFrame:
    """links without those of gone(question, topic), whatever their origin. A question that loses its
    principal link has none until one is set."""
    return links.join(gone.select("question", "topic").distinct(), ["question", "topic"], "left_anti").select(*links.columns)


def set_flags(table: DataFrame, ids: DataFrame, at: Column | None = None, **values) -> DataFrame:
    """The table with columns of the rows ids(id) set: reviewed, active, status, paths, counts."""
    met = table.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    new = {c: F.when(hit, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    if at is not None:
        new["updated_at"] = F.when(hit, at).otherwise(F.col("updated_at"))
    return met.withColumns(new).select(*table.columns)


def delete_exams(bank: Bank, gone: DataFrame) -> Bank:
    """The bank without the exams gone(id), their questions, and all that hangs on these."""
    lost = bank["questions"].join(gone.select(F.col("id").alias("__gone")), F.col("exam") == F.col("__gone"), "left_semi").select("id")
    out = bank | {"exams": upsert.cascade_delete(bank["exams"], gone, "id", "id"), "questions": upsert.cascade_delete(bank["questions"], gone, "exam", "id")}
    return out | {t: upsert.cascade_delete(bank[t], lost, "question", "id") for t in ("options", "keys", "key_letters", "links", "media")}


def delete_topics(bank: Bank, gone: DataFrame) -> Bank:
    """The bank without the topics gone(id) and their links; their children become roots."""
    topics = upsert.set_null(upsert.cascade_delete(bank["topics"], gone, "id", "id"), gone, "parent", "id")
    return bank | {"topics": topics, "links": upsert.cascade_delete(bank["links"], gone, "topic", "id")}


def seed_topics(topics: DataFrame, tree: list[tuple[str, str | None]]) -> DataFrame:
    """topics with those of the tree (name, parent's name or None) that no name or slug stands for yet;
    parents come before children. Seeding again changes nothing."""
    spark = topics.sparkSession
    for level in ([n for n, p in tree if p is None], [(n, p) for n, p in tree if p is not None]):
        if not level:
            continue
        rows = spark.createDataFrame([(k, n, None) if isinstance(n, str) else (k, *n) for k, n in enumerate(level, 1)], "k long, name string, above string")
        rows = rows.withColumn("slug", T.slug(F.col("name")))
        fresh = rows.join(topics.select("name"), "name", "left_anti").join(topics.select("slug"), "slug", "left_anti")
        fresh = fresh.join(topics.select(F.col("name").alias("above"), F.col("id").alias("parent")), "above", "left")
        top = topics.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("top"))
        fresh = fresh.join(F.broadcast(top)).select((F.col("top") + F.col("k")).alias("id"), "name", "slug", "parent", F.lit(True).alias("active"))  # one row
        topics = relational.cut(topics.unionByName(fresh))
    return topics


# Schema and integrity


def constraint_violations(bank: Bank) -> DataFrame:
    """(table, rule, n) of every rule of a bank that rows break: checks, unique keys, references, and that
    a key's letters are its own question's. All checks of a table are one aggregate over it, and all
    references to a table one join with its ids."""
    found = []

    def add(table: str, rule: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "n"))

    for table, checks in CHECKS.items():
        counts = bank[table].agg(*[F.count_if(F.expr(f"NOT ({holds})")).alias(name) for name, holds in checks.items()])
        each = F.array(*[F.struct(F.lit(f"check {name}").alias("rule"), F.col(name).alias("n")) for name in checks])
        found.append(counts.select(F.lit(table).alias("table"), F.explode(each).alias("x")).select("table", "x.rule", "x.n"))
    for table, rules in UNIQUE.items():
        for columns, where in rules:
            rows = bank[table].where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
            add(table, f"unique {', '.join(columns)}", upsert.unique_violations(rows, columns, F.expr(where) if where else None))
    for parent in dict.fromkeys(p for *_, p in REFERENCES):
        uses = [bank[t].select(F.lit(t).alias("table"), F.lit(f"reference {c}").alias("rule"), F.col(c).alias("__to")) for t, c, p in REFERENCES if p == parent]
        lost = upsert.orphans(relational.unioned(uses), bank[parent], "__to", "id")
        found.append(lost.groupBy("table", "rule").agg(F.count("*").alias("n")))
    owner = bank["options"].select(F.col("id").alias("option"), F.col("question").alias("__owner"))
    met = bank["key_letters"].join(owner, "option")
    add("key_letters", "option of the question", upsert.same_parent_violations(met, F.col("question"), F.col("__owner")))
    return relational.unioned(found).where("n > 0")


def admission_rules(bank: Bank, table: str, more: dict[str, tuple[list[str], str | None]] | None = None) -> admission.Rules:
    """The bank's rules for new rows of a table, with further unique keys."""
    references = [(c, bank[p], "id") for t, c, p in REFERENCES if t == table]
    return admission.Rules(CHECKS.get(table, {}), references, (more or {}) | {", ".join(columns): (columns, where) for columns, where in UNIQUE[table]})


def admit_questions(bank: Bank, questions: DataFrame, options: DataFrame, order: list[str], at: Column, known_texts: bool = True) -> tuple[Bank, DataFrame]:
    """(bank, verdicts) with the questions stored that the bank takes, in their order, each with its options
    and a key that is still absent. verdicts has the questions with `broken` and `blocker`, see
    admission.admit(); a text that is known already, or earlier in the batch, breaks `unique text`,
    unless such texts are wanted too. Questions without a statement have no text to be known."""
    hashed = content(questions, options)
    text = {"text": (["content_hash"], "statement IS NOT NULL AND statement <> ''")} if known_texts else {}
    verdicts = admission.admit(hashed, order, admission_rules(bank, "questions", text), bank["questions"], "id")
    good = verdicts.where("broken IS NULL").select(*bank["questions"].columns)
    mine = options.join(good.select(F.col("id").alias("question")), "question", "left_semi").select(*bank["options"].columns)
    return write_questions(bank, good, mine, at), verdicts


def create_tables(spark: SparkSession, path: str) -> list[str]:
    """Creates the bank's tables under a path that have no folder yet, and notes each one's columns and
    their digest in the ledger. A table whose columns are not those of the ledger any more raises.
    Returns the names of the tables it made; a second call makes none."""
    from pyspark.errors import AnalysisException

    try:
        ledger = {r.table: r.digest for r in spark.read.parquet(f"{path}/ledger").collect()}
    except AnalysisException:
        ledger = {}
    rows = spark.createDataFrame(list(TABLES.items()), "table string, columns string").withColumn("digest", F.sha2("columns", 256)).collect()
    for r in rows:
        if ledger.get(r.table, r.digest) != r.digest:
            raise ValueError(f"the columns of {r.table} are not those it was made with")
    made = [r for r in rows if r.table not in ledger]
    for r in made:
        spark.createDataFrame([], r.columns).write.mode("overwrite").parquet(f"{path}/{r.table}")
    if made:
        spark.createDataFrame(made).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/ledger")
    return [r.table for r in made]


def open_bank(spark: SparkSession, path: str) -> Bank:
    return {t: spark.read.schema(kinds).parquet(f"{path}/{t}") for t, kinds in TABLES.items()}
