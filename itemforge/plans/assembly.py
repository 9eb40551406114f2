"""Pipelines of operators: importing documents, reading keys, generating an exam with its sheet."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import keys, layout, selection
from itemforge.sources import files, shared


class ImportFailure(Exception):
    """No document of a batch could be imported; `failed` has each document and its error."""

    def __init__(self, failed: DataFrame) -> None:
        super().__init__("no document of the batch was imported")
        self.failed = failed


#: What a document is refused for, in the order in which it is tested.
ERRORS = ("no text layer", "illegible text", "no questions")
LEGIBLE = 0.80


@dataclass
class Import:
    """Fragments to stored questions. Each stage is run once, written to the shared folder, and counted
    while it is written; `log` has a row for each (exam_id, stage, level, message, detail, duration_ms),
    and goes to `log_path` at the end, also if a stage fails.

    After run(), `statuses` has (doc_id, status, error): `processado`, or `erro` with one of ERRORS for
    a document that is refused. A batch of nothing but refused documents raises.
    """

    exam_id: int | None = None
    log_path: str | None = None
    known_texts_too: bool = False
    log: list[tuple] = field(default_factory=list)
    statuses: DataFrame | None = None

    def _timed(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.monotonic()
        ms = lambda: int(1000 * (time.monotonic() - began))
        try:
            out, n = shared.counted(make(), stage)
        except Exception as e:
            self.log.append((self.exam_id, stage, "error", type(e).__name__, str(e)[:500], ms()))
            raise
        self.log.append((self.exam_id, stage, "info" if n else "warning", f"{n} rows", None, ms()))
        return out

    def run(self, fragments: DataFrame, pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Questions with their content hash and `outcome`: recorded, duplicate (of a known one or of an
        earlier one of the batch), or rejected for want of statement and options."""
        try:
            columns = self._timed("columns", lambda: layout.assign_columns(fragments, pages))
            lines = self._timed("lines", lambda: layout.fuse_lines(columns))
            gate = self._timed("gate", lambda: text_gate(lines, pages))
            good = gate.where("error IS NULL").select(F.col("doc_id").alias("__good"))
            mine = lines.join(good, F.col("doc_id") == F.col("__good"), "left_semi")
            noise = self._timed("noise", lambda: layout.detect_noise(mine, pages))
            kept = noise.where("noise IS NULL")
            found = self._timed("segment", lambda: layout.segment(kept))
            self._warnings(kept)
            asked = found.select(F.col("doc_id").alias("__asked")).distinct()
            met = gate.join(asked, F.col("doc_id") == F.col("__asked"), "left")
            error = F.coalesce("error", F.when(F.col("__asked").isNull(), ERRORS[2]))
            self.statuses = self._timed("status", lambda: met.select("doc_id", F.when(error.isNull(), "processado").otherwise("erro").alias("status"), error.alias("error")))
            failed = self.statuses.where("status = 'erro'")
            if not self.statuses.isEmpty() and self.statuses.where("status <> 'erro'").isEmpty():
                raise ImportFailure(failed)
            return self._timed("record", lambda: record(found, known, self.known_texts_too))
        finally:
            if self.log_path:
                spark = fragments.sparkSession
                rows = spark.createDataFrame(self.log, "exam_id long, stage string, level string, message string, detail string, duration_ms long")
                files.append_log(rows.withColumn("at", F.current_timestamp()), self.log_path)

    def _warnings(self, lines: DataFrame) -> None:
        """A log row for each kind of warning of the batch's documents, with how many there are."""
        counts = layout.segment_warnings(lines).groupBy("warning").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
        for r in counts.orderBy("warning").collect():  # one row for each kind
            self.log.append((self.exam_id, "segment", "warning", r.warning, f"{r.n} in {r.docs} documents", 0))


def text_gate(lines: DataFrame, pages: DataFrame, least: int = 120, legible: float = LEGIBLE, sample: int = 20_000) -> DataFrame:
    """(doc_id, error) of the documents of pages: null, or why their text cannot be used. A scan has too
    few characters a page, which is told first; a font without a character table gives characters
    that are none. Legibility is that of the first characters in reading order: only pages that begin
    within the sample are read for it."""
    each = lines.withColumn("__n", F.length(F.coalesce("text", F.lit(""))))
    by_page = each.groupBy("doc_id", "page").agg(F.sum("__n").alias("__here"))
    before = F.coalesce(F.sum("__here").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    early = by_page.withColumn("__before", before).where(F.col("__before") < sample).select("doc_id", "page")
    order = F.array_sort(F.collect_list(F.struct("page", "col", "seq", "text")))
    shown = each.join(early, ["doc_id", "page"]).groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["text"]), "").alias("__text"))
    share = shown.select("doc_id", T.legible_share(F.col("__text"), sample).alias("share"))
    size = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).join(by_page.groupBy("doc_id").agg(F.sum("__here").alias("n")), "doc_id", "left")
    error = F.when(F.coalesce("n", F.lit(0)) / F.col("pages") < least, ERRORS[0]).when(F.coalesce("share", F.lit(0.0)) < legible, ERRORS[1])
    return size.join(share, "doc_id", "left").select("doc_id", error.alias("error"))


def record(questions: DataFrame, known: DataFrame | None = None, known_texts_too: bool = False) -> DataFrame:
    """questions with hash, key_status and outcome; a key is born `ausente`. A question without a statement
    has no text that could be known already; with known_texts_too repeats are recorded as well."""
    parts = F.concat(F.array("statement"), F.transform("options", lambda o: o["text"]))
    rows = questions.withColumn("hash", T.content_hash_array(parts)).withColumn("key_status", F.lit("ausente"))
    stated = F.coalesce(F.col("statement"), F.lit("")) != ""
    first = rows.where(stated).groupBy("hash").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    met = rows.join(first, "hash", "left")
    if known is not None:
        met = met.join(known.select(F.col("hash").alias("__known")).distinct(), F.col("hash") == F.col("__known"), "left")
        stored = F.col("__known").isNotNull()
    else:
        stored = F.lit(False)
    later = F.col("first").isNotNull() & (F.struct("doc_id", "number") != F.col("first"))
    repeats = F.lit(not known_texts_too) & stated & (stored | later)
    outcome = F.when(~stated & (F.size("options") == 0), "rejected").when(repeats, "duplicate").otherwise("recorded")
    return met.withColumn("outcome", outcome).drop("first", "__known")


def split_rejects(questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recorded, rejected, counts): rows that are stored, rows that are not with their outcome as a
    warning, and how many there are of each outcome."""
    return questions.where("outcome = 'recorded'"), questions.where("outcome <> 'recorded'"), questions.groupBy("outcome").agg(F.count("*").alias("n"))


def key_from_lines(lines: DataFrame, expected: Column | None = None) -> DataFrame:
    """A parsed key from a document's lines(doc_id, page, col, seq, text, noise): those that are no noise,
    in reading order. A document without any text is a scan and gives no row."""
    kept = lines.where("noise IS NULL") if "noise" in lines.columns else lines
    order = F.array_sort(F.collect_list(F.struct("page", "col", "seq", "text")))
    text = F.array_join(F.transform(order, lambda x: x["text"]), "\n")
    texts = kept.groupBy(F.col("doc_id").alias("exam_id")).agg(text.alias("text")).withColumn("expected", (F.lit(None) if expected is None else expected).cast("int"))
    return keys.parse_keys(texts)


def key_from_files(found: DataFrame, exam_id: Column, expected: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed, warnings) of key files (see files.read_files), spreadsheets by their cells and others as
    text: UTF-8, or else Latin-1 if there is no zero byte. warnings(path, message) has files that could
    not be read, and those that are no text."""
    expected = (F.lit(None) if expected is None else expected).cast("int")
    cells = files.read_cells(found.where("kind = 'sheet'"))
    rows = cells.where("error IS NULL").withColumn("exam_id", exam_id)
    sheets = keys.sheet_lines(rows).groupBy("exam_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    plain = found.where("kind = 'text'").select(exam_id.alias("exam_id"), files.decoded(F.col("content")).alias("text"))
    parsed = keys.parse_keys(sheets.unionByName(plain).withColumn("expected", expected))
    other = found.where("kind NOT IN ('sheet', 'text')").select("path", F.concat(F.lit("no key can be read from a file of kind "), "kind").alias("message"))
    return parsed, cells.where("error IS NOT NULL").select("path", F.col("error").alias("message")).unionByName(other)


def generate(pool: DataFrame, reach: DataFrame, quotas: list[tuple[object, int]], options: DataFrame, answers: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(booklet, sheet) of a new exam: items drawn by quotas from the eligible pool, renumbered in a
    seeded order, options shuffled, and the sheet in printed letters.

    pool(item), reach(topic, item), options(item, letter, text), answers(item, letters array).
    """
    usable = reach.join(pool.select(F.col("item").alias("__pool")), F.col("item") == F.col("__pool"), "left_semi")
    picked, _ = selection.draw_quotas(usable, quotas, seed)
    numbered = selection.renumber(picked.select("item").withColumn("exam", F.lit(1)), "exam", [selection.draw_key(seed, F.col("item")), F.col("item")])
    mine = options.join(numbered.select("item", "number"), "item")
    shuffled = selection.shuffle_options(mine, ["item", "number"], "letter", seed)
    maps = selection.letter_map(shuffled, ["item", "number"])
    return reprint(maps, options, answers)


def reprint(stored: DataFrame, options: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booklet, sheet) of a stored exam(item, number, map printed to original): the same permutation again,
    whatever the options' texts have become since."""
    booklet = selection.apply_map(stored, options, ["item", "number"])
    return booklet, selection.answer_sheet(answers.join(stored.select("item", "number"), "item"), stored, ["item", "number"])


#: Tables of generated exams: what stands at the head of one, and its questions with their permutations.
EXAM_STORE = {
    "generated": "id long, uuid string, title string, institution string, held_on date, instructions string, header string, mode string, seed long, shuffled boolean, created_at timestamp",
    "generated_items": "exam long, item long, number int, map map<string,string>",
}


def store_exams(spark: SparkSession, path: str, heads: DataFrame, picked: DataFrame, options: DataFrame, shuffled: bool = True) -> None:
    """Appends generated exams to the store at a path: heads(id, ... of EXAM_STORE, missing columns null)
    and the items picked(exam, item) for them, numbered in each exam's seeded order, with the map of
    printed to original letters. options(item, letter). An exam that is stored already raises."""
    names = [c.split()[0] for c in EXAM_STORE["generated"].split(", ")]
    stored = open_exams(spark, path)["generated"]
    if not heads.join(stored.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_semi").isEmpty():
        raise ValueError("an exam of that id is stored already")
    full = heads.withColumns({c: F.lit(None) for c in names if c not in heads.columns})
    full = full.withColumns({"uuid": F.coalesce("uuid", F.uuid()), "created_at": F.coalesce("created_at", F.current_timestamp()), "shuffled": F.lit(shuffled)})
    items = picked.join(heads.select(F.col("id").alias("exam"), F.col("seed").cast("string").alias("__seed")), "exam")
    key = F.sha2(F.concat_ws(":", "__seed", F.col("item").cast("string")), 256)
    numbered = selection.renumber(items, "exam", [key, F.col("item")])
    each = numbered.join(options.select("item", "letter"), "item")
    order = F.when(F.lit(shuffled), F.sha2(F.concat_ws(":", "__seed", F.col("item").cast("string"), "letter"), 256)).otherwise(F.lit(""))
    sorted_ = F.array_sort(F.collect_list(F.struct(order.alias("key"), "letter")))
    pairs = F.map_from_entries(F.transform(sorted_, lambda x, k: F.struct(F.chr(k + 65).alias("printed"), x["letter"].alias("original"))))
    maps = each.groupBy("exam", "item").agg(pairs.alias("map"))
    rows = numbered.join(maps, ["exam", "item"], "left").select("exam", "item", "number", F.coalesce("map", F.create_map().cast("map<string,string>")).alias("map"))
    rows.write.mode("append").parquet(f"{path}/generated_items")  # the head comes last: without it the items are not listed
    full.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]) for c in EXAM_STORE["generated"].split(", ")]).write.mode("append").parquet(f"{path}/generated")


def open_exams(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the store; both empty before the first exam."""
    out = {}
    for table, kinds in EXAM_STORE.items():
        try:
            out[table] = spark.read.schema(kinds).parquet(f"{path}/{table}")
        except AnalysisException:
            out[table] = spark.createDataFrame([], kinds)
    return out


def list_exams(store: dict[str, DataFrame], limit: int | None = 100) -> DataFrame:
    """Stored exams with how many questions each has, the newest first."""
    counts = store["generated_items"].groupBy(F.col("exam").alias("id")).agg(F.count("*").alias("questions"))
    rows = store["generated"].join(counts, "id", "left").withColumn("questions", F.coalesce("questions", F.lit(0)))
    rows = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rows if limit is None else rows.limit(limit)


def reprint_stored(store: dict[str, DataFrame], exam: int, options: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booklet, sheet) of a stored exam, as it was printed."""
    return reprint(store["generated_items"].where(F.col("exam") == exam).select("item", "number", "map"), options, answers)
