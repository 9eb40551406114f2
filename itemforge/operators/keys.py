"""Answer keys: reading them from text and sheets, and applying them to stored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import text as T

#: Words for an annulled item, after folding; words and marks between two answers; marks
#: between a number and its answer.
ANNULLED = ("ANULADA", "ANULADO", "ANULAR", "NULA", "NULO", "CANCELADA", "X", "XX", "*", "**")
BETWEEN = ("/", ",", ";", "+", "&", "E", "OU")
AFTER_NUMBER = ("-", ".", ")", ":", "]", "|")
LETTERS = ("A", "B", "C", "D", "E")
#: What a pair of a number and an answer is waiting for.
_NOTHING, _MARK, _ANSWER, _MORE, _LETTER, _END = range(6)


def key_tokens(line: Column) -> Column:
    """Numbers, words, runs of stars and single marks of a folded line; a tilde stands where a digit
    follows a letter at once."""
    return F.regexp_extract_all(F.regexp_replace(line, "(?<=[A-Z])(?=[0-9])", "~"), F.lit(r"[0-9]+|[A-Z]+|\*+|[^A-Z0-9*\s]"), F.lit(0))


def key_pairs(line: Column) -> Column:
    """An array of (number, letters) that a folded line names, read from left to right.

    A number of up to three digits, perhaps one mark, then an answer: a word for annulled, which has no
    letters, or letters with a word or mark between each two. E is a letter where an answer or a further
    letter is awaited, else it is the word. An answer that a digit follows at once is none.
    """
    pair = "struct<number:int,letters:array<string>>"
    start = F.struct(F.lit(_NOTHING).alias("awaits"), F.lit(None).cast("int").alias("number"), F.array().cast("array<string>").alias("letters"), F.array().cast(f"array<{pair}>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        awaits, letters = state["awaits"], state["letters"]

        def to(awaits: int, number: Column = state["number"], letters: Column = letters, found: Column = state["found"]) -> Column:
            return F.struct(F.lit(awaits).alias("awaits"), number.alias("number"), letters.alias("letters"), found.alias("found"))

        def closed(letters: Column) -> Column:
            done = F.array(F.struct(state["number"].alias("number"), letters.alias("letters")).cast(pair))
            return F.when(awaits >= _MORE, F.concat(state["found"], done)).otherwise(state["found"])

        none, fewer = F.array().cast("array<string>"), F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0)))
        number = token.rlike("^[0-9]{1,3}$")
        return (
            F.when(number, to(_MARK, token.try_cast("int"), none, closed(letters)))
            .when(awaits.isin(_MARK, _ANSWER) & token.isin(*LETTERS), to(_MORE, letters=F.array(token)))
            .when(awaits.isin(_MARK, _ANSWER) & token.isin(*ANNULLED), to(_END, letters=none))
            .when((awaits == _MARK) & token.isin(*AFTER_NUMBER), to(_ANSWER))
            .when((awaits == _MORE) & token.isin(*BETWEEN), to(_LETTER))
            .when((awaits == _LETTER) & token.isin(*LETTERS), to(_MORE, letters=F.concat(letters, F.array(token))))
            .when((token == "~") & (awaits == _MORE) & (F.size(letters) > 1), to(_NOTHING, found=closed(fewer)))
            .when((token == "~") & awaits.isin(_MORE, _END), to(_NOTHING))
            .otherwise(to(_NOTHING, found=closed(letters)))
        )

    def finish(state: Column) -> Column:
        done = F.array(F.struct(state["number"].alias("number"), state["letters"].alias("letters")).cast(pair))
        return F.when(state["awaits"] >= _MORE, F.concat(state["found"], done)).otherwise(state["found"])

    return F.transform(F.aggregate(key_tokens(line), start, step, finish), lambda p: F.struct(p["number"].alias("number"), F.array_distinct(p["letters"]).alias("letters")))


def status_of(letters: Column) -> Column:
    n = F.size(letters)
    return F.when(n == 0, "anulada").when(n == 1, "valida").otherwise("multipla")


def parse_keys(texts: DataFrame, id_column: str = "exam_id", text_column: str = "text", expected_column: str = "expected") -> DataFrame:
    """(exam_id, number, letters, status, outcome) for each number that a key's text names.

    outcome is `read`, `conflict` when a number has different answers (letters is then null), or
    `out of range` below 1 or above the expected total. Equal repeats are one reading.
    """
    lines = texts.select(F.col(id_column).alias("exam_id"), F.col(expected_column).alias("expected"), F.explode(F.split(F.coalesce(F.col(text_column), F.lit("")), r"\R")).alias("line"))
    plain = F.col("line").rlike("^[ -~]*$")  # nothing to fold, and spaces part words however many they are
    folded = F.upper(F.when(plain, F.col("line")).otherwise(T.fold_accents(T.clean(F.col("line")))))
    found = lines.select("exam_id", "expected", F.explode(key_pairs(folded)).alias("pair"))
    pairs = found.select("exam_id", "expected", "pair.number", "pair.letters")
    ranged = F.when((F.col("number") < 1) | (F.col("number") > F.coalesce("expected", F.lit(999))), "out of range")
    read = pairs.groupBy("exam_id", "number", "expected").agg(F.min("letters").alias("letters"), F.max("letters").alias("other"))
    outcome = F.coalesce(ranged, F.when(F.col("letters") != F.col("other"), "conflict"), F.lit("read"))
    rows = read.select("exam_id", "number", "letters", outcome.alias("outcome"))
    return rows.select("exam_id", "number", F.when(F.col("outcome") == "read", F.col("letters")).alias("letters"), F.when(F.col("outcome") == "read", status_of(F.col("letters"))).alias("status"), "outcome")


def report_counts(parsed: DataFrame) -> DataFrame:
    """Counts by exam of what a key's text gave: numbers read, annulled, in conflict, and out of range."""
    n = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    outcome = F.col("outcome")
    return parsed.groupBy("exam_id").agg(n(outcome == "read").alias("read"), n(F.col("status") == "anulada").alias("annulled"), n(outcome == "conflict").alias("conflicts"), n(outcome == "out of range").alias("outside"))


def missing_numbers(parsed: DataFrame, exams: DataFrame) -> DataFrame:
    """(exam_id, number) from 1 to the expected total, or to the greatest number read, that were not
    read. exams(exam_id, expected). The numbers that an exam's key names are gathered once, by exam."""
    read = parsed.where("outcome = 'read'").groupBy("exam_id").agg(F.max("number").alias("top"), F.collect_set("number").alias("read"))
    last = exams.join(read, "exam_id", "left")
    top = F.coalesce("expected", "top", F.lit(0))
    missing = F.array_except(F.sequence(F.lit(1), top), F.coalesce("read", F.array().cast("array<int>")))
    return last.where(top >= 1).select("exam_id", F.explode(missing).alias("number"))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """(exam_id, sheet, row, line) from cells(exam_id, sheet, row, col, value): a row of numbers with
    answers below, when it has two such pairs, gives a line for each pair; each row's own text is a
    line as well."""
    numbers = cells.where(F.trim("value").rlike(r"^\d{1,3}$"))
    below = cells.select("exam_id", "sheet", (F.col("row") - 1).alias("row"), "col", F.col("value").alias("answer"))
    pairs = numbers.join(below, ["exam_id", "sheet", "row", "col"]).where(F.upper(F.trim("answer")).rlike(r"^[A-E*X]|^ANUL|^NUL|^CANC"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("col", F.concat_ws(" ", "value", "answer").alias("t")))), lambda x: x["t"])
    paired = pairs.groupBy("exam_id", "sheet", "row").agg(lines.alias("t")).where(F.size("t") >= 2).select("exam_id", "sheet", "row", F.explode("t").alias("line"))
    flat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " ")
    return paired.union(cells.groupBy("exam_id", "sheet", "row").agg(flat.alias("line")))


def apply_keys(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """(exam_id, number, item, letters, status, outcome) of the full outer meeting of parsed keys and
    items(exam_id, number, item, options array).

    outcome: applied; unknown number; letter outside options (the item keeps its key); no answer.
    """
    keys = parsed.where("outcome = 'read'").select("exam_id", "number", "letters", "status")
    met = items.join(keys, ["exam_id", "number"], "full_outer")
    outcome = (
        F.when(F.col("item").isNull(), "unknown number")
        .when(F.col("letters").isNull(), "no answer")
        .when(F.size(F.array_except("letters", "options")) > 0, "letter outside options")
        .otherwise("applied")
    )
    return met.select("exam_id", "number", "item", "letters", "status", outcome.alias("outcome"))


def application_report(applied: DataFrame) -> DataFrame:
    """Counts by exam: applied, annulled, available, unknown, outside, unanswered."""
    def n(condition: Column) -> Column:
        return F.count_if(condition)

    done, annulled = F.col("outcome") == "applied", F.col("status") == "anulada"
    return applied.groupBy("exam_id").agg(
        n(done).alias("applied"), n(done & annulled).alias("annulled"), n(done & ~annulled).alias("available"),
        n(F.col("outcome") == "unknown number").alias("unknown"), n(F.col("outcome") == "letter outside options").alias("outside"), n(F.col("outcome") == "no answer").alias("unanswered"),
    )
