import io
import itertools
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import bank, keys, layout, models, relational, selection
from itemforge.plans import assembly, catalogue, classification, layout_queries
from itemforge.plans import queries as plans
from itemforge.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean", "normal", "slug"),
    [("  Ação “x” –  y… ", 'Ação "x" - y...', 'acao "x" - y...', "acao-x-y"), (None, "", "", ""), ("A​B­c", "ABc", "abc", "abc")],
)
def test_text(spark, raw, clean, normal, slug):
    c = F.lit(raw).cast("string")
    assert (one(spark, T.clean(c)), one(spark, T.normalize(c)), one(spark, T.slug(c))) == (clean, normal, slug)


def test_cleaning_composes(spark):
    import unicodedata

    for raw in ("ﬁm 1º", "e\u0301 a\u0302\u0301 ½ Ａ１ ㎏ plain", "ação", "ﾊﾟ №", "x\u0323y"):
        assert one(spark, T.compose(F.lit(raw))) == unicodedata.normalize("NFKC", raw)
    assert one(spark, T.clean(F.lit("ﬁm 1º"))) == "fim 1o"


@pytest.mark.parametrize(
    ("line", "pairs"),
    [
        ("1-A", [(1, "A")]), ("01 A", [(1, "A")]), ("1. A 2) B 3: C 4] D", [(1, "A"), (2, "B"), (3, "C"), (4, "D")]), ("QUESTAO 1 - A", [(1, "A")]),
        ("1 A 41 C 81 E", [(1, "A"), (41, "C"), (81, "E")]), ("3 ANULADA 4 ** 5 X 6 CANCELADA", [(3, ""), (4, ""), (5, ""), (6, "")]),
        ("2 A/B", [(2, "AB")]), ("2 A E B", [(2, "AB")]), ("2 A, B", [(2, "AB")]), ("2 A OU B", [(2, "AB")]), ("2 A+B", [(2, "AB")]), ("2 A E A", [(2, "A")]),
        ("1 E", [(1, "E")]), ("1 A E 2 B", [(1, "A"), (2, "B")]), ("1 D, E", [(1, "DE")]), ("2024 A", []), ("1 A2 3 B", [(3, "B")] ), ("1 A/B2", [(1, "A")]), ("1 *** 2 AB 3.- C", []), ("Q1 A", [(1, "A")]), ("", []),
    ],
)
def test_key_pairs(spark, line, pairs):
    got = one(spark, keys.key_pairs(F.lit(line)))
    assert [(p.number, "".join(p.letters)) for p in got] == pairs


def test_content_hash_ignores_form_and_empty_parts(spark):
    a, b = T.content_hash(F.lit("É  um"), F.lit(""), F.lit("B")), T.content_hash(F.lit("e UM"), F.lit("b"))
    assert one(spark, a) == one(spark, b)


@pytest.mark.parametrize(
    ("first", "value", "rest", "strong"),
    [("1.", "1", "x", True), ("12", "12", "x", False), ("6)Homem", "6", "Homem x", True), ("12.5 mg", None, None, None), ("QUESTÃO 11 ____", "11", "x", True), ("o1.", "01", "x", True), ("abc", None, None, None)],
)
def test_number_marker(spark, first, value, rest, strong):
    got = one(spark, T.number_marker(F.lit(first), F.lit("x")))
    assert (got and (got.value, got.rest, got.strong)) == ((value, rest, strong) if value else None)


@pytest.mark.parametrize(("first", "value"), [("A)", "A"), ("(B", "B"), ("(B foi", "B"), ("a)2 - 5", "a"), ("Atenção", None)])
def test_letter_marker(spark, first, value):
    got = one(spark, T.letter_marker(F.lit(first)))
    assert (got and got.value) == value


def test_maps(spark):
    assert one(spark, T.invert_map(F.create_map(F.lit("A"), F.lit("C")))) == {"C": "A"}
    assert one(spark, T.parse_pairs(F.lit("a: b:c; d:; e : f"))) == {"a": "b:c", "e": "f"}
    assert one(spark, T.column_index(F.lit("AB7"))) == 27


@pytest.mark.parametrize(("numbers", "chain"), [([1, 119, 2, 12, 3], [1, 2, 3]), ([2, 3, 4], [2, 3, 4]), ([1, 2, 4, 5], [1, 2, 4, 5]), ([], [])])
def test_longest_chain(numbers, chain):
    assert [numbers[i] for i in layout.longest_chain(numbers)] == chain


def test_split_options_takes_only_the_next_letter():
    statement, options = layout.split_options(["s", "A) x", "C) y", "B) z", "w"], [None, "A", "C", "B", None], ["", "x", "y", "z", ""])
    assert (statement, options) == ("s", [("A", "x C) y"), ("B", "z w")])


def fragments(spark, pages=5):
    rows = []
    for p in range(pages):
        rows.append((1, p, 20.0, 20.0, 500.0, 30.0, f"Exam of the year - page {p}", 9.0, False, False))
        for k in range(3):
            n, y = 3 * p + k + 1, 80.0 + 200 * k
            rows += [(1, p, 20.0, y, 30.0, y + 10, f"{n}.", 9.0, True, False), (1, p, 40.0, y, 400.0, y + 10, f"What is meant by the statement of number {n}?", 9.0, False, False)]
            rows += [(1, p, 40.0, y + 15 * (i + 1), 300.0, y + 15 * (i + 1) + 10, f"{'ABCD'[i]}) choice {i} for {n}", 9.0, False, False) for i in range(4)]
        rows.append((1, p, 280.0, 800.0, 290.0, 810.0, str(p + 1), 9.0, False, False))
    sizes = [(1, p, 595.0, 842.0) for p in range(pages)]
    return spark.createDataFrame(rows, files.FRAGMENTS), spark.createDataFrame(sizes, "doc_id long, page int, width double, height double")


def test_import_finds_questions_without_headers(spark):
    frags, sizes = fragments(spark)
    lines = layout.fuse_lines(layout.assign_columns(frags, sizes))
    noise = {r.noise for r in layout.detect_noise(lines, sizes).where("noise is not null").collect()}
    assert noise == {"header", "footer"}
    got = assembly.Import().run(frags, sizes).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 16))
    assert all(len(r.options) == 4 and r.confidence == 1.0 and r.outcome == "recorded" and "page" not in r.statement for r in got)


def test_record_marks_repeats(spark):
    rows = [(1, 1, "Same", [("A", "x")]), (2, 1, "same", [("A", "X")]), (2, 2, "", []), (2, 3, "", [("A", "x")])]
    q = spark.createDataFrame(rows, "doc_id long, number int, statement string, options array<struct<letter:string,text:string>>")
    assert [r.outcome for r in assembly.record(q).orderBy("doc_id", "number").collect()] == ["recorded", "duplicate", "rejected", "recorded"]


def workbook(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        shared = "".join(f"<si><t>{v}</t></si>" for _, _, v in cells)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{shared}</sst>')
        rows = "".join(f'<row r="{r}"><c r="{c}{r}" t="s"><v>{k}</v></c></row>' for k, (c, r, _) in enumerate(cells))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheet_cells_and_bad_files(spark, tmp_path):
    (tmp_path / "key.xlsx").write_bytes(workbook([("A", 1, "1"), ("C", 1, "3"), ("A", 2, "C"), ("C", 2, "D")]))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    found = files.read_files(spark, str(tmp_path))
    assert {r.kind for r in found.collect()} == {"sheet"}
    cells = files.read_cells(found)
    assert cells.where("error is not null").count() == 1
    lines = keys.sheet_lines(cells.where("error is null").withColumn("exam_id", F.lit(1)))
    text = lines.groupBy("exam_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text")).withColumn("expected", F.lit(4))
    got = {r.number: list(r.letters) for r in keys.parse_keys(text).where("outcome = 'read'").collect()}
    assert got == {1: ["C"], 3: ["D"]}


def test_missing_numbers_take_one_pass_over_the_keys(spark):
    rows = [(1, None, "1-A\n3) B"), (2, 3, "2: C   1\tÉ"), (3, 2, ""), (4, None, None), (5, 2, "7 A"), (None, 2, "1 A"), (6, 3, "3 A e B  2 ANULADA\n1 – D"), (7, None, "2 A\n2 B")]
    exams = spark.createDataFrame(rows, "exam_id long, expected int, text string")
    parsed = keys.parse_keys(exams)
    found = keys.missing_numbers(parsed, exams.select("exam_id", "expected"))
    got = {}
    for r in found.collect():
        got.setdefault(r.exam_id, set()).add(r.number)
    assert got == {1: {2}, 2: {3}, 3: {1, 2}, 5: {1, 2}, None: {1, 2}}
    assert {(r.exam_id, r.number): list(r.letters) for r in parsed.where("outcome = 'read' and exam_id in (2, 6)").collect()} == {(2, 1): ["E"], (2, 2): ["C"], (6, 1): ["D"], (6, 2): [], (6, 3): ["A", "B"]}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(split") == 1  # keys are parsed once


def test_lines_of_many_pages_follow_the_running_mean(spark):
    """Pages with drifting lines, whose centres lie within no single slack, against a plain loop; many pages go
    through one call."""
    r, rows = random.Random(9), []
    for doc, page in itertools.product([None, 1, 2], range(40)):
        y = 0.0
        for k in range(r.randrange(1, 60)):
            y += r.choice([0.0, 0.3, 1.7, 4.9, 5.0, 5.1, 30.0])
            rows.append((doc, page, r.randrange(400) * 1.0, y, 0.0, y + r.choice([0.0, 10.0, 10.0, 12.0]), r.choice([None, f"w{k}"]), 9.0 + k % 2, k % 3 > 0, r.choice([0, 0, 1, None])))
    r.shuffle(rows)

    def plain(page):
        heights = sorted(f[5] - f[3] for f in page if f[5] > f[3])
        slack, lines = max(0.5 * (heights[len(heights) // 2] if heights else 10.0), 1.0), []
        centre = lambda f: (f[3] + f[5]) / 2
        for f in sorted((f for f in page if f[9] is not None), key=lambda f: (f[9], centre(f), f[2], f[6] is not None, f[6])):
            if lines and lines[-1][0][9] == f[9] and abs(centre(f) - sum(map(centre, lines[-1])) / len(lines[-1])) <= slack:
                lines[-1].append(f)
            else:
                lines.append([f])
        out = sorted(lines, key=lambda x: (x[0][9], min(f[3] for f in x)))
        for seq, x in enumerate(out):
            w = [f[6] or "" for f in sorted(x, key=lambda f: f[2])]
            yield (x[0][0], x[0][1], x[0][9], seq, min(f[2] for f in x), min(f[3] for f in x), max(f[5] for f in x), " ".join(w), w[0], " ".join(w[1:]), max(f[7] for f in x), all(f[8] for f in x))

    pages = {}
    for f in rows:
        pages.setdefault(f[:2], []).append(f)
    want = [x for p in pages.values() for x in plain(p)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, col int")
    got = layout.fuse_lines(frame).select("doc_id", "page", "col", "seq", "x0", "y0", "y1", "text", "first_fragment", "others", "size", "bold").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert layout.fuse_lines(frame.limit(0)).count() == 0
    assert "FlatMapGroupsInPandas" not in layout.fuse_lines(frame)._jdf.queryExecution().toString()  # no call for each page


def test_a_workbook_is_read_without_being_held(spark):
    book = layout_queries._workbook(((str(k), f"name {k} <b>") for k in range(30_000)), False)
    tracemalloc.start()
    n = sum(1 for _ in files.workbook_cells(book))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 4_000_000
    broken = layout_queries._workbook(iter([("1", "a"), ("2", "b")]), True)
    with zipfile.ZipFile(io.BytesIO(broken)) as z, zipfile.ZipFile(out := io.BytesIO(), "w") as w:
        for name in z.namelist():
            w.writestr(name, z.read(name).replace(b"<v>3</v>", b"<v>9</v>"))
    rows = [("good", book), ("broken", out.getvalue()), ("none", b"no archive")]
    got = files.read_cells(spark.createDataFrame(rows, "path string, content binary").coalesce(1), many=7)
    counts = {r.path: (r.cells, r.errors) for r in got.groupBy("path").agg(F.count("value").alias("cells"), F.count("error").alias("errors")).collect()}
    assert counts == {"good": (60_000, 0), "broken": (0, 1), "none": (0, 1)}


def test_model_votes(spark):
    class Fixed:  # defined here, so that workers get it by value
        def ask(self, prompt, round_no):
            if prompt == "down":
                raise OSError("no server")
            return ["The answer is C.", "C", "?", "b", "C"][round_no]

    prompts = spark.createDataFrame([(1, "q"), (2, "down")], "item long, prompt string")
    assert sorted(tuple(r) for r in models.infer_answers(prompts, Fixed).collect()) == [(1, "C", 0.6, "suggested"), (2, None, None, "discarded")]
    rounds = models.ask_rounds(prompts.where("item = 1"), Fixed, 5, (r"\b([A-E])\b", 2))
    assert [r.raw for r in rounds.orderBy("round").collect()] == ["The answer is C.", "C"]  # two votes for C are enough


def test_a_server_that_dies_ends_the_batch(spark):
    class Dying:
        def ask(self, prompt, round_no):
            if prompt == "q3":
                raise ConnectionError("gone")
            return "A"

    prompts = spark.createDataFrame([(k, f"q{k}") for k in range(1, 7)], "item long, prompt string").coalesce(1)
    got = {r.item: r.outcome for r in models.infer_answers(prompts, Dying).collect()}
    assert got == {1: "suggested", 2: "suggested", 3: "not asked", 4: "not asked", 5: "not asked", 6: "not asked"}


def servers():
    """Stand-ins for model servers, made here so that workers get them by value."""

    class Ready:
        def models(self):
            return ["small"]

        def ask(self, prompt, round_no):
            return "2"

    class Down(Ready):
        def models(self):
            raise OSError("refused")

    return Ready, Down


def small_bank(spark):
    rows = {
        "exams": [(1, "e1", "I", "T", 2020, "h", "processado", None, None)],
        "topics": [(1, "Heart", "heart", None, True), (2, "Valves", "valves", 1, True), (3, "Brain", "brain", None, True)],
        "questions": [(k, f"u{k}", 1, k, None, s, None, None, 1.0, None, False, True, None) for k, s in ((10, "the heart beats"), (11, "brain and heart heart heart"), (12, "nothing here"))],
        "options": [(100 * k + j, k, "AB"[j], f"option {j}", j) for k in (10, 11, 12) for j in range(2)],
        "keys": [(k, k, "ausente", None, None) for k in (10, 11, 12)],
        "key_letters": [], "links": [(10, 3, 1.0, "manual", True)], "media": [],
    }
    return {t: spark.createDataFrame(rows[t], kinds) for t, kinds in bank.TABLES.items()}


def test_classification_service(spark):
    Ready, Down = servers()
    b = small_bank(spark)
    lexicon = spark.createDataFrame([("heart", "heart"), ("brain", "brain")], "slug string, term string")
    assert models.availability(Down(), "small")[0] is False and "lacks" in models.availability(Ready(), "big")[1]
    name, run, remark = classification.backend("cascade", lexicon, ["heart", "brain"], Down(), "small", Ready)
    assert name == "lexicon" and "reached" in remark
    after, report = classification.classify(b, run, exam=1)
    links = {(r.question, r.topic, r.origin, r.principal) for r in after["links"].collect()}
    assert links == {(10, 3, "manual", True), (10, 1, "ml", False), (11, 1, "ml", True)}
    assert {r.doc_id: r.outcome for r in report.collect()} == {10: "classified", 11: "classified", 12: "no suggestion"}
    _, pending = classification.classify(b, run, pending=True)
    assert {r.doc_id for r in pending.collect()} == {11, 12}
    name, run, _ = classification.backend("model", lexicon, ["heart", "brain"], Ready(), "small", Ready)
    assert name == "model" and {r.slug for r in run(classification.question_text(b).select("doc_id", "text")).collect()} == {"brain"}
    name, run, _ = classification.backend("cascade", lexicon, ["heart", "brain"], Ready(), "small", Ready)
    assert name == "cascade" and {r.doc_id: r.slug for r in run(classification.question_text(b).select("doc_id", "text")).collect()}[10] == "heart"
    with pytest.raises(ValueError):
        classification.backend("magic", lexicon, [])


def test_zero_shot_labels(spark):
    prompts = spark.createDataFrame([(1, "heart"), (2, "brain")], "item long, prompt string")
    scorer = lambda: lambda texts, labels: [[float(t in s) for s in labels] for t in texts]
    got = {(r.item, r.slug): r.share for r in models.score_labels(prompts, scorer, {"h": "about the heart", "b": "about the brain"}).collect()}
    assert got == {(1, "h"): 1.0, (1, "b"): 0.0, (2, "h"): 0.0, (2, "b"): 1.0}


def test_key_text_is_written_with_a_log_row(spark):
    b, at = small_bank(spark), F.lit("2024-01-01").cast("timestamp")
    parsed = keys.parse_keys(spark.createDataFrame([(1, None, "10 A\n11 E\n99 B\n12 NULA")], "exam_id long, expected int, text string"))
    after, applied, log = bank.apply_key_text(b, 1, parsed, at, path="key.txt")
    assert {r.question: (r.status, r.source) for r in after["keys"].collect()} == {10: ("valida", "pdf"), 11: ("ausente", None), 12: ("anulada", "pdf")}
    assert {r.number: r.outcome for r in applied.collect()} == {10: "applied", 11: "letter outside options", 12: "applied", 99: "unknown number"}
    row = log.first()
    assert (row.level, row.stage) == ("warning", "gabarito") and '"applied":2' in row.detail
    assert after["exams"].first().key_path == "key.txt"
    again, refused = bank.confirm(after, 11, ["B"])
    key = again["keys"].where("question = 11").first()
    assert (key.status, key.source, key.confidence) == ("valida", "manual", 1.0) and refused.count() == 0
    assert bank.constraint_violations(again).count() == 0


def test_writing_questions_and_constraints(spark):
    b, at = small_bank(spark), F.lit("2024-01-01").cast("timestamp")
    new = spark.createDataFrame([(20, "u20", 1, 20, None, "new one", None, None, 0.5, None, False, True, None), (21, "u10", 1, 10, None, "taken", None, None, 2.0, None, False, True, None)], bank.TABLES["questions"])
    options = spark.createDataFrame([(2000, 20, "A", "x", 0), (2001, 20, "A", "y", 1)], bank.TABLES["options"])
    after = bank.write_questions(b, new, options, at)
    assert {r.question: r.status for r in after["keys"].where("question >= 20").collect()} == {20: "ausente", 21: "ausente"}
    assert after["questions"].where("id = 20").first().content_hash == one(spark, T.content_hash(F.lit("new one"), F.lit("x"), F.lit("y")))
    rules = {(r.table, r.rule) for r in bank.constraint_violations(after).collect()}
    assert rules == {("questions", "unique uuid"), ("questions", "unique exam, number"), ("questions", "check confidence"), ("options", "unique question, letter")}


def test_schema_ledger_and_seed(spark, tmp_path):
    path = f"file://{tmp_path}/bank"
    assert sorted(bank.create_tables(spark, path)) == sorted(bank.TABLES) and bank.create_tables(spark, path) == []
    tables = bank.open_bank(spark, path)
    tree = [("Clinic", None), ("Heart", "Clinic"), ("Brain", "Clinic"), ("Surgery", None)]
    topics = bank.seed_topics(tables["topics"], tree)
    got = {r.name: r for r in topics.collect()}
    assert got["Heart"].parent == got["Clinic"].id and got["Surgery"].parent is None and len({r.id for r in got.values()}) == 4
    assert bank.seed_topics(topics, tree).count() == 4


def test_key_files_and_lines(spark, tmp_path):
    (tmp_path / "key.xlsx").write_bytes(workbook([("A", 1, "1"), ("C", 1, "3"), ("A", 2, "C"), ("C", 2, "D")]))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "key.txt").write_text("7 - B")
    found = files.read_files(spark, str(tmp_path))
    parsed, warnings = assembly.key_from_files(found, F.lit(1).cast("long"))
    assert {r.number: list(r.letters) for r in parsed.where("outcome = 'read'").collect()} == {1: ["C"], 3: ["D"], 7: ["B"]}
    assert warnings.count() == 1
    known = found.where("path like '%key.txt'").select("sha256")
    assert files.new_files(found, known).count() == 2
    lines = spark.createDataFrame([(5, 0, 0, 0, "Gabarito", "header"), (5, 0, 0, 1, "1 A", None), (5, 1, 0, 0, "2 B", None)], "doc_id long, page int, col int, seq long, text string, noise string")
    assert {r.number: list(r.letters) for r in assembly.key_from_lines(lines).collect()} == {1: ["A"], 2: ["B"]}


def test_import_log_is_written(spark, tmp_path):
    frags, sizes = fragments(spark, 3)
    path = f"file://{tmp_path}/log"
    out = assembly.Import(exam_id=3, log_path=path).run(frags, sizes)
    log = spark.read.parquet(path)
    assert [r.stage for r in log.where("level = 'info'").collect()] and log.count() == 7 and log.where("duration_ms > 0").count() == 7
    stored, rejected, counts = assembly.split_rejects(out)
    assert stored.count() == 9 and rejected.count() == 0 and counts.first().n == 9
    with pytest.raises(Exception):  # noqa: B017
        assembly.Import(log_path=path).run(frags.drop("x0"), sizes)
    assert spark.read.parquet(path).where("level = 'error'").count() == 1


def test_ranks_without_gathering(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9, None or 3)] + [("b", 2.0), ("b", None)], "k string, v double")
    got = relational.value_at(rows, ["k"], "v", {"median": F.floor(F.col("n") / 2), "last": F.col("n") - 1})
    assert {r.k: (r.median, r.last) for r in got.collect()} == {"a": (3.0, 9.0), "b": (2.0, 2.0)}


def test_sheet_agrees_with_booklet_and_no_item_comes_twice(spark):
    items = [(k, "ABCD"[i], f"text {k} {'right' if i == k % 4 else i}") for k in range(30) for i in range(4)]
    options = spark.createDataFrame(items, "item long, letter string, text string")
    reach = spark.createDataFrame([(t, k) for k in range(30) for t in (k % 3, 9)], "topic int, item long")
    answers = spark.createDataFrame([(k, ["ABCD"[k % 4]]) for k in range(30)], "item long, letters array<string>")
    pool = reach.select("item").distinct()
    booklet, sheet = assembly.generate(pool, reach, [(9, 6), (1, 4)], options, answers, 7)
    right = {(r.number, r.printed) for r in booklet.collect() if "right" in r.text}
    assert {(r.number, r.letters) for r in sheet.collect()} == right and len({n for n, _ in right}) == 10
    again, _ = selection.draw_quotas(reach, [(9, 6), (1, 4)], 7)
    assert len({r.item for r in again.collect()}) == 10


def test_scores_add_up(spark):
    rows = catalogue.lexicon_scores(spark, SF).groupBy("doc_id").agg(F.sum("score").alias("s")).collect()
    assert rows and all(abs(r.s - 1) < 1e-5 for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_equal_sql(spark, name):
    import duckdb

    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)[:19] if hasattr(v, "isoformat") else v
    mine = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in rows), key=repr)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert mine == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
