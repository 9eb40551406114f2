"""Admission, interval joins, draws of many exams, the index of words, the hash filter, import gates,
segmentation and the exam store, against brute force and small cases."""

import hashlib
import random
import subprocess
import sys
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import admission, bank, intervals, known_hashes, layout, relational, search_index, selection, topics
from itemforge.plans import assembly
from itemforge.sources import files, shared
from itemforge.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Admission


def sequential(rows, stored):
    """Row after row: (id, broken, blocker)."""
    held, out = {("hash", h): None for h in stored}, []
    for id_, h, exam, number, confidence, parent in rows:
        if confidence is not None and not 0 <= confidence <= 1:
            out.append((id_, "check confidence", None))
        elif parent is not None and parent > 3:
            out.append((id_, "reference parent", None))
        else:
            mine = [("hash", h)] * (h is not None) + [("place", (exam, number))] * (exam is not None and number is not None)
            hit = next((k for k in mine if k in held), None)
            out.append((id_, hit and f"unique {hit[0]}", hit and held[hit]))
            if hit is None:
                held |= {k: id_ for k in mine}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_admission_equals_row_after_row(spark, seed):
    r = random.Random(seed)
    maybe = lambda x: r.choice([x, x, x, None])
    rows = [(k, maybe(r.choice("abcdefgh") * r.randint(1, 4)), maybe(r.randint(1, 3)), maybe(r.randint(1, 12)), maybe(r.choice([0.5, 0.5, 2.0])), maybe(r.randint(1, 4))) for k in range(120)]
    kinds = "id long, hash string, exam long, number int, confidence double, parent long"
    rules = admission.Rules({"confidence": "confidence BETWEEN 0 AND 1"}, [("parent", spark.createDataFrame([(1,), (2,), (3,)], "key long"), "key")], {"hash": (["hash"], None), "place": (["exam", "number"], "number IS NOT NULL")})
    stored = spark.createDataFrame([(0, "aa", None, None, None, None), (0, "b", None, None, None, None)], kinds)
    shuffled = spark.createDataFrame(r.sample(rows, len(rows)), kinds).repartition(5).withColumn("rule", F.lit(1))
    got = admission.admit(shuffled, ["id"], rules, stored, "id")
    assert sorted(map(tuple, got.select("id", "broken", "blocker").collect())) == sorted(sequential(rows, ["aa", "b"]))


def test_admission_follows_a_chain_and_takes_a_hot_key_once(spark):
    # Each row shares one key with the row before: every other one is taken, since a refused row holds no key.
    chain = [(k, f"x{(k + 1) // 2}", f"y{k // 2}") for k in range(30)]
    rules = admission.Rules({}, [], {"a": (["a"], None), "b": (["b"], None)})
    got = admission.admit(spark.createDataFrame(chain, "id long, a string, b string"), ["id"], rules, name="id").collect()
    assert {x.id for x in got if x.broken is None} == set(range(0, 30, 2))
    hot = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"), F.lit(None).cast("string").alias("b"))
    got = admission.admit(hot, ["id"], rules, name="id")
    assert got.where("broken = 'unique a' AND blocker = 0").count() == 666 and got.where("broken IS NULL").count() == 1334
    assert admission.admit(hot.limit(0), ["id"], rules, hot).count() == 0


def small_bank(spark):
    empty = {t: spark.createDataFrame([], kinds) for t, kinds in bank.TABLES.items()}
    questions = [(k, f"u{k}", 1, k, None, f"question {k}", None, None, 0.9, None, False, True, None) for k in (1, 2, 3)]
    return empty | {
        "exams": spark.createDataFrame([(1, "e", None, "t", 2020, "h", "processado", None, None)], bank.TABLES["exams"]),
        "questions": spark.createDataFrame(questions, bank.TABLES["questions"]),
        "options": spark.createDataFrame([(10 * q + k, q, "AB"[k], f"o{k}", k) for q in (1, 2, 3) for k in (0, 1)], bank.TABLES["options"]),
        "keys": spark.createDataFrame([(7, 1, "ausente", None, None), (5, 2, "ausente", None, None)], bank.TABLES["keys"]),
    }


def at():
    return F.lit("2024-01-01").cast("timestamp")


def test_questions_are_stored_but_for_those_that_break_a_rule(spark):
    b = small_bank(spark)
    b = b | {"questions": bank.content(b["questions"], b["options"]).select(*b["questions"].columns)}
    base = (None, None, None, 0.5, None, False, True, None)
    new = [(20, "u20", 1, 20, None, "new", *base[1:]), (21, "u1", 1, 21, None, "uuid taken", *base[1:]), (22, "u22", 1, 3, None, "number taken", *base[1:]), (23, "u23", 9, 1, None, "no such exam", *base[1:]), (24, "u24", 1, 24, None, "NEW", *base[1:]), (25, "u25", 1, 22, None, "number of a refused row", *base[1:]), (26, "u26", 1, None, None, None, *base[1:]), (27, "u27", 1, None, None, None, *base[1:])]
    options = [(200 + k, k, "A", "x", 0) for k in (20, 24)]
    after, verdicts = bank.admit_questions(b, spark.createDataFrame(new, bank.TABLES["questions"]), spark.createDataFrame(options, bank.TABLES["options"]), ["id"], at())
    broken = {x.id: (x.broken, x.blocker) for x in verdicts.collect()}
    assert broken == {20: (None, None), 21: ("unique uuid", None), 22: ("unique exam, number", None), 23: ("reference exam", None), 24: ("unique text", 20), 25: (None, None), 26: (None, None), 27: (None, None)}
    assert {x.id for x in after["questions"].collect()} == {1, 2, 3, 20, 25, 26, 27}
    assert bank.constraint_violations(after).count() == 0
    assert {x.id for x in after["keys"].collect()} == {5, 7, 8, 9, 10, 11}
    again, verdicts = bank.admit_questions(b, spark.createDataFrame(new, bank.TABLES["questions"]), spark.createDataFrame(options, bank.TABLES["options"]), ["id"], at(), known_texts=False)
    assert verdicts.where("id = 24 AND broken IS NULL").count() == 1


def test_bank_writes_refuse_what_has_no_question(spark):
    b = small_bank(spark)
    changes = spark.createDataFrame([(1, " ", "blank"), (1, "b)", "second"), (1, "c", "third"), (999, "A", "orphan")], "question long, letter string, text string")
    after = bank.correct_options(b, changes, at())
    assert {(x.letter, x.text) for x in after["options"].where("question = 1").collect()} == {("A", "o0"), ("B", "second"), ("C", "third")}
    assert after["options"].where("question = 999 OR letter = ''").count() == 0
    answers = spark.createDataFrame([(2, ["A"], 1.0), (3, ["B"], 1.0), (999, ["A"], 1.0)], "question long, letters array<string>, confidence double")
    done, refused = bank.define_keys(b, answers, "manual")
    assert {(x.id, x.question, x.status) for x in done["keys"].collect()} == {(7, 1, "ausente"), (5, 2, "valida"), (8, 3, "valida")}
    assert [(x.question, x.letter) for x in refused.collect()] == [(999, None)]
    assert bank.constraint_violations(done).count() == 0
    twice = done | {"keys": done["keys"].union(done["keys"].where("id = 7"))}
    assert {(x.table, x.rule) for x in bank.constraint_violations(twice).collect()} == {("keys", "unique id"), ("keys", "unique question")}


def test_inactive_questions_are_found_in_the_wide_base(spark):
    b = small_bank(spark)
    b = b | {"questions": b["questions"].withColumn("active", F.col("id") != 2)}
    assert {x.id for x in bank.matching(bank.read_model(b), b, text="question").collect()} == {1, 2, 3}


def test_manual_topics_may_stand_beside_and_go(spark):
    links = spark.createDataFrame([(1, 5, 0.9, "ml", True), (2, 5, 0.9, "ml", True)], bank.TABLES["links"])
    got = bank.set_topics(links, spark.createDataFrame([(1, 6, False), (2, 7, True)], "question long, topic long, principal boolean"))
    assert {(x.question, x.topic, x.principal) for x in got.collect()} == {(1, 5, True), (1, 6, False), (2, 5, False), (2, 7, True)}
    assert bank.remove_topics(got, spark.createDataFrame([(1, 5), (3, 5)], "question long, topic long")).count() == 3


# Intervals


def test_interval_joins_equal_brute_force(spark):
    r = random.Random(3)
    left = [(r.randint(0, 3), k, x := r.uniform(-50, 300), x + r.choice([0, 1, 30, 400, -5])) for k in range(200)] + [(0, 999, None, 4.0)]
    right = [(r.randint(0, 3), k, x := float(r.randint(-60, 300)), x + r.choice([0, 10, 100, 500])) for k in range(60)]
    a, b = spark.createDataFrame(left, "g int, a long, a0 double, a1 double"), spark.createDataFrame(right, "g int, b long, b0 double, b1 double")
    met = intervals.overlapping(a, b, ["g"], ("a0", "a1"), ("b0", "b1"), 40.0)
    want = sorted((x[1], y[1]) for x in left for y in right if None not in x and x[0] == y[0] and x[2] <= x[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((x.a, x.b) for x in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    points = intervals.containing(a, b, ["g"], "a0", ("b0", "b1"), 40.0)
    assert sorted((x.a, x.b) for x in points.collect()) == sorted((x[1], y[1]) for x in left for y in right if None not in x and x[0] == y[0] and y[2] <= x[2] < y[3])


def test_fragments_take_the_column_they_begin_in_when_they_cross(spark):
    columns = [(1, 0, k, 10.0 + 190 * k, 190.0 + 190 * k) for k in range(3)]
    boxes = [("left", 20.0, 100.0), ("middle", 210.0, 300.0), ("wide", 20.0, 560.0), ("from the second", 250.0, 560.0), ("gap", 190.0, 200.0), ("beyond", 700.0, 800.0), ("point", 205.0, 205.0)]
    frags = spark.createDataFrame([(1, 0, x0, 1.0, x1, 2.0, t) for t, x0, x1 in boxes] + [(2, 0, 300.0, 1.0, 400.0, 2.0, "no columns")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {x.text: x.col for x in layout.assign_to_columns(frags, spark.createDataFrame(columns, "doc_id long, page int, col int, left double, right double")).collect()}
    assert got == {"left": 0, "middle": 1, "wide": 0, "from the second": 1, "gap": 2, "beyond": 2, "point": 1, "no columns": 0}


# Draws


@pytest.mark.parametrize("seed", range(3))
def test_many_exams_equal_one_after_another(spark, seed):
    r = random.Random(seed)
    reach = sorted({(r.randint(0, 7), r.randint(0, 60)) for _ in range(160)})
    quotas = [(e, 100 + e, t, r.choice([0, 1, 3, 20]), k) for e in range(25) for k, t in enumerate(r.sample(range(9), 4))]
    picked, short = selection.draw_many(spark.createDataFrame(reach, "topic int, item long"), spark.createDataFrame(quotas, "exam long, seed long, topic int, wanted int, place int"))
    want, missing = [], []
    for e in range(25):
        mine = [q for q in quotas if q[0] == e and q[3] > 0]
        taken = set()
        for _, s, t, n, _ in sorted(mine, key=lambda q: (sum(x == q[2] for x, _ in reach), q[4])):
            items = sorted((i for x, i in reach if x == t and i not in taken), key=lambda i: (hashlib.sha256(f"{s}:{i}".encode()).hexdigest(), i))[:n]
            taken |= set(items)
            want += [(e, t, i, k + 1) for k, i in enumerate(items)]
            if len(items) < n:
                missing.append((e, t, n, len(items)))
    assert sorted(map(tuple, picked.collect())) == sorted(want)
    assert sorted(map(tuple, short.collect())) == sorted(missing)


def test_more_exams_take_no_more_jobs(spark):
    reach = spark.range(300).select((F.col("id") % 5).alias("topic"), (F.col("id") % 97).alias("item"))

    def jobs(n):
        quotas = spark.range(n).select(F.col("id").alias("exam"), F.col("id").alias("seed"), F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("topic"), F.lit(4).alias("wanted"), F.lit(t).alias("place")) for t in range(4)])).alias("q")).select("exam", "seed", "q.*")
        spark.sparkContext.setJobGroup(f"draw {n}", "draw")
        selection.draw_many(reach, quotas)[0].count()
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"draw {n}")
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(found)

    assert jobs(1000) <= jobs(3) + 40


def test_a_draw_keeps_few_of_the_pairs_and_looks_again_where_they_are_too_few(spark, monkeypatch):
    reach = spark.range(6000).select((F.col("id") % 2).alias("topic"), F.col("id").alias("item"))
    quotas = spark.range(40).select(F.col("id").alias("exam"), F.col("id").alias("seed"), F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("topic"), F.lit(5).alias("wanted"), F.lit(t).alias("place")) for t in (0, 1, 9)])).alias("q")).select("exam", "seed", "q.*")
    asked, pairs = selection._asked(reach, quotas)
    kept = selection._first_items(asked, pairs, F.col("share"))
    assert 40 * 15 <= kept.count() <= 40 * 6000 / 20  # of 240,000 pairs
    want = [sorted(map(tuple, x.collect())) for x in selection.draw_many(reach, quotas)]
    monkeypatch.setattr(selection, "_SPARE", -0.4)  # about half of the quotas find too few at first
    monkeypatch.setattr(selection, "_ITEMS", 700)
    monkeypatch.setattr(selection, "_QUOTAS", 9)
    assert [sorted(map(tuple, x.collect())) for x in selection.draw_many(reach, quotas)] == want
    assert len(want[0]) == 400 and len(want[1]) == 40


def test_shortfall_draws_exams_with_a_small_topic_only(spark, monkeypatch):
    reach = spark.createDataFrame([(t, i) for t, n in ((0, 90), (1, 4)) for i in range(n)], "topic int, item long")
    quotas = spark.createDataFrame([(e, e, t, 3, k) for e in range(12) for k, t in enumerate((0, 1) if e < 2 else (0,))] + [(5, 5, 7, 1, 1)], "exam long, seed long, topic int, wanted int, place int")
    want = sorted(map(tuple, selection.draw_many(reach, quotas)[1].collect()))
    drawn, draw = [], selection.draw_many
    monkeypatch.setattr(selection, "draw_many", lambda r, q: drawn.extend(x.exam for x in q.collect()) or draw(r, q))
    assert sorted(map(tuple, selection.shortfall(reach, quotas).collect())) == want and (5, 7, 1, 0) in want
    assert set(drawn) == {5}


# The index of words


def test_index_finds_what_a_scan_finds_and_grows(spark, tmp_path):
    r = random.Random(1)
    vocabulary = ["ácido", "acidos", "heart", "hearts", "he", "h", "x1", "état", "ёлка", "a-b", "don't", "日本", "B12", "é"]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 6)))) for k in range(300)] + [(400, None), (70_000, "heart ácido"), (None, "heart")]
    df = spark.createDataFrame(docs, "id long, text string").withColumn("token", F.lit(1))
    path = f"file://{tmp_path}/index"
    first = df.where("id < 100")
    search_index.append(search_index.absent(first, spark, path), path)
    search_index.append(search_index.absent(df, spark, path), path)
    index = search_index.open_index(spark, path)
    assert search_index.absent(df, spark, path).where("id IS NOT NULL AND text <> '' ").count() == 0
    for query in ("heart", "he ac", "h", '"a" h', "don't", "a-b heart", "x1 b1", "ел", "日", "nothing", "", "-", "É", "heart heart he"):
        want = sorted(x.id for x in df.where("id IS NOT NULL").where(T.matches_all(F.col("text"), query)).collect())
        assert sorted(x.id for x in search_index.find(index, df, query).collect()) == want, query
    plan = search_index.candidates(index, [["heart"]])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(head" in plan and "PushedFilters: []" not in plan


# The filter of hashes


def test_hash_filter_loses_nothing_and_false_hits_are_told_apart(spark):
    known = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    rows = spark.range(250, 1000).select("id", F.when(F.col("id") % 50 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    for blocks, bits in ((1, 1), (64, 6)):
        made = relational.cut(known_hashes.build(known, blocks=blocks, bits=bits))
        tested = known_hashes.maybe_known(rows, made, blocks=blocks, bits=bits)
        assert tested.where("id < 500 AND hash IS NOT NULL AND NOT maybe").count() == 0
        false = tested.where("id >= 500 AND maybe").count()
        assert false > 50 if blocks == 1 else false < 5
        got = known_hashes.unknown(rows, made, known, blocks=blocks, bits=bits)
        assert {x.id for x in got.collect()} == {k for k in range(250, 1000) if k >= 500 or k % 50 == 0}
    halves = [known_hashes.build(known.where(c), blocks=64) for c in ("hash < '8'", "hash >= '8'")]
    words = lambda df: {x.block: list(x.words) for x in df.collect()}
    assert words(known_hashes.merged(*halves)) == words(known_hashes.build(known, blocks=64))
    none = known_hashes.build(known.limit(0), blocks=64)
    assert none.count() == 0 and known_hashes.unknown(rows, none, known.limit(0), blocks=64).count() == 750


# Segmentation and import


def paper(spark, questions, number=lambda n: f"{n}.", letter=lambda k: f"{'ABCDE'[k]})", doc=1):
    """Lines of (number, options) questions, forty points each."""
    rows, y = [], 70.0
    for n, options in questions:
        lines = [(8.0, number(n), f"This is the statement of question number {n}")] + [(20.0, letter(k), f"option {k}") for k in range(options)]
        for x, first, others in lines:
            rows.append((doc, 0, 0, len(rows), x, y, f"{first} {others}", first, others))
            y += 12
    return spark.createDataFrame(rows, "doc_id long, page int, col int, seq long, x0 double, y0 double, text string, first_fragment string, others string")


def test_numbers_and_letters_have_a_census_each(spark):
    got = layout.segment(paper(spark, [(n, 4) for n in range(1, 7)], letter=lambda k: "ABCDE"[k])).collect()
    assert [len(q.options) for q in got] == [4] * 6 and all(q.confidence == 1.0 for q in got)


def test_a_jump_is_a_warning_of_the_document_and_costs_nothing(spark):
    lines = paper(spark, [(n, 4) for n in (1, 2, 4, 5)]).union(paper(spark, [(3, 4), (4, 4)], doc=2)).union(paper(spark, [(1, 4)], number=lambda n: "x", doc=3))
    assert {q.confidence for q in layout.segment(lines).collect()} == {1.0}
    assert {tuple(w) for w in layout.segment_warnings(lines).collect()} == {(1, "jump", 2, 4), (2, "late start", None, 3), (3, "no questions", None, None)}


def test_questions_without_options_are_no_pattern(spark):
    got = {q.number: q for q in layout.segment(paper(spark, [(n, 0) for n in range(1, 6)] + [(6, 5)])).collect()}
    assert got[6].confidence == 1.0 and not got[6].remarks and got[1].confidence == 0.4


def test_options_out_of_order_are_remarked():
    assert layout.losses("x" * 30, [("A", "one"), ("C", "two"), ("B", "three"), ("D", "four")], 1) == (0.2, ["option letters out of order"])


def test_longest_chain_equals_the_quadratic_one():
    r = random.Random(2)
    for _ in range(300):
        numbers = [r.randint(1, 25) for _ in range(r.randint(0, 30))]
        best, back = [1] * len(numbers), [-1] * len(numbers)
        for i, n in enumerate(numbers):
            for j in range(i):
                if 0 < n - numbers[j] <= 5 and best[j] + 1 > best[i]:
                    best[i], back[i] = best[j] + 1, j
        at, want = max(range(len(numbers)), key=lambda i: best[i], default=-1), []
        while at >= 0:
            want.append(at)
            at = back[at]
        assert layout.longest_chain(numbers) == want[::-1]


def test_a_band_over_the_budget_is_reported(spark):
    rows = []
    for page in range(4):
        for k, (y, text) in enumerate([(20.0, "Header line one"), (40.0, "Header two"), *[(100.0 + 40 * k, f"body {'abcd'[page]}{'abcd'[k]}") for k in range(4)], (800.0, f"{page}")]):
            rows.append((1, page, 0, k, 20.0, y, 300.0, y + 10, text, text.split()[0], " ".join(text.split()[1:]), 9.0, False))
    lines = spark.createDataFrame(rows, layout._LINES)
    pages = spark.createDataFrame([(1, p, 595.0, 842.0) for p in range(4)], "doc_id long, page int, width double, height double")
    got = {x.key: x for x in layout.recurrence_report(lines, pages).collect()}
    assert {k: x.verdict for k, x in got.items() if x.verdict != "body"} == {"header line one": "noise", "#": "over budget"} or got["#"].verdict in ("noise", "over budget")
    assert sum(x.n for x in got.values() if x.verdict == "noise") <= len(rows) * layout.BUDGET
    assert [x.place for x in sorted(got.values(), key=lambda x: (-x.n, x.key))] == list(range(1, len(got) + 1))


def test_noise_is_told_without_a_second_join_of_the_lines(spark):
    # A budget of a quarter takes the header; each line of a page is told by its document's bands.
    rows = []
    for page in range(5):
        for k, (y, text) in enumerate([(20.0, f"Paper {page}"), *[(100.0 + 40 * k, f"body {'abcde'[page]}{'abcdef'[k]}") for k in range(6)]]):
            rows.append((1, page, 0, k, 20.0, y, 300.0, y + 10, text, text.split()[0], " ".join(text.split()[1:]), 9.0, False))
    lines = spark.createDataFrame([*rows, (2, 0, 0, 0, 20.0, 20.0, 300.0, 30.0, "Paper 9", "Paper", "9", 9.0, False)], layout._LINES)
    pages = spark.createDataFrame([(1, p, 595.0, 842.0) for p in range(5)], "doc_id long, page int, width double, height double")
    found = layout.detect_noise(lines, pages)
    assert {(x.doc_id, x.page, x.seq) for x in found.where("noise = 'header'").collect()} == {(1, p, 0) for p in range(5)} and found.count() == len(rows) + 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("seq#" in x for x in plan.splitlines() if "Join " in x)


def test_noise_broadcasts_no_documents_and_pages(spark):
    rows = []
    for doc in range(3):
        for page in range(5):
            for k, (y, text) in enumerate([(20.0, f"Paper {page}"), *[(100.0 + 40 * k, f"body {'abcde'[page]}{'abcdef'[k]}") for k in range(6)], (800.0, f"{page}")]):
                rows.append((doc, page, 0, k, 20.0, y, 300.0, y + 10, text, text.split()[0], " ".join(text.split()[1:]), 9.0, False))
    lines = spark.createDataFrame(rows, layout._LINES)
    pages = spark.createDataFrame([(d, p, 595.0, 842.0) for d in range(3) for p in range(5)], "doc_id long, page int, width double, height double")
    keyed = layout._keyed(lines)
    for found in (layout.detect_noise(lines, pages), layout.recurrence_report(lines, pages), layout._recurring(keyed, pages)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(x.doc_id, x.page, x.seq, x.noise) for x in layout.detect_noise(lines, pages).where("noise IS NOT NULL").collect()}
    assert {x[3] for x in got} == {"header", "footer"} and {x for x in got if x[3] == "header"} == {(d, p, 0, "header") for d in range(3) for p in range(5)}
    # First lines by column, then height: the second column's higher line is not a page's first.
    two = spark.createDataFrame([(1, p, c, y, 10.0, "k") for p in range(4) for c, y in ((0, 50.0 + p), (1, 20.0))], "doc_id long, page int, col int, y0 double, height double, key string")
    assert [tuple(x) for x in layout.recurrences(two).collect()] == [(1, "k", 0, 4, [0, 1, 2, 3], 51.5, 1.12)]


@pytest.mark.parametrize("seed", range(2))
def test_segments_by_arrays_equal_one_line_after_another(spark, seed):
    r = random.Random(seed)
    rows, want = [], []
    for doc in range(20):
        bare, k = r.random() < 0.3, 0
        for number in range(1, r.randint(2, 9)):
            lines = [(8.0, f"{number}.", r.choice(["Um enunciado com acentuação que basta", "A plain statement that is long enough", "short", ""]))]
            for _ in range(r.randint(0, 7)):
                letter = r.choice("ABCDE")
                lines.append(r.choice([(20.0, letter if bare else f"{letter})", r.choice(["one", "dois é", "", "____ x", "y"])), (20.0, "more", "text"), (20.0, "", "")]))
            texts = [" ".join(x for x in (a, b) if x) for _, a, b in lines]
            rest = lambda t: t.replace("____ ", "")
            marks = [a[0] if a and a[0] in "ABCDE" else None for _, a, _ in lines[1:]]
            statement, options = layout.split_options(texts[1:], marks, [rest(b) for _, _, b in lines[1:]])
            want.append((doc, number, " ".join(x for x in (lines[0][2], statement) if x), options))
            for (x, a, b), text in zip(lines, texts, strict=True):
                rows.append((doc, k // 10, 0, k, x, 70.0, text, a, b))
                k += 1
    r.shuffle(rows)
    found = layout.segment(spark.createDataFrame(rows, "doc_id long, page int, col int, seq long, x0 double, y0 double, text string, first_fragment string, others string"))
    got = [(x.doc_id, x.number, x.statement, [tuple(o) for o in x.options]) for x in found.collect()]
    strict = {d for d in range(20) if sum(x[0] == d and x[7][1:] == ")" for x in rows) >= 5}
    assert len(strict) > 5 and sorted(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" in plan and "InPandas" not in plan


def test_plain_markers_are_those_of_columns(spark):
    r = random.Random(5)
    pieces = ["1", "12", "123", "1234", "o", "O", "Questao", "quest.", "q.", " ", ".", ")", "]", ":", "-", "(", "[", "A", "b", "E", "f", "mg", "", "#"]
    texts = [x for x in {"".join(r.choice(pieces) for _ in range(r.randint(0, 6))) for _ in range(3000)} if "  " not in x and "---" not in x and "..." not in x]
    df = spark.createDataFrame([(x,) for x in texts], "a string").select("a", T.number_marker(F.col("a")).alias("number"), T.letter_marker(F.col("a")).alias("letter"), T.strong_number(F.col("a")).alias("strong"))
    for x in df.collect():
        for kind in ("number", "letter"):
            assert (x[kind] and tuple(x[kind])) == T.plain_marker(kind, x.a), (kind, x.a)
        assert x.strong == bool(x.number and x.number.strong)


def test_warnings_send_no_texts_and_letters(spark):
    lines = paper(spark, [(n, 4) for n in (2, 3, 5)])
    found = layout.segment_warnings(lines)
    assert {tuple(x)[1:] for x in found.collect()} == {("late start", None, 2), ("jump", 3, 5)}
    assert "null AS letter" in found._jdf.queryExecution().optimizedPlan().toString()


def test_markers_of_plain_lines_take_no_nested_functions(spark):
    rows = [("12.", "x"), ("o5)", ""), ("Questao 7", "tail"), ("q. 3 - b", None), ("3.5 mg", ""), ("1234.", ""), ("(c", "d"), ("b]", ""), ("Bem", ""), ("12 –", "é"), ("QUESTÃO 4 ____", "x"), (None, "x"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(T.number_marker(F.col("a"), F.col("b")).alias("n"), T.letter_marker(F.col("a"), F.col("b")).alias("l"))
    got = [(x.n and tuple(x.n), x.l and tuple(x.l)) for x in df.collect()]
    assert got == [(("12", "x", True), None), (("05", "", True), None), (("7", "tail", True), None), (("3", "b", True), None), (None, None), (None, None), (None, ("c", "d", True)), (None, ("b", "", True)), (None, None), (("12", "é", True), None), (("4", "x", True), None), (None, None), (None, None)]


def test_import_refuses_scans_and_unreadable_texts_and_writes_the_status(spark, tmp_path):
    kinds = files.FRAGMENTS
    good = [(1, p, 20.0, 80.0 + 15 * (5 * k + i), 400.0, 90.0 + 15 * (5 * k + i), t, 9.0, False, False) for p in range(2) for k in range(4) for i, t in enumerate([f"{4 * p + k + 1}. The statement of this question is long enough", "A) one", "B) two", "C) three", "D) four"])]
    scan = [(2, 0, 20.0, 80.0, 100.0, 90.0, "page 1", 9.0, False, False)]
    glyphs = [(3, 0, 20.0, 80.0 + 15 * k, 100.0, 90.0 + 15 * k, "\x19\x1a\x1b\x1c" * 10 + "!", 9.0, False, False) for k in range(8)]
    prose = [(4, 0, 20.0, 80.0 + 15 * k, 400.0, 90.0 + 15 * k, "words and words without any number at all", 9.0, False, False) for k in range(8)]
    pages = spark.createDataFrame([(d, p, 595.0, 842.0) for d, n in ((1, 2), (2, 1), (3, 1), (4, 1), (5, 1)) for p in range(n)], "doc_id long, page int, width double, height double")
    job = assembly.Import(log_path=f"file://{tmp_path}/log")
    got = job.run(spark.createDataFrame(good + scan + glyphs + prose, kinds), pages).collect()
    assert {q.doc_id for q in got} == {1} and len(got) == 8
    assert {tuple(x) for x in job.statuses.collect()} == {(1, "processado", None), (2, "erro", "no text layer"), (3, "erro", "illegible text"), (4, "erro", "no questions"), (5, "erro", "no text layer")}
    assert any(x[1] == "segment" and x[3] == "no questions" for x in job.log)
    with pytest.raises(assembly.ImportFailure) as e:
        assembly.Import().run(spark.createDataFrame(scan, kinds), pages.where("doc_id = 2"))
    assert e.value.failed.count() == 1


def test_each_stage_of_an_import_runs_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    rows = spark.range(100).mapInPandas(once, "id long")
    out, n = shared.counted(rows, "once")
    assert (n, out.count(), ran.value) == (100, 100, 100)


def test_repeats_are_recorded_on_demand_and_options_alone_are_no_text(spark):
    rows = [(1, 1, "Same", [("A", "x")]), (2, 1, "same", [("A", "X")]), (2, 2, "", [("A", "only")]), (2, 3, "", [("A", "only")]), (2, 4, None, [("A", "only")])]
    q = spark.createDataFrame(rows, "doc_id long, number int, statement string, options array<struct<letter:string,text:string>>")
    known = assembly.record(q).select("hash")
    assert [x.outcome for x in assembly.record(q, known).orderBy("doc_id", "number").collect()] == ["duplicate", "duplicate", "recorded", "recorded", "recorded"]
    assert {x.outcome for x in assembly.record(q, known, True).collect()} == {"recorded"}


def test_key_files_of_any_bytes_become_text_or_warnings(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("1 - A\n2 - ANULAÇÃO\n3 ANULADA".encode("latin-1"))
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbf9 - C")
    (tmp_path / "exam.pdf").write_bytes(b"%PDF-1.7\n\xe2\xe3\xcf\xd3")
    (tmp_path / "noise.bin").write_bytes(bytes(range(256)))
    (tmp_path / "sheet").write_bytes(b"PK\x03\x04 broken")
    found = files.read_files(spark, str(tmp_path))
    assert {x.path.rsplit("/", 1)[1]: x.kind for x in found.collect()} == {"latin.txt": "text", "mark.txt": "text", "exam.pdf": "pdf", "noise.bin": "binary", "sheet": "sheet"}
    parsed, warnings = assembly.key_from_files(found, F.lit(1).cast("long"))
    assert {x.number: list(x.letters) for x in parsed.where("outcome = 'read'").collect()} == {1: ["A"], 3: [], 9: ["C"]}
    assert {x.path.rsplit("/", 1)[1] for x in warnings.collect()} == {"exam.pdf", "noise.bin", "sheet"}


def test_stored_exams_print_alike_and_are_listed(spark, tmp_path):
    path = f"file://{tmp_path}/exams"
    options = spark.createDataFrame([(i, "ABCD"[k], f"text {i} {k}") for i in range(20) for k in range(4)], "item long, letter string, text string")
    answers = spark.createDataFrame([(i, ["ABCD"[i % 4]]) for i in range(20)], "item long, letters array<string>")
    heads = spark.createDataFrame([(1, 5, "first"), (2, 6, "second")], "id long, seed long, title string")
    picked = spark.createDataFrame([(e, i) for e in (1, 2) for i in range(3 * e, 3 * e + 7)], "exam long, item long")
    assert assembly.list_exams(assembly.open_exams(spark, path)).count() == 0
    assembly.store_exams(spark, path, heads, picked, options)
    store = assembly.open_exams(spark, path)
    assert {(x.id, x.title, x.questions) for x in assembly.list_exams(store).collect()} == {(1, "first", 7), (2, "second", 7)}
    booklet, sheet = assembly.reprint_stored(store, 2, options, answers)
    right = {(x.number, x.printed) for x in booklet.collect() if x.original == "ABCD"[x.item % 4]}
    assert {(x.number, x.letters) for x in sheet.collect()} == right and len(right) == 7
    with pytest.raises(ValueError, match="already"):
        assembly.store_exams(spark, path, heads, picked, options)


def paged(spark, doc, questions, first=1):
    rows = [(doc, 0, 20.0, 80.0 + 15 * (5 * k + i), 400.0, 90.0 + 15 * (5 * k + i), t, 9.0, False, False, 595.0, 842.0) for k, q in enumerate(questions) for i, t in enumerate([f"{first + k}. {q}, which is a statement that is long enough", "A) one", "B) two", "C) three", "D) four"])]
    return spark.createDataFrame(rows, ingest.PAGED)


def test_a_stream_that_is_killed_goes_on_and_stores_each_question_once(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    paged(spark, 1, ["heart", "brain"]).coalesce(1).write.mode("append").parquet(source)
    ingest.import_stream(spark, source, out, checkpoint, 1)
    paged(spark, 2, ["brain", "bone"]).coalesce(1).write.mode("append").parquet(source)
    whole = relational.cut

    def dies(rows):
        if "__seen" in rows.columns:
            raise RuntimeError("killed")
        return whole(rows)

    monkeypatch.setattr(ingest.relational, "cut", dies)
    with pytest.raises(Exception, match="killed"):
        ingest.import_stream(spark, source, out, checkpoint, 1)
    monkeypatch.setattr(ingest.relational, "cut", whole)
    # The batch had written its questions when it died: they are written anew.
    spark.createDataFrame([(2, 9, "half", [], 1.0, "x")], "doc_id long, number int, statement string, options array<struct<letter:string,text:string>>, confidence double, hash string").write.parquet(f"{out}/questions/batch=1")
    ingest.import_stream(spark, source, out, checkpoint, 1)
    paged(spark, 3, ["heart", "brain"]).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(4, 0, 20.0, 80.0, 400.0, 90.0, "scan", 9.0, False, False, 595.0, 842.0)], ingest.PAGED).coalesce(1).write.mode("append").parquet(source)
    ingest.import_stream(spark, source, out, checkpoint, 1)
    got = ingest.stored(spark, out, "questions").collect()
    assert sorted((q.doc_id, q.number, q.statement.split(",")[0]) for q in got) == [(1, 1, "heart"), (1, 2, "brain"), (2, 2, "bone")]
    assert {(x.doc_id, x.status, x.error) for x in ingest.stored(spark, out, "statuses").collect()} == {(1, "processado", None), (2, "processado", None), (3, "known", None), (4, "erro", "no text layer")}


def test_contents_are_ingested_once(spark, tmp_path):
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for rows in ([(1, "One"), (2, "two")], [(3, " one "), (4, "three")]):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, "id long, text string", "text", out, checkpoint)
    assert sorted(x.id for x in spark.read.parquet(out).collect()) == [1, 2, 4]


# Text


def test_marks_fall_in_every_script(spark):
    def fold(s):
        return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))

    for raw in ("ёлка й Їжак", "άλφα ΐ ᾳ ὕ", "ǰ ẛ̣ Å ᾅ", "क़ख़ ज़", "が プ", "ạ́b", "Ⅷ", "שּׁ", "क़", "ẞ", "plain", "日本"):
        assert one(spark, T.fold_accents(F.lit(raw))) == fold(raw), raw
    assert one(spark, T.fold_accents(F.lit("한글 é"))) == "한글 e"
    a, b = T.content_hash(F.lit("Ёлка ΆΛΦΑ")), T.content_hash(F.lit("елка αλφα"))
    assert one(spark, a) == one(spark, b)


def test_longest_term_by_a_trie_equals_trying_each(spark):
    r = random.Random(4)
    for _ in range(20):
        terms = list({"".join(r.choice("ab. (") for _ in range(r.randint(1, 5))) for _ in range(12)})
        text = "".join(r.choice("ab. (") for _ in range(60))
        starts = [k for k in range(len(text)) if k == 0 or not text[k - 1].isalnum()]
        want = [max((t for t in terms if text.startswith(t, k)), key=len) for k in starts if any(text.startswith(t, k) for t in terms)]
        assert one(spark, T.longest_terms(F.lit(text), terms)) == want, (terms, text)


def test_lexicon_scores_equal_counting_each_term(spark):
    r = random.Random(6)
    lexicon = [(r.choice("xyz"), "".join(r.choice("ab ") for _ in range(r.randint(1, 4))).strip() or "a") for _ in range(30)]
    docs = [(k, "".join(r.choice("ab   ") for _ in range(80))) for k in range(40)] + [(90, None), (91, "")]
    got = topics.lexicon_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lexicon, "slug string, term string"))
    pairs = set(lexicon)
    want = {}
    for k, text in docs:
        text = " ".join((text or "").split())
        for slug, term in pairs:
            hits = sum(text.startswith(term, i) and (i == 0 or text[i - 1] == " ") for i in range(len(text)))
            if hits:
                weight = 1 / len({s for s, t in pairs if t == term})
                want[k, slug] = want.get((k, slug), 0) + weight * (1 + 0.25 * (hits - 1))
    assert {(x.doc_id, x.slug): x.evidence for x in got.collect()} == pytest.approx(want, abs=1e-5)


def test_workers_get_the_package(tmp_path):
    """In a process whose workers do not have the package on their path, segmentation runs."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from itemforge.operators import layout
rows = [(1, 0, 0, 0, 8.0, 70.0, "1. statement", "1.", "statement")]
df = spark.createDataFrame(rows, "doc_id long, page int, col int, seq long, x0 double, y0 double, text string, first_fragment string, others string")
print("found", layout.segment(df).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found 1" in out.stdout, out.stderr[-2000:]
