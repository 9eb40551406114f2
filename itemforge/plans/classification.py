"""Classifying the bank's questions by topic: the choice of a backend, and what is written."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.operators import models, topics, upsert
from itemforge.operators.bank import Bank

#: (doc_id, text) to (doc_id, slug, score).
Backend = Callable[[DataFrame], DataFrame]
#: How much of a question a classifier sees.
SHOWN = 1500


def question_text(bank: Bank) -> DataFrame:
    """(doc_id, text, exam) of active questions: support, statement, command and options in order, a line
    each, the first SHOWN characters."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda o: o["text"])
    options = bank["options"].groupBy(F.col("question").alias("id")).agg(F.array_join(listed, "\n").alias("__options"))
    rows = bank["questions"].where("active").join(options, "id", "left")
    return rows.select(F.col("id").alias("doc_id"), T.assemble("support", "statement", "command", "__options", limit=SHOWN).alias("text"), "exam")


def _lexicon(lexicon: DataFrame, docs: DataFrame) -> DataFrame:
    return topics.lexicon_scores(docs, lexicon).select("doc_id", "slug", "score")


def _asked(client: Callable[[], models.Client], names: list[str], docs: DataFrame) -> DataFrame:
    menu = "\n".join(f"{k}. {n}" for k, n in enumerate(names, 1))
    prompts = docs.select(F.col("doc_id").alias("item"), F.concat(F.lit(f"Topics:\n0. none\n{menu}\n"), F.col("text")).alias("prompt"))
    return models.infer_topics(prompts, client, names)


def _model(client: Callable[[], models.Client], names: list[str], docs: DataFrame) -> DataFrame:
    return _asked(client, names, docs).select(F.col("item").alias("doc_id"), "slug", F.col("share").alias("score"))


def _cascade(lexicon: DataFrame, client: Callable[[], models.Client], names: list[str], docs: DataFrame) -> DataFrame:
    scores = _lexicon(lexicon, docs)
    decided = topics.cascade(docs, scores)
    says = models.classify_cascade(docs, decided, lambda rest: _asked(client, names, rest)).where("slug IS NOT NULL")
    # What the lexicon decides keeps its other topics too.
    sure = scores.join(says.where("decision <> 'model'").select("doc_id"), "doc_id", "left_semi")
    return sure.unionByName(says.where("decision = 'model'").select("doc_id", "slug", "score"))


def backend(name: str, lexicon: DataFrame, names: list[str], server: models.Server | None = None, model: str = "", client: Callable[[], models.Client] | None = None) -> tuple[str, Backend, str]:
    """(name in use, backend, remark) of `lexicon`, `model` or `cascade`. A model that cannot be asked
    degrades to the lexicon, and the remark says why; an unknown name raises."""
    if name not in ("lexicon", "model", "cascade"):
        raise ValueError(f"no backend {name}")
    if name != "lexicon":
        ready, remark = models.availability(server, model) if server and client else (False, "No model server is set.")
        if ready:
            return name, partial(_model, client, names) if name == "model" else partial(_cascade, lexicon, client, names), remark
        return "lexicon", partial(_lexicon, lexicon), remark
    return name, partial(_lexicon, lexicon), ""


def classify(bank: Bank, classifier: Backend, exam: int | None = None, question: int | None = None, pending: bool = False, low: float = 0.45) -> tuple[Bank, DataFrame]:
    """(bank, report) after the questions of an exam, one question, those without a topic, or all were
    classified. The best topic and up to two more from 0.45 on are written as origin `ml`; manual links
    stay. report(doc_id, outcome) says `classified`, `low confidence` or `no suggestion`."""
    docs = question_text(bank)
    if exam is not None:
        docs = docs.where(F.col("exam") == exam)
    if question is not None:
        docs = docs.where(F.col("doc_id") == question)
    if pending:
        docs = docs.join(bank["links"].select(F.col("question").alias("doc_id")), "doc_id", "left_anti")
    found = topics.top_topics(classifier(docs.select("doc_id", "text")))
    ids = bank["topics"].where("active").select("slug", F.col("id").alias("topic"))
    incoming = found.join(ids, "slug").select(F.col("doc_id").alias("item"), "topic", "score")
    links = bank["links"].select(F.col("question").alias("item"), "topic", "score", "origin", F.col("principal").cast("int").alias("principal"))
    new = upsert.replace_by_origin(links, incoming, "ml").select(F.col("item").alias("question"), "topic", "score", "origin", (F.col("principal") == 1).alias("principal"))
    best = incoming.groupBy("item").agg(F.max("score").alias("best"))
    outcome: Column = F.when(F.col("best").isNull(), "no suggestion").when(F.col("best") < low, "low confidence").otherwise("classified")
    report = docs.join(best, F.col("doc_id") == F.col("item"), "left").select("doc_id", outcome.alias("outcome"))
    return bank | {"links": new}, report
