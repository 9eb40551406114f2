"""Topic scoring by a weighted lexicon, selection of topics, and the cascade to a dearer model."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions import text as T


def weights(lexicon: DataFrame) -> DataFrame:
    """(slug, term, weight): one over the number of topics that list the term, over the whole
    lexicon."""
    rows = lexicon.select("slug", "term").distinct()
    return rows.join(rows.groupBy("term").agg((1.0 / F.count("*")).alias("weight")), "term").select("slug", "term", "weight")


def lexicon_scores(docs: DataFrame, lexicon: DataFrame, id_column: str = "doc_id", text_column: str = "text", catalogued: list[str] | None = None) -> DataFrame:
    """(doc_id, slug, evidence, score) of every topic with hits; the scores of a document add up to 1.

    One pass over the folded text finds the longest term at each place where one begins a word, by a
    pattern in which terms share their beginnings; all others that begin there begin that one too, so
    their hits follow from its. The documents neither move nor multiply before they are counted. The
    lexicon is a parameter of some thousand terms, and its rows go to the driver to build the pattern.
    """
    by_term: dict[str, list[tuple[str, float]]] = {}
    for r in weights(lexicon).collect():
        if catalogued is None or r.slug in catalogued:
            by_term.setdefault(r.term, []).append((r.slug, r.weight))
    folded = docs.select(F.col(id_column).alias("doc_id"), T.normalize(F.col(text_column)).alias("folded"))
    if not by_term:
        return folded.select("doc_id", F.lit("").alias("slug"), F.lit(0.0).alias("evidence"), F.lit(0.0).alias("score")).limit(0)
    terms = folded.select("doc_id", T.longest_terms(F.col("folded"), list(by_term)).alias("terms"))
    # Each distinct term found, how often it stands there, and all that begin it, by one look at a map.
    ordered, reach, open_terms = sorted(by_term), {}, []
    for t in ordered:  # in this order a term comes after all that begin it
        while open_terms and not t.startswith(open_terms[-1]):
            open_terms.pop()
        open_terms.append(t)
        reach[t] = list(open_terms)
    entry = "array<struct<slug:string,weight:double,term:string>>"
    lookup = F.from_json(F.lit(json.dumps({t: [{"slug": s, "weight": w, "term": x} for x in reach[t] for s, w in sorted(by_term[x])] for t in ordered})), f"map<string,{entry}>")
    each = F.transform(F.array_distinct("terms"), lambda t: F.struct((F.size("terms") - F.size(F.array_remove("terms", t))).alias("n"), F.try_element_at(lookup, t).alias("topics")))
    counted = terms.select("doc_id", F.explode(each).alias("h"))
    hits = counted.select("doc_id", F.col("h.n").alias("n"), F.explode("h.topics").alias("t")).groupBy("doc_id", F.col("t.slug").alias("slug"), F.col("t.term").alias("term")).agg(F.sum("n").alias("hits"), F.first("t.weight").alias("weight"))
    found = hits.select("doc_id", F.struct("slug", "weight", "hits").alias("h"))
    evidence = found.groupBy("doc_id", F.col("h.slug").alias("slug")).agg(F.sum(F.col("h.weight") * (1 + 0.25 * (F.col("h.hits") - 1))).alias("evidence"))
    share = F.col("evidence") / F.sum("evidence").over(Window.partitionBy("doc_id"))
    return evidence.select("doc_id", "slug", F.round("evidence", 6).alias("evidence"), F.round(share, 6).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "slug")))


def top_topics(scores: DataFrame, threshold: float = 0.45, most: int = 3) -> DataFrame:
    """The best topic always, and others from the threshold on, `most` in all."""
    return ranked(scores).where(((F.col("rank") == 1) | (F.col("score") >= threshold)) & (F.col("rank") <= most))


def cascade(docs: DataFrame, scores: DataFrame, threshold: float = 0.45, margin: float = 2.0, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, slug, score, decision): `lexicon` when its best topic has the threshold's share, stands
    alone, or leads by the margin; else `model` for one that has to be asked, or `none` without hits."""
    best = ranked(scores).where("rank <= 2").groupBy("doc_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("slug", "score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )
    met = docs.select(F.col(id_column).alias("doc_id")).join(best, "doc_id", "left")
    sure = (F.col("first.score") >= threshold) | F.col("second").isNull() | (F.col("first.score") >= margin * F.col("second"))
    decision = F.when(F.col("first").isNull(), "none").when(sure, "lexicon").otherwise("model")
    return met.select("doc_id", F.col("first.slug").alias("slug"), F.col("first.score").alias("score"), decision.alias("decision"))


def vote_share(votes: DataFrame, keys: list[str], choice: Column, valid_only: bool) -> DataFrame:
    """(keys, choice, share): the most frequent choice, ties by its name, and its share of all rounds
    or of the valid ones."""
    counted = votes.withColumn("choice", choice).groupBy(*keys, "choice").agg(F.count("*").alias("n"))
    total = F.sum("n") if not valid_only else F.sum(F.when(F.col("choice").isNotNull(), F.col("n")))
    best = F.max(F.when(F.col("choice").isNotNull(), F.struct(F.col("n"), F.translate("choice", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ZYXWVUTSRQPONMLKJIHGFEDCBAzyxwvutsrqponmlkjihgfedcba").alias("late"), "choice")))
    rows = counted.groupBy(*keys).agg(best.alias("b"), total.alias("total"))
    return rows.select(*keys, F.col("b.choice").alias("choice"), F.round(F.col("b.n") / F.col("total"), 3).alias("share"))
