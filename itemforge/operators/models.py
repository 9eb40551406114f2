"""Dearer models behind a plain protocol: topic votes and answers by repeated questions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.functions import text as T
from itemforge.sources import shared


class Client(Protocol):
    """Answers a prompt; round 0 is deterministic, later ones are not. A server that cannot be reached
    raises ConnectionError, a call that fails another OSError."""

    def ask(self, prompt: str, round_no: int) -> str: ...


class Server(Client, Protocol):
    def models(self) -> list[str]:
        """The names of the models that it holds; raises OSError if it cannot be reached."""
        ...


def availability(server: Server, model: str) -> tuple[bool, str]:
    """Whether a model can be asked, and a sentence that says why not."""
    try:
        names = server.models()
    except OSError as e:
        return False, f"The model server cannot be reached: {e}."
    if model not in names:
        return False, f"The server runs but lacks the model {model}; it has {', '.join(sorted(names)) or 'none'}."
    return True, f"The model {model} is ready."


ROUNDS = "item long, round int, raw string, error string"


def ask_rounds(prompts: DataFrame, client: Callable[[], Client], rounds: int, enough: tuple[str, int] | None = None) -> DataFrame:
    """ROUNDS of every prompt(item, prompt). `client` is called once in each task. A call that fails
    gives a null answer with its error; once the server cannot be reached, the task's other prompts are
    not asked, and each has one row of round -1 that says so. `enough` is (pattern, votes): an item's
    rounds end as soon as one match of the pattern's first group was given so many times."""

    def one(session: Client, item: int, prompt: str) -> Iterator[tuple]:
        given: dict[str, int] = {}
        for k in range(rounds):
            try:
                raw = session.ask(prompt, k)
            except ConnectionError:
                raise
            except OSError as e:
                yield item, k, None, str(e)
                continue
            yield item, k, raw, None
            if enough and (m := re.search(enough[0], (raw or "").upper())):
                given[m[1]] = given.get(m[1], 0) + 1
                if given[m[1]] >= enough[1]:
                    return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, down = client(), None
        for b in batches:
            out: list[tuple] = []
            for item, prompt in zip(b["item"], b["prompt"], strict=True):
                if down is None:
                    before = len(out)
                    try:
                        out.extend(one(session, item, prompt))
                        continue
                    except ConnectionError as e:
                        down = f"not asked: {e}"
                        del out[before:]
                out.append((item, -1, None, down))
            yield pd.DataFrame(out, columns=["item", "round", "raw", "error"]).astype({"round": "int32"})

    shared.ship(prompts.sparkSession)
    return prompts.select("item", "prompt").mapInPandas(run, ROUNDS)


def answer_prompt(statement, options) -> F.Column:
    """A question and its lettered options; options is an array of (letter, text)."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(") "), o["text"])), "\n")
    return T.assemble(statement, lines, F.lit("Answer with one letter."))


def answer_votes(votes: DataFrame, least: float = 0.6) -> DataFrame:
    """(item, letter, share, outcome) from ROUNDS: the most frequent letter, of equals the one given
    first, and its share of all rounds, unreadable ones too. outcome is `suggested`, `discarded` below
    the least share or without a letter, or `not asked`."""
    read = votes.withColumn("letter", T.answer_letter(F.col("raw")))
    counted = read.groupBy("item", "letter").agg(F.count("*").alias("n"), F.min("round").alias("first"))
    best = counted.groupBy("item").agg(F.max(F.when(F.col("letter").isNotNull(), F.struct("n", (-F.col("first")).alias("early"), "letter"))).alias("b"), F.sum("n").alias("total"), F.min("first").alias("first"))
    share = F.round(F.col("b.n") / F.col("total"), 3)
    outcome = F.when(F.col("first") < 0, "not asked").when(F.coalesce(share >= least, F.lit(False)), "suggested").otherwise("discarded")
    return best.select("item", F.col("b.letter").alias("letter"), share.alias("share"), outcome.alias("outcome"))


def infer_answers(prompts: DataFrame, client: Callable[[], Client], rounds: int = 5, least: float = 0.6, stop_at: int | None = None) -> DataFrame:
    """answer_votes() of prompts(item, prompt) asked `rounds` times each, or until a letter has `stop_at`
    votes. A suggestion is written by bank.define_keys() with source `inferido_ml`, and counts as an
    answer only once bank.confirm() has it."""
    enough = (r"\b([A-E])\b", stop_at) if stop_at else None
    return answer_votes(ask_rounds(prompts, client, rounds, enough), least)


def infer_topics(prompts: DataFrame, client: Callable[[], Client], topics: list[str], rounds: int = 3) -> DataFrame:
    """(item, slug, share): votes by the number of a topic in a list; 0 and what is out of range do not
    count."""
    names = F.array(*[F.lit(t) for t in topics])
    votes = ask_rounds(prompts, client, rounds).withColumn("slug", F.try_element_at(names, T.answer_index(F.col("raw"), F.lit(len(topics)))))
    valid = votes.where("slug IS NOT NULL").groupBy("item", "slug").agg(F.count("*").alias("n"))
    total = valid.groupBy("item").agg(F.sum("n").alias("total"))
    return valid.join(total, "item").select("item", "slug", F.round(F.col("n") / F.col("total"), 3).alias("share"))


def score_labels(prompts: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], labels: dict[str, str]) -> DataFrame:
    """(item, slug, share) of every prompt(item, prompt) and label: a scorer, made once in each task, gives
    each of a batch of texts a score for each label's sentence, each on its own."""
    slugs, sentences = list(labels), list(labels.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for b in batches:
            found = score(b["prompt"].tolist(), sentences)
            yield pd.DataFrame([(i, s, float(v)) for i, row in zip(b["item"], found, strict=True) for s, v in zip(slugs, row, strict=True)], columns=["item", "slug", "share"])

    shared.ship(prompts.sparkSession)
    return prompts.select("item", "prompt").mapInPandas(run, "item long, slug string, share double")


def classify_cascade(docs: DataFrame, decided: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, slug, score, decision) where only undecided documents go to the model `ask`, which
    returns (item, slug, share); its silence leaves the weak lexicon guess."""
    rest = decided.where("decision = 'model'")
    asked = ask(docs.join(rest.select("doc_id"), "doc_id", "left_semi"))
    best = asked.groupBy("item").agg(F.max(F.struct("share", "slug")).alias("b"))
    met = rest.join(best, F.col("doc_id") == F.col("item"), "left")
    says = met.select("doc_id", F.coalesce("b.slug", "slug").alias("slug"), F.coalesce("b.share", "score").alias("score"), F.when(F.col("b").isNotNull(), "model").otherwise("weak lexicon").alias("decision"))
    return decided.where("decision <> 'model'").unionByName(says)
