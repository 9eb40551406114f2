"""Toxicity by weak supervision: voters, a generative label model and a linear classifier.

Voters are lexicon groups, beginnings of words that known toxic texts favour, and text patterns; each
says toxic, clean or nothing of a text. The label model learns how often each voter is right from how
voters agree over all training documents: their counts of joint votes are summed over the corpus, and
accuracies and the class balance follow by expectation maximisation. What is left of two voters'
correlation within the classes is estimated next, and voters whose agreement exceeds what independent
errors allow share their weight. Labels that are known anchor the patterns they stand with. A logistic
classifier then learns the posterior labels of documents from what is counted in each; a document's
pattern of votes gives its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import tokens, workspace

#: Words of abuse, in groups that vote together.
LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "imbecile", "dumb", "fool", "dimwit"),
    "worth": ("worthless", "pathetic", "loser", "losers", "useless", "nobody"),
    "filth": ("trash", "scum", "disgusting", "garbage", "filth", "filthy", "vermin"),
    "ridicule": ("clown", "clowns", "freak", "freaks", "joke", "laughable"),
    "abuse": ("bastard", "bastards", "bitch", "asshole", "shit", "fuck", "fucking", "crap", "whore", "slut"),
    "hate": ("hateful", "despise", "despicable", "loathe", "loathsome", "vile"),
    "german": ("idioten", "arschloch", "dummkopf", "abschaum", "trottel", "wertlos", "scheiße"),
    "french": ("connard", "salaud", "imbécile", "crétin", "ordure", "merde", "abruti"),
    "spanish": ("idiota", "imbécil", "estúpido", "basura", "payaso", "mierda", "asqueroso"),
}
#: Patterns that vote toxic.
PATTERNS: dict[str, str] = {
    "address": r"\byou(?: are|'re)? (?:an? |such an? |all )?(?:idiot|moron|loser|clown|stupid|pathetic|worthless|disgusting|trash|scum)",
    "silencing": r"\b(?:shut up|go away|get lost|drop dead)\b",
}
WORD = re.compile(r"[^\W\d_]+")
NAMES = (*LEXICONS, *PATTERNS, "mined", "plain")
FEATURES = (*LEXICONS, *PATTERNS, "mined", "kinds", "share")
#: Lengths of the mined beginnings of words.
BEGINNINGS = (5, 6, 7)


def observe(text: str | None, mined: frozenset = frozenset()) -> list[float]:
    """FEATURES of a whole text: hits of each lexicon and pattern and distinct words with a mined
    beginning (log scale), how many kinds of words were hit, and the share of hits among the words."""
    low = (text or "").lower()
    words = WORD.findall(low)
    distinct = set(words)
    present = dict.fromkeys(_ALL & distinct, 0)
    if present:
        for w in words:
            if w in present:
                present[w] += 1
    hits = [sum(n for w, n in present.items() if w in group) for group in _GROUPS]
    # The pattern of address begins with a word of its own, so a text without that word has no place for it.
    hits += [sum(1 for _ in p.finditer(low)) if k != "address" or "you" in distinct else 0 for k, p in _COMPILED.items()]
    begun: set = set()
    for k in BEGINNINGS if mined else ():
        if mined.intersection([w[:k] for w in distinct]):
            begun.update(w for w in distinct if w[:k] in mined)
    hits.append(len(begun))
    return [*np.log1p(hits).tolist(), float(np.log1p(len(begun | present.keys()))), sum(hits) / max(1, len(words))]


def votes(features: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing, by voter in the order of NAMES. A lexicon or pattern that is
    hit votes toxic, mined beginnings do from two words on; the last voter says clean where nothing
    is hit and toxic where two kinds are."""
    first = len(LEXICONS) + len(PATTERNS)
    out = (features[:, :first] > 0).astype(np.int8)
    several = [np.where(features[:, first + k] == 0, -1, features[:, first + k] > np.log1p(1.5)).astype(np.int8) for k in range(2)]
    return np.concatenate([out, np.stack(several, axis=1)], axis=1)


_GROUPS = [frozenset(g) for g in LEXICONS.values()]
_ALL = frozenset().union(*_GROUPS)
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


@dataclass(frozen=True)
class LabelModel:
    """What voters say given each class, and what each one's vote weighs."""

    balance: float
    says: np.ndarray  # voter, class (clean, toxic), vote (-1, 0, 1)
    weight: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        at = vote.astype(np.int64) + 1
        said = np.log(self.says)
        odds = np.full(len(vote), np.log(self.balance) - np.log1p(-self.balance))
        for v in range(vote.shape[1]):
            odds += self.weight[v] * (said[v, 1, at[:, v]] - said[v, 0, at[:, v]])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _accuracies(vote: np.ndarray, count: np.ndarray, label: np.ndarray, model: LabelModel, rounds: int, smooth: float) -> LabelModel:
    """Expectation maximisation with the voters' weights as they are."""
    total = count.sum()
    for _ in range(rounds):
        p = np.where(np.isnan(label), model.posterior(vote), np.nan_to_num(label))
        share = np.stack([(1 - p) * count, p * count])
        new = np.stack([[share[:, vote[:, v] == s].sum(axis=1) for s in (-1, 0, 1)] for v in range(vote.shape[1])]).transpose(0, 2, 1) + smooth
        new /= new.sum(axis=2, keepdims=True)
        balance = float(np.clip((p * count).sum() / total, 0.001, 0.5))
        done = np.abs(new - model.says).max() < 1e-6
        model = LabelModel(balance, new, model.weight)
        if done:
            break
    return model


def correlations(vote: np.ndarray, count: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What is left of the correlation of each two voters within a class, averaged over the classes;
    p is the share of the toxic class in each pattern."""
    x, total = vote.astype(float), count.sum()
    beyond = np.zeros((vote.shape[1], vote.shape[1]))
    for share in (p * count, (1 - p) * count):
        mass = max(share.sum(), 1e-9)
        mean = share @ x / mass
        cov = (x - mean).T * share @ (x - mean) / mass
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        beyond += np.abs(cov / sd / sd[:, None]) * mass / total
    np.fill_diagonal(beyond, 0)
    return beyond


def fit_label_model(vote: np.ndarray, count: np.ndarray, label: np.ndarray, balance: float = 0.1, rounds: int = 100, smooth: float = 0.5, least: float = 0.1) -> LabelModel:
    """The label model of distinct vote patterns and how often each occurs. `label` is 0 or 1 where it
    is known, else nan; `balance` is the share of toxic texts to begin with. Correlations under
    `least` count as none. A voter's weight is one over one and its correlations with others, so that
    two voters that always agree weigh as one. Without patterns the voters are as they begin."""
    voters = vote.shape[1]
    says = np.empty((voters, 2, 3))
    says[:, 0], says[:, 1] = (0.15, 0.8, 0.05), (0.05, 0.6, 0.35)
    model = LabelModel(balance, says, np.ones(voters))
    if not count.sum():
        return model
    model = _accuracies(vote, count, label, model, rounds, smooth)
    beyond = correlations(vote, count, model.posterior(vote))
    return LabelModel(model.balance, model.says, 1 / (1 + np.where(beyond > least, beyond, 0).sum(axis=1)))


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients of soft labels, the constant first (Newton's method)."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta, scale = np.zeros(x.shape[1]), max(weight.sum(), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (target - p)) / scale - ridge * beta
        curve = (x.T * (weight * p * (1 - p) / scale)) @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass(frozen=True)
class Classifier:
    model: LabelModel
    beta: np.ndarray
    mined: frozenset = frozenset()

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.beta[1:] + self.beta[0], -30, 30)))


def mine(docs: DataFrame, labels: DataFrame | None, rows: int = 20_000, ratio: float = 8.0, id_column: str = "doc_id", text_column: str = "text") -> frozenset:
    """Beginnings of words that stand in `ratio` times as large a share of toxic texts as of clean
    ones, and in 2 % of the toxic ones and in five at least. They come from the whole texts of at
    most `rows` labelled rows that are not held out, chosen by a hash of their id."""
    if labels is None:
        return frozenset()
    workspace.ship(docs.sparkSession)
    known = _known(labels, id_column).where(~F.coalesce(held_out(F.col("known")), F.lit(False)))
    some = workspace.saved(workspace.some(known, "known", rows), "labelled")
    total = {r.label: r.n for r in some.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return frozenset()
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.join(F.broadcast(some), F.col("id") == F.col("known")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict, dict] = ({}, {})
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, into = set(WORD.findall((text.as_py() or "").lower())), counts[label]
                for p in {w[:k] for w in words for k in BEGINNINGS if len(w) >= k}:
                    into[p] = into.get(p, 0) + 1
        for label, into in enumerate(counts):
            zero = pa.array(np.zeros(len(into), np.int64))
            n = pa.array(list(into.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), n if label else zero, zero if label else n], names=["p", "toxic", "clean"])

    counted = texts.mapInArrow(run, "p string, toxic long, clean long").groupBy("p").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c"))
    often = (F.col("a") >= max(5, 0.02 * toxic)) & ((F.col("a") + 0.5) / (toxic + 1) >= ratio * (F.col("c") + 0.5) / (clean + 1))
    found = {r.p for r in counted.where(often).select("p").collect()}
    return frozenset(p for p in found if not any(p[:k] in found for k in BEGINNINGS if k < len(p)))


def _known(labels: DataFrame, id_column: str) -> DataFrame:
    """(known, label) of ids; a label given twice counts as toxic if one says so."""
    rows = labels.where(F.col("toxic").isin(0, 1))
    return rows.groupBy(F.col(id_column).cast("long").alias("known")).agg(F.max("toxic").cast("int").alias("label"))


def observed(docs: DataFrame, mined: frozenset = frozenset(), keys: dict[str, F.Column] | None = None, text_column: str = "text") -> DataFrame:
    """(keys, votes, x): the key columns, by default the id as long, and each row's votes and its
    FEATURES, from its whole text."""
    workspace.ship(docs.sparkSession)
    rows = docs.select(*[c.alias(k) for k, c in (keys or {"id": F.col("doc_id").cast("long")}).items()], F.col(text_column).cast("string").alias("text"))
    names = [*rows.columns[:-1], "votes", "x"]
    schema = ", ".join([*[f"{k} {t}" for k, t in rows.dtypes[:-1]], "votes binary, x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            x = np.array([observe(t.as_py(), mined) for t in b.columns[-1]], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([v.tobytes() for v in votes(x)], pa.binary()), pa.array(list(x), pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, schema)


def fit(seen: DataFrame, labels: DataFrame | None = None, mined: frozenset = frozenset(), balance: float = 0.1, sample: int = 20_000, id_column: str = "doc_id") -> Classifier:
    """A classifier from the rows of observed() that are not held out; it needs their `id`.

    The label model takes the counts of all of them: the driver gets one row for each distinct pattern
    of votes and label, whose number the voters bound. The logistic classifier learns from at most
    `sample` documents of each class that the posterior makes likelier, each weighted by how many of
    its class it stands for; they are chosen by a hash of the id. An empty table gives the prior.
    """
    learn = seen.where(~F.coalesce(held_out(F.col("id")), F.lit(False)))
    if labels is None:
        marked = learn.withColumn("label", F.lit(None).cast("int"))
    else:
        marked = learn.join(_known(labels, id_column), F.col("id") == F.col("known"), "left")
    rows = sorted(marked.groupBy("votes", "label").agg(F.count("*").alias("n")).collect(), key=lambda r: (bytes(r.votes), str(r.label)))
    if not rows:
        empty = fit_label_model(np.zeros((0, len(NAMES)), np.int8), np.zeros(0), np.zeros(0))
        return Classifier(empty, np.concatenate([[np.log(balance / (1 - balance))], np.zeros(len(FEATURES))]), mined)
    vote = np.stack([np.frombuffer(bytes(r.votes), dtype=np.int8) for r in rows])
    label = np.array([np.nan if r.label is None else r.label for r in rows], dtype=float)
    count = np.array([r.n for r in rows], dtype=float)
    model = fit_label_model(vote, count, label, balance)
    toxic = sorted({bytes(r.votes) for r, p in zip(rows, model.posterior(vote), strict=True) if p >= 0.5})
    x, target, weight = [], [], []
    inside = F.col("votes").isin(toxic) if toxic else F.lit(False)
    for rest in (inside, ~inside):
        got = workspace.some(learn.where(rest), "id", sample).select("votes", "x").collect()
        if got:
            n = sum(r.n for r in rows if (bytes(r.votes) in toxic) == (rest is inside))
            x += [r.x for r in got]
            target.append(model.posterior(np.stack([np.frombuffer(bytes(r.votes), dtype=np.int8) for r in got])))
            weight.append(np.full(len(got), n / len(got)))
    return Classifier(model, fit_logistic(np.array(x), np.concatenate(target), np.concatenate(weight)), mined)


def odds(x: F.Column, classifier: Classifier) -> F.Column:
    """The classifier's score, 0 to 1, of a row's features."""
    beta = [float(v) for v in classifier.beta]
    total = sum((x[k] * F.lit(v) for k, v in enumerate(beta[1:])), F.lit(beta[0]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def held_out(doc_id) -> F.Column:
    """Whether a row takes no part in learning: every fifth by the crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    The label model and the classifier learn from the rows that are not held out; known labels of
    those rows anchor the label model, no label of a held-out row is read. Null and empty texts get
    the score of a text without hits. A null id is never held out and has no label. Repeated rows
    come out as often, and a label given twice counts as toxic if one says so. Other columns are not
    read; an empty table gives no rows.
    """
    mined = mine(docs, labels, id_column=id_column, text_column=text_column)
    seen = workspace.saved(observed(docs, mined, {"id": F.col(id_column).cast("long")}, text_column), "observed")
    score = odds(F.col("x"), fit(seen, labels, mined, id_column=id_column))
    out = seen.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, all columns kept. The classifier learns from
    these documents' own texts, and from the labels as toxicity() does; nulls, repeated rows and a
    label given twice count as there, so rows of one text go or stay together, and an empty table
    stays empty. Texts are observed once: what is rejected is a list of places in the files.
    """
    docs = workspace.located(docs)
    mined = mine(docs, labels, id_column=id_column, text_column=text_column)
    keys = {"id": F.col(id_column).cast("long"), "locator": workspace.locator(docs)}
    seen = workspace.saved(observed(docs, mined, keys, text_column), "observed")
    score = odds(F.col("x"), fit(seen, labels, mined, id_column=id_column))
    return workspace.without(docs, workspace.saved(seen.where(score >= threshold).select("locator"), "rejected"))
