"""URL verdicts by rules, and where no rule fits by the likelihood ratio of two character models.

URLs that a rule blocks or that hold a known word train a model of rejected URLs, all others one of
accepted URLs; each distinct text counts once, a known word `seed_weight` times. A model counts each
character after contexts of up to ORDER characters, smoothed from the shortest context up
(Witten-Bell). The models see the whole host and path; only the text of a rule that fits is masked,
so that they learn what such URLs look like and not the rules over again. A URL's score is
the mean over its characters of the log ratio of the two models at the longest context that training
holds; the threshold is calibrated to the accepted URLs: a stated share of them at most scores below
it. Everything is Spark's own operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm import workspace

#: Characters of context at most. With the 35 symbols below, a model has at most 35 to the power
#: ORDER + 1 grams of that length.
ORDER = 3
#: A text of more than one in so many rows is hot: there are no more such texts than this.
HOT = 1000
#: Fixed values: (verdict, host and path) of the rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words whose URLs are rejected examples unless a rule allows them, and the words
#: that each class has in any training.
REJECTED = ("adult", "bets", "casino", "clickbait", "jackpot", "lottery", "payday", "pills", "poker", "porn", "replica", "spam", "viagra", "warez", "xxx")
ACCEPTED = ("news", "docs", "library", "university", "museum", "blog", "wiki", "weather")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a URL without ://."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does. Of rules of one length the
    first in order of their text wins."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at, start = text.split("/", 1)[0], "/" + text.split("/", 1)[1]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def symbols(host: Column, path: Column, rule: Column | None = None) -> Column:
    """What the models see of a host and path, over 35 symbols: lower-case letters, one for a run of
    digits, - . / _ and ~ for the rest, between ^ and $. One ~ stands for the text of a rule that fits."""
    whole = F.concat(host, path)
    if rule is not None:
        site = F.length(F.substring_index(rule, "/", 1))
        before = F.substring(host, F.lit(1), F.length(host) - site)
        whole = F.coalesce(F.concat(before, F.lit("~"), F.substring(path, F.length(rule) - site + 1, F.length(path))), whole)
    low = F.translate(whole, _UPPER, _LOWER)
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), "[^a-z0./_-]", "~"), F.lit("$"))


def _grams(text: Column, order: int) -> Column:
    """The text's grams of order + 1 symbols."""
    last = F.length(text) - order
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(order + 1))))


def train(examples: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) from examples(text, accepted boolean, weight double): the log ratio of the two
    models for a gram's last symbol after the rest of it. The number of grams is bounded by the
    alphabet, not by the examples."""
    model = None
    for k in range(order + 1):
        seen = examples.select(F.explode(_grams(F.col("text"), k)).alias("gram"), "accepted", "weight")
        seen = seen.groupBy("gram").agg(
            F.coalesce(F.sum(F.when(F.col("accepted"), F.col("weight"))), F.lit(0.0)).alias("a"),
            F.coalesce(F.sum(F.when(~F.col("accepted"), F.col("weight"))), F.lit(0.0)).alias("r"),
        )
        seen = seen.withColumn("context", F.substring("gram", 1, k)).withColumn("shorter", F.substring("gram", 2, k))
        kinds = [F.sum(F.col(c)).alias(f"n{c}") for c in "ar"] + [F.sum((F.col(c) > 0).cast("double")).alias(f"t{c}") for c in "ar"]
        seen = seen.join(seen.groupBy("context").agg(*kinds), "context")
        if model is None:
            seen = seen.withColumns({f"q{c}": F.lit(1 / 35) for c in "ar"})
        else:
            seen = seen.join(model.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "shorter")
        smooth = {f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"q{c}")) for c in "ar"}
        level = workspace.saved(seen.withColumns(smooth).select("gram", "pa", "pr"), "url-model")
        model = level if model is None else model.union(level)
    return workspace.saved(model.select("gram", F.round(F.log("pa") - F.log("pr"), 9).alias("ratio")), "url-ratios")


def score(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, score) of distinct symbol texts: the mean of each symbol's ratio at the longest gram that
    the model has, 0 where it has none. A short text has as many terms as symbols. Spark broadcasts the
    grams of one length if they are small enough, and else joins them by shuffle, which adaptive
    execution splits where a gram is frequent."""
    rows = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    for k in range(order + 1):
        gram = F.when(F.col("i") > k, F.substring("text", F.col("i") - k, F.lit(k + 1)))
        part = model.where(F.length("gram") == k + 1).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        rows = rows.withColumn("at", gram).join(part, F.col("at") == F.col(f"g{k}"), "left").drop(f"g{k}", "at")
    best = F.coalesce(*[F.col(f"r{k}") for k in range(order, -1, -1)], F.lit(0.0))
    # Whole numbers add up to the same sum in any order.
    return rows.groupBy("text").agg((F.sum(F.round(best * 1e9).cast("long")) / F.count("*") / 1e9).alias("score"))


def judge(pages: DataFrame, rules: tuple = RULES, order: int = ORDER, seed_weight: float = 25.0, false_blocks: float = 0.02, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, score, verdict) for every row.

    The verdict is the longest fitting rule's, else allow if the score is at least the threshold,
    below which `false_blocks` of the accepted texts are. If
    no rule ever allows, or none ever blocks, the known words alone train that model. A null URL, or
    one without ://, has an empty host and path, which no rule fits and the models judge like any
    text. Repeated rows come out as often; other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "text": symbols(F.col("host"), F.col("path"), rule)})
    texts = workspace.saved(rows.groupBy("text", "ruled").agg(F.count("*").alias("n"), F.lit(1.0).alias("weight")), "url-texts")
    bad = F.col("text").rlike("|".join(REJECTED))
    known = texts.select("text", (F.coalesce("ruled", F.when(bad, F.lit("block")), F.lit("allow")) == "allow").alias("accepted"), "weight")
    seeds = [(s, a) for a, group in ((True, ACCEPTED), (False, REJECTED)) for s in group]
    seeds = spark.createDataFrame(seeds, "seed string, accepted boolean").select(symbols(F.col("seed"), F.lit("")).alias("text"), "accepted", F.lit(seed_weight).alias("weight"))
    examples = known.union(seeds)
    scores = workspace.saved(score(texts.select("text").union(seeds.select("text")).distinct(), train(examples, order), order), "url-scores")
    accepted = examples.where("accepted").join(scores, "text")
    threshold = accepted.agg(F.percentile_approx("score", false_blocks, 10_000)).first()[0]
    says = F.coalesce("ruled", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    # Many URLs may come down to one text. The scores of such texts are few and go to the rows; the rows
    # of all others meet theirs by shuffle or broadcast, as their size asks for.
    total = texts.agg(F.sum("n")).first()[0] or 0
    hot = workspace.saved(texts.groupBy("text").agg(F.sum("n").alias("n")).where(F.col("n") * HOT > total).join(scores, "text").select("text", "score"), "url-hot")
    rest = rows.join(F.broadcast(hot.select("text")), "text", "left_anti")
    marked = rows.join(F.broadcast(hot), "text").unionByName(rest.join(scores, "text"))
    return marked.select("page_id", "host", "path", "rule", F.round("score", 9).alias("score"), says.alias("verdict"))
