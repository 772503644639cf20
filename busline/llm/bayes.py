"""Quality classifier by hierarchical empirical Bayes.

A logistic model, fitted on labelled documents, turns counts of a text into evidence: the log odds of good quality
beyond those of the labelled sample. The share of good documents of each host, and of each path below it, is a posterior
mean: sums of the documents' probabilities, shrunk towards the level above, the more so the fewer documents there are.
How strongly is estimated from how much the shares of hosts, and of paths within hosts, really differ. A document's
quality joins its evidence with its path's share.

Sums per path and host are grouped aggregations with partial results, so a host with a third of all documents is
summed by all tasks. Null hosts and paths are a host and a path of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.llm import votes
from busline.llm.common import stored, without

#: At most about so many labelled documents fit the document model; all count when there are fewer.
MOST_LABELLED = 50_000
FEATURES = ["size", "symbols", "repeated", "lines_again", "length", "capitals", "shouts", "variety", "stops", "closed"]


def features() -> list[Column]:
    """Shares and logarithms of the counts of ``votes.counted``, each within a small range."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.least(F.col(a) / F.col(b), F.lit(2.0))).otherwise(F.lit(0.0))

    length = F.when(F.col("n_words") > 0, F.least(F.col("word_chars") / F.col("n_words"), F.lit(20.0)) / 10).otherwise(F.lit(0.0))
    columns = [F.log1p("n_words") / 10, share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"),
               length, share("n_capitals", "word_chars"), share("n_shouts", "n_words"), share("n_distinct", "n_words"),
               F.least(F.col("n_stops"), F.lit(10)) / 10, share("n_closed", "n_lines")]
    return [c.cast("double").alias(n) for c, n in zip(columns, FEATURES, strict=True)]


@dataclass(frozen=True)
class Evidence:
    """Log odds of good beyond the sample's: an intercept and a weight for each feature."""

    intercept: float
    weights: list[float]
    share: float

    def column(self) -> Column:
        return sum((F.col(n) * w for n, w in zip(FEATURES, self.weights, strict=True)), F.lit(self.intercept))


def fit(described: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Evidence:
    """Fit the document model on labelled rows (doc_id, quality 0 or 1; several labels of a document are averaged).

    Without both labels the evidence is 0 everywhere, and the share one half.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("label"))
    count = known.count()
    if count > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / count))
    rows = stored(described.join(known, "doc_id").select("label", *FEATURES), "labelled")
    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    good = totals["good"] or 0.0
    if not 0 < good < totals["n"]:
        return Evidence(0.0, [0.0] * len(FEATURES), 0.5)
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="label", regParam=1e-4, maxIter=100).fit(train)
    share = good / totals["n"]
    return Evidence(float(model.intercept) - math.log(share / (1 - share)), [float(w) for w in model.coefficients], share)


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many documents the level above counts as: moments of the groups' shares around ``mean``.

    ``groups`` has n and good (sum of probabilities). Differences that chance explains alone mean strong shrinkage.
    """
    apart = F.col("good") / F.col("n") - mean
    spread = mean * (1 - mean)
    row = groups.filter("n > 1").agg(F.sum(F.col("n") * apart * apart).alias("seen"), F.sum(spread).alias("chance"),
                                     F.sum((F.col("n") - 1) * spread).alias("rest")).first()
    if not row["rest"] or row["seen"] is None:
        return 10.0
    alike = min(0.5, max(1e-3, (row["seen"] - row["chance"]) / row["rest"]))  # correlation within a group
    return (1 - alike) / alike


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, evidence, host_share, path_share, quality, kept.

    All numbers have six digits. ``kept``: quality of at least the threshold. Empty and null texts are judged by their counts, which are 0.
    """
    counted = votes.counted(docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("_host"),
                                        F.coalesce(path.cast("string"), F.lit("")).alias("_path"), F.col(text).alias("_text")), "_text")
    described = stored(counted.select("doc_id", "_host", "_path", *features()), "described")
    model = fit(described, without(labels, "_host", "_path"))
    scored = stored(described.select("doc_id", "_host", "_path", model.column().alias("evidence")), "evidence")
    base = math.log(model.share / (1 - model.share))
    chance = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    paths = stored(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(chance).alias("good")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = (whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    pull = _strength(hosts, F.lit(mean))
    hosts = hosts.select("_host", ((F.col("good") + pull * mean) / (F.col("n") + pull)).alias("host_share"))
    within = stored(paths.join(hosts, "_host"), "within")
    pull = _strength(within, F.col("host_share"))
    shares = within.select("_host", "_path", "host_share",
                           ((F.col("good") + pull * F.col("host_share")) / (F.col("n") + pull)).alias("path_share"))
    logit = F.log(F.col("path_share") / (1 - F.col("path_share")))
    quality = F.round(1 / (1 + F.exp(-(F.col("evidence") + logit))), 6)
    return scored.join(shares, ["_host", "_path"]).select(
        "doc_id", F.round("evidence", 6).alias("evidence"), F.round("host_share", 6).alias("host_share"),
        F.round("path_share", 6).alias("path_share"), quality.alias("quality"), (quality >= threshold).alias("kept"))
