"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at counts of a document and votes good, votes bad or abstains. Nothing is labelled: expectation
maximisation over the counts of all vote patterns estimates how each rule votes on good and on bad documents, and a
document's posterior probability of being good decides, instead of passing every rule.

Words are runs of characters other than space and the ASCII controls 9 to 13; null texts have none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.llm.common import beside, stored, text_key, without
from busline.operators.validate import once

SYMBOLS = "#*$%&|<>"
CAPITALS = "A-ZÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÛÜ"
CLOSED = "[.!?…:;\"»”]\\s*$"
#: Frequent function words of four languages (fixed values).
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "de", "la", "le", "les", "et", "des", "que",
              "un", "une", "der", "die", "und", "das", "den", "ist", "nicht", "el", "los", "las", "por", "para", "se"]
BAD, ABSTAIN, GOOD = 0, 1, 2
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ROUNDS = 30


def _found(text: str, chars: str) -> Column:
    """How often the text has one of the characters."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)




def _rules() -> list[tuple[str, Column, Column]]:
    """(name, bad if, good if) over the columns of ``counted``."""
    words = F.col("n_words")
    share = {c: _ratio(c, "n_words") for c in ("n_symbols", "n_repeat_words", "n_shouts", "n_distinct")}
    length = _ratio("word_chars", "n_words")
    capitals, repeats = _ratio("n_capitals", "word_chars"), _ratio("n_dup_lines", "n_lines")
    closed = _ratio("n_closed", "n_lines")
    never = F.lit(False)
    return [
        ("symbols", share["n_symbols"] >= 0.1, never),
        ("capitals", capitals >= 0.3, never),
        ("shouts", share["n_shouts"] >= 0.2, never),
        ("repeated_words", share["n_repeat_words"] >= 0.3, never),
        ("repeated_lines", repeats >= 0.3, never),
        ("variety", (words >= 50) & (share["n_distinct"] * F.sqrt(words) < 2), never),
        ("word_length", (length < 2) | (length > 15), length.between(3, 12)),
        ("stop_words", (words >= 50) & (F.col("n_stops") == 0), never),
        ("closed_lines", closed < 0.1, closed >= 0.5),
    ]


#: What is believed of a rule before any text is seen: how it votes (bad, abstains, good) on good and on bad documents.
FINDS_FAULTS = ([0.01, 0.98, 0.01], [0.25, 0.74, 0.01])
WEIGHS_BOTH = ([0.1, 0.3, 0.6], [0.2, 0.3, 0.5])
GOOD_SHARE = 0.7
#: The beliefs about votes count as so many rows for each row of input; the share of good documents is not learnt.
BELIEF = 0.05


def _beliefs() -> tuple[list[float], list[float]]:
    kinds = [FINDS_FAULTS] * 6 + [WEIGHS_BOTH, FINDS_FAULTS, WEIGHS_BOTH]
    return [x for good, _ in kinds for x in good], [x for _, bad in kinds for x in bad]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules look at: ``COUNTS`` and n_lines, n_closed, n_stops, n_distinct, n_capitals, n_shouts.

    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in windows of three words that occur
    twice or more in the text. One row at a time; input columns of the same names are replaced.
    """
    return beside(lambda rows: _counted(rows, text), docs, text)


def _counted(docs: DataFrame, text: str) -> DataFrame:
    body = once(docs, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    split = once(
        body, F.filter(F.split("_body", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_body", "\n"), lambda s: s.rlike("[^ \\t\\x0B\\f\\r]")).alias("_lines"),
        _found("_body", SYMBOLS).alias("n_symbols"), _found("_body", CAPITALS).alias("n_capitals"), _found("_body", "!?").alias("n_shouts"),
    ).drop("_body")
    size = F.size("_words")
    word = lambda i: F.get("_words", i)
    places = F.when(size >= 3, F.sequence(F.lit(1), size - 2)).otherwise(F.array().cast("array<int>"))
    hashed = once(
        split, size.cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").alias("n_lines"),
        F.size(F.filter("_lines", lambda s: s.rlike(CLOSED))).alias("n_closed"),
        F.size(F.array_intersect("_words", F.lit(STOP_WORDS))).alias("n_stops"), F.size(F.array_distinct("_words")).alias("n_distinct"),
        F.transform(places, lambda i: F.xxhash64(word(i - 1), word(i), word(i + 1))).alias("_hashes"),
    ).drop("_lines")
    # most texts have no two windows of equal hash; only others sort the windows' words, where equal ones are neighbours
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    gram = lambda i: F.struct(F.concat_ws(" ", word(i - 1), word(i), word(i + 1)).alias("g"), i.alias("i"))
    ordered = once(hashed, F.when(again, F.sort_array(F.transform(F.sequence(F.lit(1), size - 2), gram)))
                   .otherwise(F.array().cast("array<struct<g:string,i:int>>")).alias("_sorted")).drop("_words", "_hashes")
    row = lambda k: F.get("_sorted", k)["g"]
    twice = lambda s, k: s["g"].eqNullSafe(row(k + 1)) | (F.when(k > 0, row(k - 1)).eqNullSafe(s["g"]))
    starts = F.sort_array(F.transform(F.filter("_sorted", twice), lambda s: s["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return once(ordered, covered.cast("long").alias("n_repeat_words")).drop("_sorted")


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def voted(counts: DataFrame) -> DataFrame:
    """Add ``votes``: for each rule 3 * its number + 0 (bad), 1 (abstains) or 2 (good)."""
    return without(counts, "votes").withColumn("votes", F.array(*[
        (_vote(bad, good) + 3 * n).cast("int") for n, (_, bad, good) in enumerate(_rules())]))


@dataclass(frozen=True)
class Model:
    """Log odds of good: the prior's, and those of each vote."""

    prior: float
    weights: list[float]


def _model(good: list[float], bad: list[float]) -> Model:
    """Votes weigh by their learnt rates. Abstaining weighs as first believed: rules that find the same faults abstain
    together, and learnt rates would count their silence many times over."""
    first_good, first_bad = _beliefs()
    weights = [math.log(fg / fb) if n % 3 == ABSTAIN else math.log(g / b)
               for n, (g, b, fg, fb) in enumerate(zip(good, bad, first_good, first_bad, strict=True))]
    return Model(math.log(GOOD_SHARE / (1 - GOOD_SHARE)), weights)


def posterior(model: Model) -> Column:
    """Probability that a document with these ``votes`` is good."""
    weights = F.lit(model.weights)
    odds = F.aggregate("votes", F.lit(model.prior), lambda a, v: a + F.get(weights, v))
    return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over the counts of vote patterns, held near the first beliefs.

    All rows count that the base rules leave open.
    There are at most 3^rules patterns, whatever the number of rows; each round sends three numbers per rule to the
    driver. Without rows the beliefs remain.
    """
    rules = len(_rules())
    patterns = stored(votes.filter(~base_failed()).groupBy("votes").count().repartition(1), "patterns")
    good_first, bad_first = _beliefs()
    model = _model(good_first, bad_first)
    for _ in range(rounds):
        weighed = patterns.select(F.explode("votes").alias("vote"), (F.col("count") * posterior(model)).alias("good"), "count")
        sums = {r["vote"]: (r["good"], r["n"]) for r in weighed.groupBy("vote").agg(
            F.sum("good").alias("good"), F.sum("count").alias("n")).collect()}
        if not sums:
            break
        total = sum(k for v, (_, k) in sums.items() if v < 3)
        held = BELIEF * total + 1
        share = (sum(x for v, (x, _) in sums.items() if v < 3) + held * GOOD_SHARE) / (total + held)
        good, bad = [], []
        for v in range(3 * rules):
            of_good, of_all = sums.get(v, (0.0, 0))
            good.append((of_good + held * share * good_first[v]) / ((total + held) * share))
            bad.append((of_all - of_good + held * (1 - share) * bad_first[v]) / ((total + held) * (1 - share)))
        new = _model(good, bad)
        moved = reduce(max, (abs(a - b) for a, b in zip([model.prior, *model.weights], [new.prior, *new.weights], strict=True)))
        model = new
        if moved < 1e-6:
            break
    return model


def judged(votes: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, ``quality`` (posterior, 6 digits) and kept (not base_failed, and quality over the threshold)."""
    rated = once(without(votes, "base_failed", "quality", "kept"), base_failed().alias("base_failed"),
                 F.round(posterior(model), 6).alias("quality"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("quality") > threshold))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Rows with equal doc_id and text are judged alike.

    Votes are taken once and written without the texts, which the kept keys then pick out.
    """
    return beside(_good, docs, "doc_id", "text")


def _good(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    votes = stored(voted(counted(named)).select("doc_id", "text_key", "votes", "n_words", "n_repeat_words"), "votes")
    good = judged(votes, fit(votes)).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    marked = docs.withColumn("_own", text_key())
    return marked.join(good, marked.doc_id.cast("long").eqNullSafe(good["_id"]) & (marked["_own"] == good["_key"]), "left_semi").select(*docs.columns)
