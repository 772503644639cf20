"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap. A span of a base generator that passes its kind's check is
always redacted; the check also labels the base generators' spans, right or wrong. A further candidate is labelled by
the check where that can fail for it (cards), or else by a base span of its kind that it overlaps, and not at all where
neither tells. Boosted trees learn from all labelled spans, grouped into counted feature patterns, what spans of each
shape and context are, and judge the further
candidates: a candidate is redacted when its score reaches its kind's threshold, the smallest one at which held-out
spans of that kind are right often enough. A kind without wrong spans among the held-out ones is not calibrated
(``Model.calibrated``): its candidates are taken at any score of 0.5 or more that its held-out spans reach. Candidates that overlap a base span of their kind add nothing and are left out.

Offsets count code points, ends are exclusive. Null texts count as empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.llm.common import beside, stored
from busline.operators.validate import once

KINDS = ["email", "ip", "card", "phone"]
#: Precision that held-out spans must reach, trees and their depth.
PRECISION, TREES, DEPTH = 0.98, 10, 3
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, base, expression). A match of a base expression starts where a run of its first characters does, or where the
#: match before ended, which lets the runs be possessive: linear in the text, without deep recursion.
GENERATORS: list[tuple[str, bool, str]] = [
    ("email", True, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?{_HOST}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{_HOST}++)++"),
    ("card", False, r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])"),
    ("phone", False, r"\+[0-9]{1,3}[\x20(.-]{0,2}[0-9]{3}[\x20).-]{0,2}[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", False, r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
]
FEATURES = ["kind", "digits", "length", "luhn", "octets", "marks", "before", "after", "hint", "ending"]
_HINTS = "(?i)(mail|phone|call|tel|mobile|fax|card|visa|pay|address|contact|host|server)"


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks so that long arrays stay linear."""
    block = 256

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"),
                           lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))

    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    parts = F.transform(starts, lambda b: F.slice(lengths, b * block + 1, block))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    before = F.concat(F.array(F.lit(0)), sums(totals))
    return F.when(F.size(lengths) > 0, F.flatten(F.transform(parts, lambda p, b: F.transform(
        sums(p), lambda s: s + F.get(before, b))))).otherwise(F.array().cast("array<int>"))


def _class(char: Column) -> Column:
    """0 none, 1 blank, 2 letter, 3 digit, 4 quote, 5 another character."""
    return (F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike(r"^\p{L}"), 2).when(char.rlike("^[0-9]"), 3)
            .when(char.rlike("^[\"'`]"), 4).otherwise(5))


def _described(n: int, match: Column, before: Column, after: Column, end: Column) -> Column:
    """The candidate: where it is, its features, and whether its kind's check passes."""
    kind, base, _ = GENERATORS[n]
    number = F.regexp_replace(match, "[^0-9]", "")
    digits = F.char_length(number)
    luhn = digits.between(14, 19) & F.call_function("luhn_check", number)
    octets = match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?=.)|$)){4}$")
    right = {"email": F.lit(True), "ip": octets, "card": luhn, "phone": digits.between(10, 15)}[kind]
    ending = F.char_length(F.substring_index(match, ".", -1)) if kind == "email" else F.lit(0)
    feature = {
        "kind": F.lit(KINDS.index(kind)), "digits": F.least(digits, F.lit(30)), "length": F.least(F.char_length(match), F.lit(40)),
        "luhn": luhn.cast("int") if kind == "card" else F.lit(0), "octets": octets.cast("int") if kind == "ip" else F.lit(0),
        "marks": F.least(F.char_length(match) - F.char_length(F.translate(match, "-.()[] ", "")), F.lit(10)),
        "before": _class(F.right(before, F.lit(1))), "after": _class(F.left(after, F.lit(1))),
        "hint": F.right(before, F.lit(24)).rlike(_HINTS).cast("int"), "ending": F.least(ending, F.lit(8)),
    }
    return F.struct((end - F.char_length(match)).alias("start"), end.alias("end"), F.lit(base).alias("base"),
                    F.coalesce(right, F.lit(False)).alias("right"), *[feature[f].cast("int").alias(f) for f in FEATURES])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_found``: all candidates of each text, with their features. One row at a time."""
    return beside(lambda rows: _candidates(rows, text), docs, text)


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    found = once(docs, F.coalesce(F.col(text), F.lit("")).alias("_body"))
    found = once(found, *[F.regexp_extract_all("_body", F.lit(p), F.lit(0)).alias(f"_m{n}") for n, (_, _, p) in enumerate(GENERATORS)])
    # what lies between matches, and where the matches end
    found = once(found, *[F.when(F.size(f"_m{n}") > 0, F.split("_body", p)).otherwise(F.array().cast("array<string>")).alias(f"_g{n}")
                          for n, (_, _, p) in enumerate(GENERATORS)])
    found = once(found, *[F.transform(F.zip_with(F.slice(f"_g{n}", 1, F.greatest(F.size(f"_m{n}"), F.lit(1))), f"_m{n}",
                                                 lambda g, m: F.char_length(g) + F.char_length(m)), lambda x: F.coalesce(x, F.lit(0)))
                          .alias(f"_l{n}") for n in range(len(GENERATORS))])
    found = once(found, *[_running(F.col(f"_l{n}")).alias(f"_e{n}") for n in range(len(GENERATORS))])

    def one(n: int) -> Column:
        return F.transform(f"_m{n}", lambda m, k: _described(n, m, F.get(f"_g{n}", k), F.get(f"_g{n}", k + 1), F.get(f"_e{n}", k)))

    helpers = ["_body", *[f"_{c}{n}" for n in range(len(GENERATORS)) for c in "mgle"]]
    return once(found, F.concat(*[one(n) for n in range(len(GENERATORS))]).alias("_found")).drop(*helpers)


# --- boosted trees --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Trees as (weight, nested node); a node is a value or (feature, bound, at most, above). By kind, thresholds and whether wrong spans tested them."""

    trees: list
    thresholds: list[float]
    calibrated: list[bool]

    def score(self, c: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, bound, low, high = node
            return F.when(c[FEATURES[feature]] <= bound, value(low)).otherwise(value(high))

        margin = sum((weight * value(tree) for weight, tree in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin)) if self.trees else F.lit(0.0)


def _tree(text: str):
    """A tree from its printed form: nested if and else lines around predictions."""
    lines = iter([s.strip() for s in text.splitlines() if re.match(r"\s*(If|Else|Predict)", s)])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, bound = re.search(r"feature (\d+) <= ([-\d.eE]+)", line).groups()
        low = node()
        next(lines)  # else
        return int(feature), float(bound), low, node()

    return node()


def _label(c: Column) -> Column:
    """Whether a candidate of ``_found`` is right; null where nothing tells."""
    over = lambda right: F.exists("_found", lambda b: b["base"] & (b["right"] == F.lit(right)) & (b["kind"] == c["kind"])
                                  & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return F.when(c["base"] | (c["kind"] == KINDS.index("card")), c["right"]).when(over(True), True).when(over(False), False)


def fit(found: DataFrame, precision: float = PRECISION) -> Model:
    """Train on the labelled spans of all rows, counted by feature pattern; a fifth is held out for thresholds.

    The patterns are few whatever the number of rows, since every feature has few values. Without both right and
    wrong spans there is no model, and nothing is added to the base spans.
    """
    spans = found.select(F.explode(F.transform("_found", lambda c: F.struct(
        c["start"].alias("start"), _label(c).alias("label"), *[c[f].alias(f) for f in FEATURES]))).alias("c")).filter("c.label IS NOT NULL")
    held = F.pmod(F.xxhash64(F.struct("c.start", *[f"c.{f}" for f in FEATURES])), F.lit(5)) == 0
    patterns = stored(spans.groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES], F.col("c.label").cast("double").alias("label"),
                                    held.alias("held")).agg(F.count("*").cast("double").alias("weight")), "patterns")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(patterns)
    train = vectors.filter("NOT held")
    if train.select("label").distinct().count() < 2:
        return Model([], [2.0] * len(KINDS), [False] * len(KINDS))
    grown = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="weight", seed=1, maxBins=64).fit(train)
    trees = [(float(w), _tree(t.toDebugString)) for w, t in zip(grown.treeWeights, grown.trees, strict=True)]
    model = Model(trees, [], [])
    row = F.struct(*FEATURES)
    bins = (patterns.filter("held").select("kind", "label", "weight", (F.floor(model.score(row) * 50) / 50).alias("bin"))
            .groupBy("kind", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("right"))
            .collect())  # at most 51 rows for each kind
    thresholds = []
    for kind in range(len(KINDS)):
        best, n, right = 2.0, 0.0, 0.0
        for b in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            n, right = n + b["n"], right + b["right"]
            if right >= precision * n and b["bin"] >= 0.5:
                best = b["bin"]
        thresholds.append(best)
    return Model(trees, thresholds, [any(b["right"] < b["n"] for b in bins if b["kind"] == k) for k in range(len(KINDS))])


def select(found: DataFrame, model: Model) -> DataFrame:
    """Replace ``_found`` by ``spans``: array of (kind, start, end, base), by start, then the order of KINDS, then end."""
    return beside(lambda rows: _selected(rows, model), found, "_found").drop("_found")


def _selected(found: DataFrame, model: Model) -> DataFrame:
    slim = once(found, F.filter("_found", lambda c: c["base"] & c["right"]).alias("_base"))
    limit = F.lit(model.thresholds)
    more = F.filter("_found", lambda c: (~(c["base"] & c["right"])) & (model.score(c) >= F.get(limit, c["kind"])) & ~F.exists(
        "_base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    joined = F.array_sort(F.array_distinct(F.transform(F.concat("_base", more), lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), (c["base"] & c["right"]).alias("base")))))
    names = F.lit(KINDS)
    spans = F.transform(joined, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"),
                                                   s["end"].alias("end"), s["base"].alias("base")))
    return once(slim, spans.alias("spans")).drop("_base")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every selected span of ``text`` replaced by its kind in brackets, and the ``spans``.

    Overlapping spans become one, named after the first. Other columns stay. Candidates are found twice: to fit, and to apply.
    """
    return beside(lambda rows: _redacted(rows, text), docs, text)


def _redacted(docs: DataFrame, text: str) -> DataFrame:
    model = fit(candidates(docs.select(text), text))
    marked = select(candidates(docs, text), model)
    step = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return marked.select(*[F.when(F.size("spans") > 0, step).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], "spans")
