"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A repeated run is a run of lines, with at least ``least`` words together, that also occurs earlier: in a document with
a smaller (doc_id, text), or further up in the same one. All lines of later runs are deleted, the first run stays.

From every line with a word the shortest window of lines with ``least`` words is looked at, forwards and, to extend
matches to the lines before a window's start and after its end, backwards. The smallest line hash of a window is its
fingerprint. Equal windows have equal fingerprints, so a run of ``least`` words cannot hide: only windows whose
fingerprint stands at two places or more are joined, by the hashes of all their lines, with their first occurrence.
Each window meets its first occurrence alone, so a passage with many copies gives one row per copy, not pairs.

Lines are compared without spaces around them; blank lines inside a run go with it. Null texts stay null, empty ones
empty. Rows with equal doc_id and equal text are one document and get one result. Null ids come after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import beside, stored, text_key
from busline.operators.validate import once

LEAST_WORDS = 50
BLANK = " \t\n\x0b\f\r"


def _windows(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_key, windows): the forward and backward windows of each document.

    A window: first and last line, its fingerprint f and that line's number at, and hashes w and v of all its lines.
    """
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    split = once(rows, F.split("text", "\n").alias("_lines")).drop("text")
    bare = once(split, F.transform("_lines", lambda s: F.btrim(s, F.lit(BLANK))).alias("_bare")).drop("_lines")
    line = lambda s, i: F.struct(i.alias("i"), F.size(F.split(s, "[ \\t\\x0B\\f\\r]+")).alias("n"),
                                 F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g"), (s != "").alias("some"))
    lined = once(bare, F.filter(F.transform("_bare", line), lambda x: x["some"]).alias("_s")).drop("_bare")
    lined = once(lined, F.reverse("_s").alias("_r"))

    def window(lines: str, k: F.Column, back: bool) -> F.Column:
        # each line has a word, so ``least`` lines are enough
        near = F.slice(lines, k, least)
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"))
        reach = F.aggregate(near, start, lambda a, x: F.when(a["n"] >= least, a).otherwise(
            F.struct((a["n"] + x["n"]).alias("n"), (a["c"] + 1).alias("c"))))
        return F.struct(reach.alias("reach"), k.alias("k"), F.lit(back).alias("back"))

    every = F.when(F.size("_s") > 0, F.sequence(F.lit(1), F.size("_s"))).otherwise(F.array().cast("array<int>"))
    reached = once(lined, F.filter(F.concat(F.transform(every, lambda k: window("_s", k, False)),
                                            F.transform(every, lambda k: window("_r", k, True))),
                                   lambda w: w["reach"]["n"] >= least).alias("_w"))
    count = F.size("_s")

    def described(w: F.Column) -> F.Column:
        first = F.when(w["back"], count - w["k"] - w["reach"]["c"] + 2).otherwise(w["k"])
        lines = F.slice("_s", first, w["reach"]["c"])
        low = F.array_min(F.transform(lines, lambda x: F.struct(x["h"], x["i"])))
        return F.struct(F.get("_s", first - 1)["i"].alias("first"), F.get("_s", first + w["reach"]["c"] - 2)["i"].alias("last"),
                        low["h"].alias("f"), low["i"].alias("at"), F.xxhash64(F.transform(lines, lambda x: x["h"])).alias("w"),
                        F.xxhash64(F.transform(lines, lambda x: x["g"])).alias("v"))

    return reached.select("doc_id", "text_key", F.array_distinct(F.transform("_w", described)).alias("windows")).filter(F.size("windows") > 0)


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, spans): disjoint (first, last) line numbers from 0, in order, that later runs cover."""
    windows = stored(_windows(docs, least), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("doc")
    marks = windows.select(F.explode(F.array_distinct(F.transform("windows", lambda w: F.struct(w["f"].alias("f"), w["at"])))).alias("m"))
    again = marks.groupBy("m.f").count().filter("count > 1").select("f")
    found = windows.select(place, F.inline("windows")).join(again, "f", "left_semi")
    firsts = found.groupBy("w", "v").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last")).alias("one")).filter("n > 1")
    later = found.join(firsts.select("w", "v", "one"), ["w", "v"]).filter(
        (F.col("doc") != F.col("one.doc")) | (F.col("first") > F.col("one.last")))
    # what each window adds behind the furthest line so far
    so_far = F.expr("max(last) OVER (PARTITION BY doc ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    fresh = (later.select("doc", "first", "last").distinct()
             .withColumn("first", F.greatest("first", F.coalesce(so_far, F.lit(-1)) + 1)).filter("first <= last"))
    return fresh.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")).select(
        "doc.doc_id", "doc.text_key", "spans")


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents with later repeated runs of lines deleted from ``text``, and ``n_removed``: how many lines went.

    All rows and columns stay; an input column ``n_removed`` is replaced.
    """
    return beside(lambda rows: _dedup(rows, least), docs, "doc_id", "text")


def _dedup(docs: DataFrame, least: int) -> DataFrame:
    gone = repeats(docs, least).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    marked = docs.withColumn("_own", text_key())
    joined = marked.join(gone, marked.doc_id.cast("long").eqNullSafe(gone["_id"]) & (marked["_own"] == gone["_key"]), "left")
    split = once(joined, F.when(F.col("_spans").isNotNull(), F.split("text", "\n")).alias("_lines"))
    stay = F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda j: F.struct(
        F.when(j == 0, 0).otherwise(F.get("_spans", j - 1)["last"] + 1).alias("a"),
        F.when(j == F.size("_spans"), F.size("_lines")).otherwise(F.get("_spans", j)["first"]).alias("b")))
    kept = F.flatten(F.transform(stay, lambda s: F.slice("_lines", s["a"] + 1, s["b"] - s["a"])))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("_spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0))
    return split.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], removed.alias("n_removed"))
