"""Quotation linking, in DataFrame functions only.

Lines of a message that start with ``>`` quote an earlier one; the number of marks is the nesting level. Consecutive
lines of one level are a passage. Passages, their paragraphs and their lines are the quoted pieces; they are normalised
(lower case, single blanks) and hashed, and credited with their length to every earlier message of the same conversation
that holds that text, paragraph or line as its own. The message with the most credit at the outermost level that links is
the parent, the first one where several have as much. Parents give each message its thread and depth, and the
conversation is ordered by (root, depth, turn), with the quotes, and the lines that announce them, taken out.

A phrase that fills a conversation is not joined to all its holders, yet the parent is the best of all of them: pieces
with up to ``FEW`` holders are joined to each, and every message so met is credited with its common pieces as well. A message
not met holds common pieces only, so its credit follows from the set of common pieces it holds, and of the messages
with one such set the first wins. Equal sets, on either side, are compared once. A message is
named by (conv_id, turn); repeated rows share its parent, each stays a row. Rows with a null in either
link to nothing. Null texts stay null. A quote that no earlier message holds is dropped from the text like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline.llm.common import beside, stored, without
from busline.operators.validate import once

MARKS = r"^\s*(?:>\s?)+"
ANNOUNCES = r"(?i)(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
#: Pieces that more messages of a conversation hold are common. Parents are the same for any value.
FEW = 32
CREDIT = ("conv_id", "turn", "level", "source", "size", "n")


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Add ``own`` (text without quotes), ``quoted`` (array of (level, text) passages) and ``units`` (own texts that may be quoted)."""
    messages = without(messages, "own", "quoted", "units")
    split = once(messages, F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
    split = once(split, F.transform("_lines", lambda s: F.struct(
        (F.char_length(F.regexp_extract(s, MARKS, 0)) - F.char_length(F.translate(F.regexp_extract(s, MARKS, 0), ">", ""))).alias("level"),
        F.regexp_replace(s, MARKS, "").alias("s"))).alias("_rows")).drop("_lines")
    level = lambda i: F.get("_rows", i)["level"]
    starts = F.filter(F.transform("_rows", lambda x, i: F.when((i == 0) | (level(i - 1) != x["level"]), i)), lambda i: i.isNotNull())
    split = once(split, starts.alias("_starts"))
    passages = F.transform("_starts", lambda a, k: F.struct(level(a).alias("level"), F.array_join(F.transform(
        F.slice("_rows", a + 1, F.coalesce(F.get("_starts", k + 1), F.size("_rows")) - a), lambda x: x["s"]), "\n").alias("text")))
    own = F.filter("_rows", lambda x, i: (x["level"] == 0) & ~(x["s"].rlike(ANNOUNCES) & (F.coalesce(level(i + 1), F.lit(0)) > 0)))
    split = once(split, F.when(F.col("text").isNotNull(), F.btrim(F.array_join(F.transform(own, lambda x: x["s"]), "\n"), F.lit("\n \t\r"))).alias("own"),
                 F.filter(passages, lambda p: (p["level"] > 0) & (normalised(p["text"]) != "")).alias("quoted"))
    pieces = F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n"))
    units = F.array_distinct(F.filter(F.transform(pieces, normalised), lambda u: u != ""))
    return once(split, F.coalesce(units, F.array().cast("array<string>")).alias("units")).drop("_rows", "_starts")


def asked_pieces(read: DataFrame) -> DataFrame:
    """(conv_id, turn, level, unit, size, n): the distinct pieces each message quotes at each level, their characters and occurrences."""
    asked = read.filter(F.size("quoted") > 0).select("conv_id", "turn", F.inline("quoted"))
    pieces = F.concat(F.array("text"), F.split("text", r"\n\s*\n"), F.split("text", "\n"))
    asked = asked.select("conv_id", "turn", "level", F.explode(F.array_distinct(F.filter(F.transform(pieces, normalised), lambda u: u != ""))).alias("piece"))
    return asked.groupBy("conv_id", "turn", "level", F.md5("piece").alias("unit")).agg(
        F.sum(F.char_length("piece")).alias("size"), F.count("*").alias("n"))


def common_credit(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(conv_id, turn, level, source, size, n): of the messages with one set of common pieces the first, if none before it has as much."""
    sets = asked.groupBy("conv_id", "turn", "level").agg(F.sort_array(F.collect_list(F.struct("unit", "size", "n"))).alias("pieces"))
    sets = stored(sets.withColumn("set", F.md5(F.to_json("pieces"))), "sets")
    wanted = sets.groupBy("conv_id", "set").agg(F.any_value("pieces").alias("pieces"), F.max("turn").alias("last")).select(
        "conv_id", "set", "last", F.inline("pieces"))
    first = held.groupBy("conv_id", "source").agg(F.sort_array(F.collect_set("unit")).alias("units")).groupBy("conv_id", "units").agg(
        F.min("source").alias("source")).select("conv_id", "source", F.explode("units").alias("unit"))
    met = wanted.join(first, ["conv_id", "unit"]).filter("source < last").groupBy("conv_id", "set", "source").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"))
    met = met.groupBy("conv_id", "set", "size").agg(F.min(F.struct("source", "n")).alias("f")).select("conv_id", "set", "size", "f.*")
    before = Window.partitionBy("conv_id", "set").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_before", F.max("size").over(before)).filter("_before IS NULL OR size > _before")
    return sets.select("conv_id", "turn", "level", "set").join(met, ["conv_id", "set"]).filter("source < turn").select(*CREDIT)


def parents(messages: DataFrame, few: int = FEW) -> DataFrame:
    """(conv_id, turn, parent, n_linked): linked messages, the parent's turn, and how many quoted pieces led to it."""
    read = stored(parsed(messages).select("conv_id", "turn", "quoted", F.transform("units", F.md5).alias("units"))
                  .filter("conv_id IS NOT NULL AND turn IS NOT NULL"), "parsed")
    asked = stored(asked_pieces(read), "asked")
    held = read.select("conv_id", F.col("turn").alias("source"), F.explode("units").alias("unit")).join(
        asked.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi").distinct()
    held = stored(held, "held")
    common = stored(held.groupBy("conv_id", "unit").agg((F.count("*") > few).alias("common")), "common")
    asked, held = (stored(df.join(common, ["conv_id", "unit"]), name) for df, name in ((asked, "asked"), (held, "held")))
    asked_common, held_common = (df.filter("common").drop("common") for df in (asked, held))

    met = stored(asked.filter("NOT common").join(held.filter("NOT common"), ["conv_id", "unit"]).filter("source < turn").select(*CREDIT), "met")
    more = met.select("conv_id", "turn", "level", "source").distinct().join(asked_common, ["conv_id", "turn", "level"]).join(
        held_common, ["conv_id", "unit", "source"]).select(*CREDIT)
    credit = met.unionByName(more).groupBy("conv_id", "turn", "level", "source").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    credit = credit.unionByName(common_credit(asked_common, held_common))
    best = F.min(F.struct("level", (-F.col("size")).alias("less"), "source", "n"))
    return credit.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.source").alias("parent"), F.col("b.n").alias("n_linked"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of all linked messages, by doubling: each round looks up the ancestor's ancestor."""
    current = stored(linked.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    moving = current.count()
    while moving:
        up = current.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = stored(current.join(up, ["conv_id", "root"], "left"), "threads")
        moving = step.filter("above IS NOT NULL").count()
        current = step.select("conv_id", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return current


def link(messages: DataFrame) -> DataFrame:
    """The messages without quotes, and parent, root, depth, n_quotes, n_linked. ``text`` is replaced, other columns stay.

    Sorting by (conv_id, root, depth, turn) gives reply order. An unlinked message is its own root at depth 0.
    """
    return beside(_linked, messages, "conv_id", "turn", "text")


def _linked(messages: DataFrame) -> DataFrame:
    found = stored(parents(messages), "parents")
    placed = found.join(threads(found), ["conv_id", "turn"])
    read = parsed(messages).select(*[F.col("own").alias(c) if c == "text" else F.col(f"`{c}`") for c in messages.columns],
                                   F.size("quoted").cast("long").alias("n_quotes"))
    return read.join(placed, ["conv_id", "turn"], "left").select(
        *messages.columns, "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
