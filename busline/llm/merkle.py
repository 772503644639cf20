"""Merkle manifest of a data set: a tree of hashes for each group, and one over the groups' roots.

A leaf is the hash of a row's fields. Every level is one table of nodes (group, index): a node meets the other slots of
its run by equality joins on computed indices (``index XOR 1`` for a binary tree, slot offsets otherwise), and the row in
slot zero emits the parent. A group that has reached its root is handed upwards unchanged, so all roots stand on the
last level. Proofs go the other way: a level joins the path of its parents. No node waits for a whole group, and
the number of levels is the logarithm of the largest group.

H is the lowercase hex SHA-256 of the concatenated inputs; hashes enter as hex text. The last run of a level may hold
fewer nodes; a single one there becomes its own H.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.llm.common import numbered, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of paths that one plan joins before its result is written.
LEVELS_AT_ONCE = 5
#: Hex digits of a hash.
DIGITS = 64


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def leaf_of(*fields: Column) -> Column:
    """Hash of a row: each field as ``-`` if null, else its length in UTF-8 bytes, a colon and its value."""
    def one(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (g, i, n, hash, ...) with ``sib``: the hashes of the other slots of the run, joined from left to right."""
    slot = F.col("i") % fanout
    out, found = nodes, []
    for offset in range(1, fanout):
        at = F.col("i").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("i") - slot + (slot + offset) % fanout
        other = nodes.select(F.col("g").alias("g_"), F.col("i").alias("i_"), F.col("hash").alias(f"h{offset}"))
        out = out.join(other, (F.col("g") == F.col("g_")) & (at == F.col("i_")), "left").drop("g_", "i_")
        found.append(F.struct(((slot + offset) % fanout).alias("slot"), F.col(f"h{offset}").alias("h")))
    joined = F.array_join(F.transform(F.array_sort(F.array(*found)), lambda s: s["h"]), "")
    return out.select(*nodes.columns, joined.alias("sib"))


def levels(nodes: DataFrame, height: int, fanout: int) -> list[DataFrame]:
    """The stored levels of all trees, leaves first; the last one holds the roots.

    ``nodes`` has the columns g (tree), i (index from 0), n (nodes of the tree), hash, and any to keep at the leaves.
    """
    out = []
    for _ in range(height):
        out.append(stored(_with_siblings(nodes, fanout), "level"))
        nodes = out[-1].filter(F.col("i") % fanout == 0).select(
            "g", _div(F.col("i"), fanout).alias("i"), _div(F.col("n") + (fanout - 1), fanout).alias("n"),
            F.when(F.col("n") > 1, F.sha2(F.concat("hash", "sib"), 256)).otherwise(F.col("hash")).alias("hash"))
    return [*out, stored(nodes, "roots")]


def paths(tree: list[DataFrame], roots: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """The leaves with ``path``: the hashes of their siblings, level by level, followed by their root's own path.

    ``roots`` (g, path and the columns ``carried``) has one row per tree.
    """
    above = tree[-1].drop("sib").join(roots, "g") if len(tree) == 1 else roots.withColumn("i", F.lit(0).cast("long"))
    for n, level in enumerate(reversed(tree[:-1]), 1):
        up = above.select(F.col("g").alias("g_"), F.col("i").alias("i_"), F.col("path").alias("up"), *carried)
        joined = level.join(up, (F.col("g") == F.col("g_")) & (_div(F.col("i"), fanout) == F.col("i_")))
        above = joined.select(*[c for c in level.columns if c != "sib"], F.concat("sib", "up").alias("path"), *carried)
        if n % LEVELS_AT_ONCE == 0 and n < len(tree) - 1:
            above = stored(above, "paths")
    return above


def fold(leaf: Column, path: Column, steps: list[tuple[Column, Column, int]], fanout: int) -> Column:
    """The root that a leaf gives with the siblings in ``path``.

    ``steps`` has (index, number of nodes, levels at most) of the tree and of the one over it.
    """
    h, at = leaf, F.lit(1)
    for i, n, height in steps:
        start = F.struct(h.alias("h"), at.cast("int").alias("at"), i.cast("long").alias("i"), n.cast("long").alias("n"))

        def up(s: Column, _: Column) -> Column:
            slot = s["i"] % fanout
            others = F.least(F.lit(fanout), s["n"] - s["i"] + slot) - 1
            cut = s["at"] + (slot * DIGITS).cast("int")
            left, right = F.substring(path, s["at"], (slot * DIGITS).cast("int")), F.substring(path, cut, ((others - slot) * DIGITS).cast("int"))
            return F.when(s["n"] > 1, F.struct(
                F.sha2(F.concat(left, s["h"], right), 256).alias("h"), (s["at"] + others.cast("int") * DIGITS).alias("at"),
                _div(s["i"], fanout).alias("i"), _div(s["n"] + (fanout - 1), fanout).alias("n"))).otherwise(s)

        end = F.aggregate(F.array_repeat(F.lit(0), height), start, up)
        h, at = end["h"], end["at"]
    return h


def height_of(most: int | None, fanout: int) -> int:
    """Levels between the leaves and the root of a tree of ``most`` leaves."""
    height = 0
    while (most or 0) > 1:
        most, height = -(-most // fanout), height + 1
    return height


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             fanout: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """Every row's place in the tree of the data set.

    Columns: ``order``, ``group``, leaf, subroot (root of the group's tree), root, path (the siblings' hashes, level by level
    from the leaf to the root, left to right), folded (the root from ``changed``, where ``carry`` has it, else from the leaf),
    and the columns of ``carry``. Leaves of a group ascend by ``order``: null first, equal keys by leaf; repeated rows are
    leaves of their own. Groups ascend likewise, null being a group. An empty table has an empty manifest. Other columns
    of ``rows`` do not matter.
    """
    if fanout < 2:
        raise ValueError("a parent has two children at least")
    carry = {k: v.alias(k) for k, v in (carry or {}).items()}
    leaf = leaf_of(*[F.col(f) for f in fields]).alias("hash")
    # narrow: the texts are read and hashed once
    narrow = stored(rows.select(F.col(group).alias("name"), F.col(order).alias("key"), leaf, *carry.values()), "leaves")
    leaves = numbered(narrow, ["name"], ["key", "hash", *carry])
    leaves = stored(leaves.withColumnsRenamed({"number": "i", "total": "n"}), "numbered")
    names = numbered(leaves.filter("i = 0").select("name", F.col("n").alias("held")), [], ["name"])
    names = stored(names.select(F.col("name").alias("name_"), F.col("number").alias("g"), F.col("total").alias("groups"), "held"), "groups")
    most, groups = names.agg(F.max("held"), F.count("*")).first()
    low, high = height_of(most, fanout), height_of(groups, fanout)

    tree = levels(leaves.join(names, F.col("name").eqNullSafe(F.col("name_"))).drop("name_", "held"), low, fanout)
    tops = levels(tree[-1].select(F.lit(0).alias("g"), F.col("g").alias("i"), F.lit(groups).cast("long").alias("n"), "hash"), high, fanout)
    root = tops[-1].select("g", F.lit("").alias("path"), F.col("hash").alias("root"))
    top_paths = paths(tops, root, ["root"], fanout).select(F.col("i").alias("g"), "path", F.col("hash").alias("subroot"), "root")
    placed = paths(tree, stored(top_paths, "tops"), ["subroot", "root"], fanout)
    start = F.col("changed") if "changed" in carry else F.col("hash")
    folded = fold(start, F.col("path"), [(F.col("i"), F.col("n"), low), (F.col("g"), F.col("groups"), high)], fanout)
    return placed.select(F.col("key").alias(order), F.col("name").alias(group), F.col("hash").alias("leaf"), "subroot", "root", "path",
                         folded.alias("folded"), *carry)
