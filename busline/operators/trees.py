"""Trained tree ensembles as node tables and flat arrays, so that a model scores in any plan, streams included."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, weight double, node int, feature int, cut double, left int, right int, value double"
#: Rows that are walked through all trees together.
BLOCK = 8192


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of the tree ensemble in a stored pipeline; a leaf has no feature.

    Nodes are numbered within their tree, the root is 0. A row goes left where its feature is at most the cut.
    """
    weights = spark.read.parquet(f"{path}/stages/*/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    nodes = spark.read.parquet(f"{path}/stages/*/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0

    def where(c: Column, name: str) -> Column:
        return F.when(inner, c).alias(name)

    return nodes.join(weights, "tree").select(
        "tree", "weight", F.col("id").alias("node"), where(F.col("split.featureIndex"), "feature"), where(F.get("split.leftCategoriesOrThreshold", F.lit(0)), "cut"),
        where(F.col("leftChild"), "left"), where(F.col("rightChild"), "right"), F.col("prediction").alias("value"))


class Flat:
    """All trees of an ensemble in one set of arrays (at most trees x 2^(depth + 1) nodes)."""

    def __init__(self, nodes: DataFrame):
        rows = sorted((r.tree, r.node, r) for r in nodes.collect())
        place = {(tree, node): n for n, (tree, node, _) in enumerate(rows)}
        table = [r for _, _, r in rows]
        self.feature = np.array([-1 if r.feature is None else r.feature for r in table], np.int32)
        self.cut = np.array([0.0 if r.cut is None else r.cut for r in table])
        self.left = np.array([place.get((r.tree, r.left), 0) for r in table], np.int32)
        self.right = np.array([place.get((r.tree, r.right), 0) for r in table], np.int32)
        self.value = np.array([r.value * r.weight for r in table])
        self.roots = np.array([n for (_, node), n in place.items() if node == 0], np.int32)

    def rate(self, data: np.ndarray) -> np.ndarray:
        """Sum of the leaves' weighted values for each row of features."""
        out = np.zeros(len(data))
        for first in range(0, len(data), BLOCK):
            part = data[first:first + BLOCK]
            row = np.arange(len(part))[:, None]
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            while (inner := self.feature[at] >= 0).any():
                down = np.where(part[row, np.maximum(self.feature[at], 0)] <= self.cut[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            out[first:first + BLOCK] = self.value[at].sum(axis=1)
        return out

    def column(self, *features: Column) -> Column:
        """The score of a row; null if a feature is."""
        @F.pandas_udf("double")
        def rate(*columns: pd.Series) -> pd.Series:
            data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(self.rate(data)).where(~np.isnan(data).any(axis=1))

        return rate(*[f.cast("double") for f in features])
