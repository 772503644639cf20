"""Isolation forest: trees grow in parallel on small row samples, scoring is a vectorised UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 256


def _expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(data: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as parallel node arrays; a leaf stores its depth plus the expected depth of its rows."""
    limit = int(np.ceil(np.log2(max(len(data), 2))))
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes["feature"])
        for column, value in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1),
                              ("depth", depth + _expected_depth(len(rows)))):
            nodes[column].append(value)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(data.shape[1])
        if depth >= limit or len(rows) <= 1 or not (spread > 0).any():
            return at
        feature = int(rng.choice(np.flatnonzero(spread > 0)))
        cut = float(rng.uniform(rows[:, feature].min(), rows[:, feature].max()))
        below = rows[:, feature] < cut
        nodes["feature"][at], nodes["cut"][at] = feature, cut
        nodes["left"][at] = add(rows[below], depth + 1)
        nodes["right"][at] = add(rows[~below], depth + 1)
        return at

    add(data, 0)
    return nodes


def grow_forest(df: DataFrame, features: list[str], row_key: list[str], trees: int = 200, sample: int = SAMPLE,
                seed: int = 42) -> DataFrame:
    """One row per tree. Each tree sees ``sample`` rows drawn by a hash of (row, tree).

    Subsampling is the algorithm, with the same draw at every size: a row goes to each tree with the probability that
    sends about 1.5 x sample rows to a tree, and a tree keeps the ``sample`` of smallest hash.
    """
    rate = F.least(F.lit(1.0), F.lit(1.5 * sample) / F.greatest(df.agg(F.count("*")).scalar(), F.lit(1)))
    unit = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)
    keyed = [F.col(c) for c in row_key]
    # a filter above the generator is compiled, a lambda over the tree numbers would be interpreted for each row and tree
    dealt = df.withColumn("_rate", rate).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(
        unit(F.lit(seed), F.col("tree"), *keyed) < F.col("_rate"))
    rows = dealt.select("tree", F.xxhash64(F.lit(seed), "tree", *keyed).alias("_order"),
                        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("_order")[features].to_numpy()[:sample]
        nodes = _grow(data, np.random.default_rng(seed * 100_003 + tree))
        return pd.DataFrame([{"tree": tree, "rows": len(data), **nodes}])

    return rows.groupBy("tree").applyInPandas(
        grow, "tree int, rows int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>")


class Packed:
    """A grown forest as flat arrays, small enough (trees x 2 x sample nodes) to be sent to every task."""

    def __init__(self, forest: DataFrame):
        trees = [r.asDict() for r in forest.orderBy("tree").collect()]
        self.trees = [self._pack(*[np.array(t[c]) for c in ("feature", "cut", "left", "right", "depth")]) for t in trees]
        self.scale = _expected_depth(float(max((t["rows"] for t in trees), default=2)))

    @staticmethod
    def _pack(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> tuple:
        """(feature, cut, children, leaf, levels): a leaf is its own child, so all rows take the same number of steps."""
        inner, here = feature >= 0, np.arange(len(feature))
        children = np.column_stack([np.where(inner, left, here), np.where(inner, right, here)]).ravel()
        level = np.zeros(len(feature), dtype=int)
        for node in np.flatnonzero(inner):
            level[[left[node], right[node]]] = level[node] + 1
        return np.where(inner, feature, 0), cut, children, leaf, int(level.max())

    def rate(self, data: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1) of rows of features."""
        depth = np.zeros(len(data))
        values, row = np.ascontiguousarray(data).ravel(), np.arange(len(data)) * data.shape[1]
        for feature, cut, children, leaf, levels in self.trees:
            at = np.zeros(len(data), dtype=int)
            for _ in range(levels):
                at = children[2 * at + np.logical_not(values[row + feature[at]] < cut[at])]
            depth += leaf[at]
        return 2.0 ** (-(depth / len(self.trees)) / self.scale)


def score(df: DataFrame, forest: DataFrame, features: list[str], out: str = "forest_score") -> DataFrame:
    """Anomaly score in (0, 1). The forest is bounded by trees x 2 x sample nodes and is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(Packed(forest))

    @F.pandas_udf("double")
    def rate(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.rate(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return df.withColumn(out, rate(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))


def verdict(scored: DataFrame, contamination: float = 0.05, out: str = "forest_anomaly") -> DataFrame:
    """Rows above the score quantile that the contamination share sets (mergeable quantile sketch)."""
    edge = scored.agg(F.percentile_approx("forest_score", 1 - contamination, 100_000)).scalar()
    return scored.withColumn(out, F.col("forest_score") > edge)
