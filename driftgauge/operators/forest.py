"""Random-forest detector: MLlib training, scoring and built-in importances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.operators.cells import MOST_CELLS, Splits, candidate_splits, cell_of, fit_cells, grid_size, representative
from driftgauge.operators.clean import impute
from driftgauge.operators.order_stats import collect_medians
from driftgauge.session import literal_table, scratch_path, settle

# The baseline forest's settings.
N_TREES = 100
MAX_DEPTH = 20
SEED = 42
#: Cells that are scored ahead, so that a row's score is looked up.
GRID_CELLS = 1 << 17
#: Rows of a task of MLlib's training, about 500 bytes each with 100 trees.
ROWS_PER_TASK = 500_000


def feature_array(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


@dataclass(frozen=True)
class ForestDetector:
    model: RandomForestClassificationModel
    features: tuple[str, ...]
    medians: Mapping[str, float]
    #: All thresholds the trees may have, if they were chosen ahead.
    splits: Splits | None = None

    @property
    def by_cell(self) -> bool:
        """Whether the feature space has few enough cells to score each of them once."""
        return self.splits is not None and grid_size(self.splits) <= GRID_CELLS

    def cell(self, values: Sequence[Column]) -> Column:
        return cell_of(values, self.splits)

    @cached_property
    def cell_scores(self) -> DataFrame:
        """``(_cell, _p)``: the attack probability in every cell, written once.

        It has ``GRID_CELLS`` rows at most, 2 MB, so it goes to the rows whatever the session's limit for broadcasts is.
        """
        cells = SparkSession.active().range(grid_size(self.splits)).select(
            F.col("id").alias("_cell"), array_to_vector(representative(F.col("id"), self.splits)).alias("_x")
        )
        return settle(self._transformed(cells, "_x", "_p").select("_cell", "_p"), "cell-scores")

    def score(self, df: DataFrame, column: str = "rf_score") -> DataFrame:
        """Adds the attack probability; missing features take the training medians."""
        filled = impute(df.select(*[F.col(f"`{f}`") for f in self.features], F.struct("*").alias("_row")), self.medians)
        if self.by_cell:
            placed = filled.select("_row", self.cell([F.col(f"`{f}`").cast("double") for f in self.features]).alias("_cell"))
            return placed.join(F.broadcast(self.cell_scores), "_cell", "left").select("_row.*", F.col("_p").alias(column))
        scored = self.score_vectors(filled.withColumn("_x", array_to_vector(feature_array(self.features))), "_x", column)
        return scored.select("_row.*", column)

    def score_vectors(self, df: DataFrame, vector: str, column: str) -> DataFrame:
        if not self.by_cell:
            return self._transformed(df, vector, column)
        x = vector_to_array(F.col(f"`{vector}`"))
        placed = df.select(F.struct("*").alias("_row"), x.alias("_v")).withColumn(
            "_cell", self.cell([F.col("_v")[i] for i in range(len(self.features))])
        )
        return placed.join(F.broadcast(self.cell_scores), "_cell", "left").select("_row.*", F.col("_p").alias(column))

    def _transformed(self, df: DataFrame, vector: str, column: str) -> DataFrame:
        kept = df.columns
        model = self.model.copy().setFeaturesCol(vector).setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        return model.transform(df).select(
            *[F.col(f"`{c}`") for c in kept], vector_to_array("_p")[1].alias(column)
        )

    def importances(self, spark: SparkSession) -> DataFrame:
        values = self.model.featureImportances.toArray()
        return literal_table(
            spark, [(f, float(v)) for f, v in zip(self.features, values)], "feature string, importance double"
        )

    def nodes(self, spark: SparkSession) -> DataFrame:
        """``(tree, node, feature, threshold, left, right, cover, value)`` of every node, as saved by MLlib."""
        path = scratch_path(spark, "forest")
        self.model.write().save(path)
        n = F.col("nodeData")
        stats = n["impurityStats"]
        total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
        return spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"),
            n["id"].alias("node"),
            n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            n["leftChild"].alias("left"),
            n["rightChild"].alias("right"),
            total.alias("cover"),
            (stats[1] / total).alias("value"),
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        splits = self.splits or [None] * len(self.features)
        rows = [(i, f, self.medians.get(f), s) for i, (f, s) in enumerate(zip(self.features, splits))]
        literal_table(spark, rows, SAVED_FEATURES).coalesce(1).write.mode("overwrite").json(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestDetector":
        model = RandomForestClassificationModel.load(f"{path}/model")
        rows = spark.read.schema(SAVED_FEATURES).json(f"{path}/features").orderBy("position").collect()
        splits = None if any(r["splits"] is None for r in rows) else tuple(tuple(r["splits"]) for r in rows)
        return ForestDetector(model, tuple(r["feature"] for r in rows), {r["feature"]: r["median"] for r in rows}, splits)


SAVED_FEATURES = "position int, feature string, median double, splits array<double>"


def train_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str = "label_binary",
    n_trees: int = N_TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
    medians: Mapping[str, float] | None = None,
) -> ForestDetector:
    """Balanced-weight forest on median-imputed features.

    Rows that no candidate split tells apart are counted together, and the trees grow on the counts, so only the passes that find
    splits and count grow with the rows. Rows of more than ``MOST_CELLS`` cells go to MLlib's training, in tasks of bounded size.
    """
    medians = dict(medians or collect_medians(train, features))
    y = F.col(f"`{label}`")
    sizes = {r["y"]: r["n"] for r in train.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sizes.get(None):
        raise ValueError(f"{sizes[None]} training rows have no {label}")
    total = sum(sizes.values())
    weights = {c: total / (len(sizes) * n) for c, n in sizes.items()}
    estimator = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=n_trees, maxDepth=max_depth, seed=seed,
        maxMemoryInMB=1024,
    )
    filled = impute(train.select(*[F.col(f"`{f}`") for f in features], y.cast("double").alias("_y")), medians)
    splits = candidate_splits(filled, features, estimator.getMaxBins())
    if sizes and all(c == int(c) >= 0 for c in sizes) and grid_size(splits) < 1 << 62:
        cell = cell_of([F.col(f"`{f}`").cast("double") for f in features], splits)
        cells = settle(
            filled.groupBy(cell.alias("cell"), F.col("_y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")), "forest-cells"
        )
        if cells.count() <= MOST_CELLS:
            by_class = [weights.get(c, 0.0) for c in range(int(max(sizes)) + 1)]
            return ForestDetector(fit_cells(estimator, cells, by_class, splits), tuple(features), medians, splits)
    weight = F.coalesce(*[F.when(F.col("_y") == F.lit(float(c)), F.lit(w)) for c, w in weights.items()])
    rows = filled.select(array_to_vector(feature_array(features)).alias("_x"), "_y", weight.alias("_w"))
    if total > ROWS_PER_TASK:
        rows = rows.repartition(-(-total // ROWS_PER_TASK))
    return ForestDetector(estimator.fit(rows), tuple(features), medians)


@dataclass(frozen=True)
class Leaf:
    """One leaf as the box of its path: features, bounds (low, high], share of cover kept, value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kept: np.ndarray
    value: float


def tree_leaves(nodes: pd.DataFrame) -> list[Leaf]:
    """The leaves of one tree with their paths."""
    at = {int(n): i for i, n in enumerate(nodes["node"])}
    columns = {c: nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "cover", "value")}
    leaves = []
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        i = at[node]
        left, right = int(columns["left"][i]), int(columns["right"][i])
        if left < 0:
            items = sorted(path.items())
            leaves.append(
                Leaf(
                    np.array([f for f, _ in items], dtype=np.int64),
                    np.array([b[0] for _, b in items]),
                    np.array([b[1] for _, b in items]),
                    np.array([b[2] for _, b in items]),
                    float(columns["value"][i]),
                )
            )
            continue
        feature, threshold = int(columns["feature"][i]), float(columns["threshold"][i])
        low, high, kept = path.get(feature, (-np.inf, np.inf, 1.0))
        share = columns["cover"][at[left]] / columns["cover"][i]
        stack.append((left, {**path, feature: (low, min(high, threshold), kept * share)}))
        stack.append((right, {**path, feature: (max(low, threshold), high, kept * (1 - share))}))
    return leaves


def shapley_values(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of one tree's output for each row of ``x``."""
    out = np.zeros(x.shape)
    TreeTables(leaves).add(x, out)
    return out


def expected_value(leaves: Sequence[Leaf]) -> float:
    return float(sum(leaf.value * leaf.kept.prod() for leaf in leaves))


#: Paths of at most this many features have a table of what each combination of features passed adds.
PATTERN_BITS = 6
LEAVES_TOGETHER = 128
ROWS_TOGETHER = 4096


def _pattern_table(leaves: Sequence[Leaf]) -> np.ndarray:
    """``[leaf, pattern, place]`` for leaves of equally long paths: what a row adds to the path's features by which of
    them it passes."""
    m = len(leaves[0].features)
    rows = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    return np.stack([_path_values(leaf, rows) for leaf in leaves])


def _path_values(leaf: Leaf, inside: np.ndarray) -> np.ndarray:
    """Contributions to the path's features for rows of 0 and 1: whether a row passes each feature.

    A leaf's Shapley integral over coalition size is a polynomial in one variable,
    so Gauss-Legendre nodes evaluate it exactly for all rows at once.
    """
    m = len(leaf.features)
    at, weight = np.polynomial.legendre.leggauss(m // 2 + 1)
    at, weight = (at + 1) / 2, weight / 2
    factors = leaf.kept[None, :, None] * (1 - at) + inside[:, :, None] * at
    rest = factors.prod(axis=1)[:, None, :] / factors
    return leaf.value * (inside - leaf.kept) * (rest @ weight)


class TreeTables:
    """One tree laid out for explaining many rows at once.

    A row is reduced to its place among the tree's thresholds of each feature. For every place and leaf a bit says
    whether the leaf's path is passed there, so the bits of a row, added up, are the number of the
    combination, and its contributions are looked up. Longer paths are evaluated once for each combination that occurs.
    """

    def __init__(self, leaves: Sequence[Leaf]):
        told = [leaf for leaf in leaves if len(leaf.features) and leaf.value != 0.0]
        self.features = sorted({int(f) for leaf in told for f in leaf.features})
        self.thresholds = {
            f: np.unique([b for leaf in told for g, lo, hi in zip(leaf.features, leaf.low, leaf.high) if g == f for b in (lo, hi) if np.isfinite(b)])
            for f in self.features
        }
        short = [leaf for leaf in told if len(leaf.features) <= PATTERN_BITS]
        self.long = [leaf for leaf in told if len(leaf.features) > PATTERN_BITS]
        self.chunks = [self._chunk(short[a : a + LEAVES_TOGETHER]) for a in range(0, len(short), LEAVES_TOGETHER)]

    def _passed(self, leaf: Leaf, place: int) -> np.ndarray:
        """For each place among the feature's thresholds whether it is inside the path's bounds."""
        t = self.thresholds[int(leaf.features[place])]
        first = np.searchsorted(t, leaf.low[place], side="right") if np.isfinite(leaf.low[place]) else 0
        last = np.searchsorted(t, leaf.high[place], side="left") if np.isfinite(leaf.high[place]) else len(t)
        places = np.arange(len(t) + 1)
        return (places >= first) & (places <= last)

    def _chunk(self, leaves: list[Leaf]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """({feature: bits by place and leaf}, {feature: contributions by leaf and combination})."""
        used = sorted({int(f) for leaf in leaves for f in leaf.features})
        bits = {f: np.zeros((len(self.thresholds[f]) + 1, len(leaves)), np.uint8) for f in used}
        values = {f: np.zeros((len(leaves), 1 << PATTERN_BITS)) for f in used}
        by_length: dict[int, list[int]] = {}
        for i, leaf in enumerate(leaves):
            by_length.setdefault(len(leaf.features), []).append(i)
        for m, some in by_length.items():
            for i, table in zip(some, _pattern_table([leaves[i] for i in some])):
                for place, f in enumerate(leaves[i].features.tolist()):
                    bits[f][:, i] = self._passed(leaves[i], place) << place
                    values[f][i, : 1 << m] = table[:, place]
        return bits, {f: v.ravel() for f, v in values.items()}

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds the contributions of this tree to ``out``."""
        places = {f: np.searchsorted(self.thresholds[f], x[:, f], side="left") for f in self.features}
        for bits, values in self.chunks:
            number = 0
            for f, b in bits.items():
                number = number + b[places[f]]
            number = number.astype(np.intp) + (np.arange(number.shape[1]) << PATTERN_BITS)
            for f, v in values.items():
                out[:, f] += v[number].sum(axis=1)
        for leaf in self.long:
            inside = np.stack([self._passed(leaf, i)[places[int(f)]] for i, f in enumerate(leaf.features)], axis=1)
            some, which = np.unique(inside, axis=0, return_inverse=True)
            out[:, leaf.features] += _path_values(leaf, some.astype(float))[which.ravel()]


class ForestTables:
    """All trees of a node table ``(tree, node, feature, threshold, left, right, cover, value)``."""

    def __init__(self, nodes: pd.DataFrame, n_trees: int, n_features: int):
        self.trees = [TreeTables(tree_leaves(tree)) for _, tree in nodes.groupby("tree")]
        self.n_trees, self.n_features = n_trees, n_features

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of each row's contributions, one column for each feature."""
        out = np.zeros((len(x), self.n_features))
        for a in range(0, len(x), ROWS_TOGETHER):
            for tree in self.trees:
                tree.add(x[a : a + ROWS_TOGETHER], out[a : a + ROWS_TOGETHER])
        return out / self.n_trees
