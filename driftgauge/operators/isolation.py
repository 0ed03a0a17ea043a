"""Isolation forest: trees grown one per group of a fixed-size subsample, scored by look-ups or a vectorised walk."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.clean import impute
from driftgauge.operators.forest import feature_array
from driftgauge.operators.order_stats import exact_quantiles
from driftgauge.operators.sampling import AnomalySample, benign_heavy_sample
from driftgauge.session import literal_table, settle

# The anomaly detector's settings.
N_TREES = 100
SUBSAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
#: Entries of one tree's look-up table, a byte each with 256 bottom cells at most; a tree that needs more is walked.
TABLE_ENTRIES = 1 << 17

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, tree: int, seed: int, max_depth: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    pending = [(np.arange(len(x)), 0, -1, 0)]
    while pending:
        members, depth, parent, side = pending.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = me
        node = [tree, me, -1, None, -1, -1, len(members), depth]
        nodes.append(node)
        if depth >= max_depth or len(members) <= 1:
            continue
        here = x[members]
        low, high = here.min(axis=0), here.max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(varying) == 0:
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = here[:, feature] <= threshold
        node[2], node[3] = feature, threshold
        pending.append((members[~goes_left], depth + 1, me, 1))
        pending.append((members[goes_left], depth + 1, me, 0))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


@dataclass(frozen=True)
class TreeArrays:
    """All trees as complete binary trees of one depth, so a step down is arithmetic.

    Below a leaf that ends early every test goes left, to a bottom cell with the leaf's path length.
    """

    feature: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    depth: int
    scale: float

    @staticmethod
    def of(nodes: pd.DataFrame, subsample: int) -> "TreeArrays":
        depth = max(int(nodes["depth"].max()), 1)
        trees = sorted(nodes["tree"].unique())
        feature = np.zeros((len(trees), 2**depth - 1), dtype=np.int64)
        threshold = np.full(feature.shape, np.inf)
        length = np.zeros((len(trees), 2**depth))
        for t, tree in enumerate(trees):
            rows = nodes[nodes["tree"] == tree].set_index("node")
            path = rows["depth"] + average_path(rows["size"].to_numpy())
            stack = [(0, 0)]
            while stack:
                node, at = stack.pop()
                level = int(rows.at[node, "depth"])
                if rows.at[node, "left"] >= 0:
                    feature[t, at], threshold[t, at] = rows.at[node, "feature"], rows.at[node, "threshold"]
                    stack += [(rows.at[node, "left"], 2 * at + 1), (rows.at[node, "right"], 2 * at + 2)]
                else:
                    bottom = (at + 1) * 2 ** (depth - level) - 1 - (2**depth - 1)
                    length[t, bottom] = path[node]
        return TreeArrays(feature, threshold, length, depth, float(average_path(subsample)))

    @cached_property
    def edges(self) -> list[np.ndarray]:
        """The different thresholds of each feature over all trees."""
        split = np.isfinite(self.threshold)
        last = int(self.feature[split].max(initial=-1))
        return [np.unique(self.threshold[split & (self.feature == f)]) for f in range(last + 1)]

    @cached_property
    def tables(self) -> list[tuple | None]:
        return [_tree_tables(f, t, n, self.edges) for f, t, n in zip(self.feature, self.threshold, self.length)]

    def parts(self) -> tuple:
        """Plain arrays and numbers, as they are broadcast."""
        return self.feature, self.threshold, self.length, self.depth, self.scale, self.edges, self.tables

    def score(self, x: np.ndarray) -> np.ndarray:
        return _score_trees(self.parts(), x)


def _tree_tables(feature: np.ndarray, threshold: np.ndarray, length: np.ndarray, edges: Sequence[np.ndarray]) -> tuple | None:
    """A complete tree as look-ups: ``(halves, codes, path length by code)``, or None if they would be too large.

    The features are dealt to two halves. A row's places among the thresholds of a half's features say which bottom cells that
    half leaves open; the sets of both halves have one cell in common. A half is ``([(feature, step by place in edges)], number of
    the set by sum of steps)``, and the code of the path length stands at the sum of both numbers.
    """
    split = np.isfinite(threshold)
    used = {f: np.unique(threshold[split & (feature == f)]) for f in np.unique(feature[split]).tolist()}
    dealt, sizes = ([], []), [1, 1]
    for f in sorted(used, key=lambda f: -len(used[f])):
        half = int(sizes[1] < sizes[0])
        dealt[half].append(f)
        sizes[half] *= len(used[f]) + 1
    if max(sizes) * len(length) > 32 * TABLE_ENTRIES:
        return None
    possible = np.ones((1, len(length)), dtype=bool)
    open_at = {f: np.ones((len(t) + 1, len(length)), dtype=bool) for f, t in used.items()}
    for i, (f, t) in enumerate(zip(feature.tolist(), threshold.tolist())):
        level = (i + 1).bit_length() - 1
        width = len(length) >> level
        first = (i + 1 - (1 << level)) * width
        left, right = slice(first, first + width // 2), slice(first + width // 2, first + width)
        if math.isfinite(t):
            place = int(np.searchsorted(used[f], t))
            open_at[f][place + 1 :, left] = open_at[f][: place + 1, right] = False
        else:
            possible[:, right] = False
    halves, sets = [], []
    for some in dealt:
        found = possible
        for f in some:
            found = (found[:, None] & open_at[f][None]).reshape(-1, len(length))
        packed = np.packbits(found, axis=1)
        _, one, number = np.unique(packed, axis=0, return_index=True, return_inverse=True)
        step, moves = len(found), []
        for f in some:
            step //= len(used[f]) + 1
            below = np.searchsorted(np.searchsorted(edges[f], used[f]), np.arange(len(edges[f]) + 1))
            moves.append((f, below * step))
        halves.append((moves, number.ravel()))
        sets.append(found[one])
    a, b = sets
    if len(a) * len(b) > TABLE_ENTRIES:
        return None
    halves[0] = (halves[0][0], halves[0][1] * len(b))
    lengths, code = np.unique(length, return_inverse=True)
    # one cell is left of each pair, so a sum over the cells is its code
    codes = (a * code.astype(float)) @ b.T.astype(float)
    return halves, codes.astype(np.min_scalar_type(len(lengths))).ravel(), lengths


def _score_trees(parts: tuple, x: np.ndarray) -> np.ndarray:
    features, thresholds, lengths, depth, scale, edges, tables = parts
    flat, first = np.ascontiguousarray(x, dtype=float).ravel(), np.arange(len(x)) * x.shape[1]
    total, places = np.zeros(len(x)), []
    if any(tables):
        # a missing value is above no threshold
        places = [np.searchsorted(e, np.where(np.isnan(v), -np.inf, v)) for e, v in zip(edges, flat.reshape(x.shape).T)]
    for feature, threshold, length, table in zip(features, thresholds, lengths, tables):
        if table:
            halves, codes, by_code = table
            at = [
                number.take(reduce(np.add, [move.take(places[f], mode="clip") for f, move in moves] or [0]), mode="clip")
                for moves, number in halves
            ]
            total += by_code.take(codes.take(at[0] + at[1], mode="clip"), mode="clip")
            continue
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            right = flat.take(first + feature.take(at)) > threshold.take(at)
            at = 2 * at + 1 + right
        total += length.take(at - (2**depth - 1))
    return np.power(2.0, -total / (len(features) * scale))


@dataclass(frozen=True)
class AnomalyDetector:
    nodes: DataFrame
    features: tuple[str, ...]
    medians: Mapping[str, float]
    subsample: int
    contamination: float = CONTAMINATION
    n_trees: int = N_TREES
    seed: int = SEED
    n_training: int = 0
    offset: float | None = None
    low: float | None = None
    high: float | None = None

    @cached_property
    def arrays(self) -> TreeArrays:
        """The node table, at most ``n_trees * (2 * subsample - 1)`` rows, as arrays for the tasks."""
        bound = self.n_trees * (2 * self.subsample - 1)
        rows = self.nodes.limit(bound + 1).toPandas()
        if len(rows) > bound:
            raise ValueError(f"more than {bound} nodes: the node table does not belong to this model")
        return TreeArrays.of(rows, self.subsample)

    def raw_score(self, spark: SparkSession, values: Sequence[Column]) -> Column:
        """Raw score in (0, 1] of imputed feature values; higher is more anomalous."""
        shared = spark.sparkContext.broadcast(self.arrays.parts())

        @F.pandas_udf(T.DoubleType())
        def walk(*x: pd.Series) -> pd.Series:
            return pd.Series(_score_trees(shared.value, np.stack(x, axis=1)) if len(x[0]) else [], dtype=float)

        return walk(*values)

    def perturbation(self, spark: SparkSession, vector: Column, reference: Sequence[float]) -> Column:
        """Array of score changes when one feature at a time is set to its reference value."""
        shared = spark.sparkContext.broadcast((self.arrays.parts(), np.asarray(reference, dtype=float)))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def changes(x: pd.Series) -> pd.Series:
            trees, centre = shared.value
            values = np.stack(x.to_numpy()).astype(float)
            base = _score_trees(trees, values)
            out = np.empty_like(values)
            for j in range(values.shape[1]):
                kept = values[:, j].copy()
                values[:, j] = centre[j]
                out[:, j] = base - _score_trees(trees, values)
                values[:, j] = kept
            return pd.Series(list(out))

        return changes(vector)

    def score_raw(self, df: DataFrame, column: str = "anomaly_raw") -> DataFrame:
        filled = impute(df.select(*[F.col(f"`{f}`") for f in self.features], F.struct("*").alias("_row")), self.medians)
        score = self.raw_score(df.sparkSession, [F.col(f"`{f}`").cast("double") for f in self.features])
        return filled.select("_row", score.alias(column)).select("_row.*", column)

    def score(self, df: DataFrame, column: str = "anomaly_score") -> DataFrame:
        """Scores scaled to [0, 1] over the whole batch; a constant batch scores 0.

        The raw scores are written once and read twice (extremes, then scaling);
        with frozen extremes (see :meth:`freeze_range`) there is no first pass.
        """
        raw = self.score_raw(df, "_raw")
        low, high = self.low, self.high
        if low is None or high is None:
            raw = settle(raw, "anomaly-raw")
            ends = raw.agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).first()
            low, high = ends["lo"], ends["hi"]
        return raw.withColumn(column, scale_to_unit(F.col("_raw"), low, high)).drop("_raw")

    def freeze_range(self, df: DataFrame) -> "AnomalyDetector":
        """Fix the scaling range to this table's extremes, so later scores keep their meaning."""
        ends = self.score_raw(df, "_raw").agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).first()
        return replace(self, low=ends["lo"], high=ends["hi"])

    def config(self) -> dict:
        return {
            "model_type": "IsolationForest",
            "contamination": self.contamination,
            "n_estimators": self.n_trees,
            "random_state": self.seed,
            "n_training_samples": self.n_training,
            "n_features": len(self.features),
        }

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(i, f, self.medians.get(f)) for i, f in enumerate(self.features)]
        literal_table(spark, rows, "position int, feature string, median double").coalesce(1).write.mode(
            "overwrite"
        ).json(f"{path}/features")
        facts = [(self.subsample, self.contamination, self.n_trees, self.seed, self.n_training, self.offset, self.low, self.high)]
        literal_table(spark, facts, FACTS_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyDetector":
        rows = spark.read.schema("position int, feature string, median double").json(f"{path}/features")
        rows = rows.orderBy("position").collect()
        facts = spark.read.schema(FACTS_SCHEMA).json(f"{path}/facts").first()
        return AnomalyDetector(
            spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"),
            tuple(r["feature"] for r in rows),
            {r["feature"]: r["median"] for r in rows},
            **facts.asDict(),
        )


FACTS_SCHEMA = (
    "subsample int, contamination double, n_trees int, seed int, n_training bigint, "
    "offset double, low double, high double"
)


def scale_to_unit(score: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or high - low < 1e-12:
        return F.when(score.isNotNull(), F.lit(0.0))
    return (score - F.lit(low)) / F.lit(high - low)


def train_isolation_forest(
    sample: AnomalySample,
    contamination: float = CONTAMINATION,
    n_trees: int = N_TREES,
    seed: int = SEED,
    subsample: int = SUBSAMPLE,
    row_key: Sequence[str] | str | None = None,
) -> AnomalyDetector:
    """Grow each tree on its own hash-chosen subsample of the sample, one small group per tree.

    A hash threshold with a wide margin thins each tree's candidates before they
    are ranked, so the rows sent to a tree stay near the subsample size.
    """
    table, features = sample.table, sample.features
    n = sample.n_samples
    if n < 1:
        raise ValueError("an empty sample cannot train an isolation forest")
    psi = min(subsample, n)
    max_depth = max(1, math.ceil(math.log2(max(psi, 2))))
    keys = [row_key] if isinstance(row_key, str) else list(row_key or table.columns)
    # The sample is bounded, so one task can number it; copies of a row then have numbers of their own.
    seat = Window.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys]), *[F.col(f"`{k}`") for k in keys], "x")
    seats = settle(
        table.select(feature_array(features).alias("x"), *[F.col(f"`{k}`") for k in keys if k != "x"])
        .select("x", F.row_number().over(seat).alias("seat")),
        "isolation-seats",
    )
    ticket = F.xxhash64(F.lit(seed), "tree", "seat")
    share = min(1.0, (psi + 8.0 * math.sqrt(psi)) / n)
    thinned = (
        seats.select("x", "seat", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
        .withColumn("ticket", ticket)
        .select("tree", "x", "ticket", (F.pmod("ticket", F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u"))
        .where(F.col("u") <= share)
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy("u", "ticket", "x"))
    chosen = thinned.withColumn("place", place).where(F.col("place") <= psi).select("tree", "x")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(rows["x"].to_numpy())
        values = values[np.lexsort(values.T[::-1])]
        return _grow(values, int(key[0]), seed, max_depth)

    nodes = settle(chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA), "isolation-nodes")
    detector = AnomalyDetector(
        nodes, tuple(features), dict(sample.medians), psi, contamination, n_trees, seed, n
    )
    raw = settle(detector.score_raw(table.select(*[F.col(f"`{f}`") for f in features]), "raw").select("raw"), "raw")
    # The share of training rows beyond the offset is the contamination.
    offset = exact_quantiles(raw, ["raw"], {"offset": 1.0 - contamination}).first()["offset"]
    return replace(detector, offset=offset)


def rewrap_detector(
    detector: AnomalyDetector, train: DataFrame, label: str = "label_binary",
    row_key: Sequence[str] | str | None = None, **sampling,
) -> AnomalyDetector:
    """The frozen trees with the training-sample medians recomputed; nothing is fitted."""
    missing = [f for f in detector.features if f not in train.columns]
    if missing:
        raise KeyError(f"training table lacks {len(missing)} required features: {missing[:10]}")
    sample = benign_heavy_sample(train, detector.features, label=label, row_key=row_key, seed=detector.seed, **sampling)
    return replace(detector, medians=sample.medians, n_training=sample.n_samples)
