"""Cells of a feature space: rows that no candidate split tells apart are one cell.

A tree sees nothing of a row but on which side of each split it lies. So a forest can be grown on counts by cell, and
what it says of a row it says of the row's cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.session import scratch_path

Splits = tuple[tuple[float, ...], ...]

#: Cells whose counts a task holds to grow a tree, 24 MB with two classes.
MOST_CELLS = 1 << 20
#: Rank error of a candidate split, a tenth of a bin.
RANK_ERROR = 0.003
NODES_TOGETHER = 4096


def candidate_splits(rows: DataFrame, names: Sequence[str], max_bins: int) -> Splits:
    """Thresholds of each feature, from all rows: between its values if they are few, else ``max_bins`` quantiles."""
    cols = [F.col(f"`{c}`") for c in names]
    facts = rows.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(names)) if facts[f"n{i}"] <= 2 * max_bins]
    found = rows.agg(*[F.collect_set(cols[i]).alias(f"v{i}") for i in few]).first() if few else {}
    values = {i: sorted(found[f"v{i}"]) for i in few}
    many = [i for i in range(len(names)) if len(values.get(i, ())) > max_bins or i not in values]
    shares = [k / max_bins for k in range(1, max_bins)]
    cuts = rows.select(*[cols[i].alias(f"q{i}") for i in many]).approxQuantile([f"q{i}" for i in many], shares, RANK_ERROR) if many else []
    quantiles = dict(zip(many, cuts))
    return tuple(
        tuple(sorted({float(q) for q in quantiles[i]})) if i in quantiles
        else tuple((a + b) / 2 for a, b in zip(values[i], values[i][1:]))
        for i in range(len(names))
    )


def grid_size(splits: Splits) -> int:
    return math.prod(len(s) + 1 for s in splits)


def _place(value: Column, thresholds: Sequence[float], first: int = 0) -> Column:
    """How many thresholds are below ``value``, by halving."""
    if not thresholds:
        return F.lit(first)
    half = len(thresholds) // 2
    return F.when(value <= F.lit(thresholds[half]), _place(value, thresholds[:half], first)).otherwise(
        _place(value, thresholds[half + 1 :], first + half + 1)
    )


def cell_of(values: Sequence[Column], splits: Splits) -> Column:
    """The number of a row's cell; a missing value stops the job, as it would in a vector."""
    cell = F.lit(0).cast("long")
    for value, thresholds in zip(values, splits):
        cell = cell * (len(thresholds) + 1) + _place(value, thresholds)
    missing = F.raise_error(F.lit("a feature is missing and has no median")).cast("long")
    unknown = F.lit(False)
    for value in values:
        unknown = unknown | value.isNull()
    return F.when(unknown, missing).otherwise(cell)


def places_of(cell: Column, splits: Splits) -> list[Column]:
    """The place in each feature's thresholds of the cell with a number."""
    out, rest = [], cell
    for thresholds in reversed(splits):
        size = F.lit(len(thresholds) + 1).cast("long")
        out.append(F.pmod(rest, size).cast("int"))
        rest = ((rest - F.pmod(rest, size)) / size).cast("long")
    return out[::-1]


def representative(cell: Column, splits: Splits) -> Column:
    """An array of feature values that lies in a cell: its upper edges."""
    edges = [F.array(*[F.lit(float(t)) for t in (*s, math.inf)]) for s in splits]
    return F.array(*[F.get(e, p) for e, p in zip(edges, places_of(cell, splits))])


def _gini(stats: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 1.0 - ((stats / np.maximum(total, 1e-300)) ** 2).sum(0)


def _best_splits(at, places, weighted, raw, n_nodes, sizes, allowed):
    """(gain, feature, split) of each node's best split among the features it may use; -inf without one."""
    best = np.full(n_nodes, -np.inf)
    feature, split = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        slot = at * size + places[:, f]
        sums = lambda w: np.cumsum(np.bincount(slot, w, n_nodes * size).reshape(n_nodes, size), axis=1)
        count, stats = sums(raw), np.stack([sums(w) for w in weighted])
        left, whole = stats[:, :, :-1], stats[:, :, -1:]
        n_left, n_whole = left.sum(0), whole.sum(0)
        n_right = n_whole - n_left
        gain = _gini(whole, n_whole) - (n_left * _gini(left, n_left) + n_right * _gini(whole - left, n_right)) / np.maximum(n_whole, 1e-300)
        possible = (count[:, :-1] >= 1) & (count[:, -1:] - count[:, :-1] >= 1) & allowed[:, f : f + 1]
        gain = np.where(possible, gain, -np.inf)
        here = gain.argmax(1)
        value = gain[np.arange(n_nodes), here]
        better = value > best
        best[better], feature[better], split[better] = value[better], f, here[better]
    return best, feature, split


def grow_tree(places: np.ndarray, counts: np.ndarray, weights: np.ndarray, splits: Splits, max_depth: int, subset: int, rng) -> pd.DataFrame:
    """One tree on a bootstrap of the rows behind ``counts`` (one line for each cell, one column for each class).

    A row enters Poisson(1) times, so the rows of a cell and class enter Poisson(their number) times. Gini impurity of weighted
    classes, ``subset`` features drawn for each node, at least one row on each side; leaves below one node that predict the
    same class are joined: the rules of MLlib's forest.
    """
    drawn = rng.poisson(counts).astype(float)
    if not drawn.any():
        drawn = counts.astype(float)
    inside = drawn.sum(1) > 0
    places, drawn = places[inside], drawn[inside]
    weighted, raw = (drawn * weights).T.copy(), drawn.sum(1)
    sizes, k = [len(s) + 1 for s in splits], len(weights)
    members, at, first, n_nodes = np.arange(len(places)), np.zeros(len(places), np.int64), 0, 1
    levels = []
    for depth in range(max_depth + 1):
        stats = np.stack([np.bincount(at, w[members], n_nodes) for w in weighted], axis=1)
        level = {
            "stats": stats, "raw": np.bincount(at, raw[members], n_nodes), "gain": np.full(n_nodes, -1.0),
            "feature": np.full(n_nodes, -1), "split": np.full(n_nodes, -1), "left": np.full(n_nodes, -1), "right": np.full(n_nodes, -1),
        }
        levels.append(level)
        if depth == max_depth:
            break
        order = np.argsort(at, kind="stable")
        members, at = members[order], at[order]
        for a in range(0, n_nodes, NODES_TOGETHER):
            b = min(n_nodes, a + NODES_TOGETHER)
            i, j = np.searchsorted(at, [a, b])
            some = members[i:j]
            allowed = np.argsort(np.argsort(rng.random((b - a, len(sizes))), axis=1), axis=1) < subset
            gain, feature, split = _best_splits(at[i:j] - a, places[some], weighted[:, some], raw[some], b - a, sizes, allowed)
            found = gain > 1e-12
            for name, value in (("gain", gain), ("feature", feature), ("split", split)):
                level[name][a:b][found] = value[found]
        inner = np.flatnonzero(level["feature"] >= 0)
        if not len(inner):
            break
        first += n_nodes
        level["left"][inner] = first + 2 * np.arange(len(inner))
        level["right"][inner] = level["left"][inner] + 1
        going = level["feature"][at] >= 0
        members, at = members[going], at[going]
        right = places[members, level["feature"][at]] > level["split"][at]
        at, n_nodes = level["left"][at] - first + right, 2 * len(inner)
    nodes = {name: np.concatenate([level[name] for level in levels]) for name in levels[0]}
    stats, left, right = nodes["stats"], nodes["left"], nodes["right"]
    prediction = stats.argmax(1)
    ends = np.cumsum([len(level["raw"]) for level in levels])
    rows = [np.arange(end - len(level["raw"]), end) for level, end in zip(levels, ends)]
    for here in reversed(rows):
        here = here[left[here] >= 0]
        same = (left[left[here]] < 0) & (left[right[here]] < 0) & (prediction[left[here]] == prediction[right[here]])
        left[here[same]] = right[here[same]] = -1
    kept = np.arange(len(left)) == 0
    for here in rows:
        here = here[kept[here] & (left[here] >= 0)]
        kept[left[here]] = kept[right[here]] = True
    number = np.cumsum(kept) - 1
    left, right, stats = left[kept], right[kept], stats[kept]
    leaf = left < 0
    feature = np.where(leaf, -1, nodes["feature"][kept])
    edges = np.zeros((len(sizes), max(sizes)))
    for f, thresholds in enumerate(splits):
        edges[f, : len(thresholds)] = thresholds
    return pd.DataFrame(
        {
            "id": number[kept], "prediction": prediction[kept].astype(float), "impurity": _gini(stats.T, stats.sum(1)),
            "rawCount": nodes["raw"][kept].astype(np.int64), "gain": np.where(leaf, -1.0, nodes["gain"][kept]),
            "leftChild": np.where(leaf, -1, number[left]), "rightChild": np.where(leaf, -1, number[right]),
            "feature": feature, "threshold": np.where(leaf, 0.0, edges[feature, nodes["split"][kept]]),
            **{f"s{c}": stats[:, c] for c in range(len(weights))},
        }
    )


def fit_cells(
    estimator: RandomForestClassifier, cells: DataFrame, class_weights: Sequence[float], splits: Splits
) -> RandomForestClassificationModel:
    """The forest of ``estimator`` from ``(cell, y, n)``: how many rows of class ``y`` each cell holds.

    Every task grows one tree on its own bootstrap of the counts. The trees become a model in MLlib's saved form.
    """
    spark = cells.sparkSession
    held = cells.toPandas()
    numbers, line = np.unique(held["cell"].to_numpy(), return_inverse=True)
    counts = np.zeros((len(numbers), len(class_weights)), np.int64)
    np.add.at(counts, (line, held["y"].to_numpy()), held["n"].to_numpy())
    places = np.stack(np.unravel_index(numbers, [len(s) + 1 for s in splits]), axis=1).astype(np.int16)
    n_trees, max_depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    shared = spark.sparkContext.broadcast((places, counts, np.asarray(class_weights, float)))
    names = [f"s{c}" for c in range(len(class_weights))]
    flat = (
        "tree int, id int, prediction double, impurity double, rawCount long, gain double, leftChild int, rightChild int, "
        "feature int, threshold double, " + ", ".join(f"{n} double" for n in names)
    )
    subset = len(splits) if n_trees == 1 else math.ceil(math.sqrt(len(splits)))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                nodes = grow_tree(*shared.value, splits, max_depth, subset, np.random.default_rng([seed, int(tree)]))
                nodes.insert(0, "tree", int(tree))
                yield nodes

    nodes = spark.range(0, n_trees, 1, n_trees).mapInPandas(grow, flat)
    # one row for each class gives the model its form: trees, classes, features and settings
    one = [(Vectors.dense([float(c)] * len(splits)), float(c), 1.0) for c in range(len(class_weights))]
    path = scratch_path(spark, "cell-forest")
    rows = spark.createDataFrame(one, [estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getWeightCol()])
    estimator.fit(rows).write().save(path)
    threshold = F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    split = F.struct(
        F.col("feature").alias("featureIndex"), threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")
    )
    nodes.select(
        F.col("tree").alias("treeID"),
        F.struct(
            "id", "prediction", "impurity", F.array(*names).alias("impurityStats"), "rawCount", "gain", "leftChild", "rightChild",
            split.alias("split"),
        ).alias("nodeData"),
    ).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
