"""Repeatable samples of an exact size, chosen by hash rank and taken by a filter.

The rank cut of each class is found by counting (see ``order_stats``); the rows
themselves are neither sorted nor shuffled, whatever the class sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.operators.clean import impute
from driftgauge.operators.order_stats import (
    OrderCut,
    collect_medians,
    content_order,
    copies,
    order_cuts,
    to_long,
)
from driftgauge.functions.numeric import order_hash
from driftgauge.session import settle

SAMPLE_SIZE = 100_000
BENIGN_FRACTION = 0.9
SEED = 42


def _ordered(df: DataFrame, row_key: Sequence[str] | str | None, seed: int) -> tuple[DataFrame, list[str]]:
    keys = [row_key] if isinstance(row_key, str) else list(row_key or [])
    with_content = content_order(df, seed=seed)
    if not keys:
        return with_content, ["_order_1", "_order_2"]
    named = with_content.withColumn("_order_0", order_hash([F.col(f"`{k}`") for k in keys], seed))
    return named, ["_order_0", "_order_1", "_order_2"]


def _take(ordered: DataFrame, stratum: str, cuts: dict[object, OrderCut], columns: Sequence[str]) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in columns]
    if not cuts:
        return ordered.limit(0).select(*kept)
    here = {s: F.col(f"`{stratum}`") == F.lit(s) for s in cuts}
    inside = reduce(lambda a, b: a | b, [here[s] & cut.taken() for s, cut in cuts.items()])
    sample = ordered.where(inside).select(*kept)
    for s, cut in cuts.items():
        if cut.splits_ties:
            same = ordered.where(here[s] & cut.at()).groupBy(*kept).agg(F.count(F.lit(1)).alias("_copies"))
            sample = sample.unionByName(copies(same.withColumn("_copies", F.lit(cut.ties).cast("long")), "_copies"))
    return sample


def take_by_hash(
    df: DataFrame, stratum: str, sizes: dict, row_key: Sequence[str] | str | None = None, seed: int = SEED
) -> DataFrame:
    """Exactly ``sizes[s]`` rows of each stratum (all of a smaller one)."""
    ordered, order = _ordered(df, row_key, seed)
    return _take(ordered, stratum, order_cuts(ordered, stratum, sizes, order), df.columns)


@dataclass(frozen=True)
class AnomalySample:
    table: DataFrame
    features: list[str]
    medians: dict[str, float]
    n_benign: int
    n_attack: int
    benign_fraction: float
    seed: int

    @property
    def n_samples(self) -> int:
        return self.n_benign + self.n_attack

    def summary(self) -> dict:
        n = self.n_samples
        return {
            "n_samples": n,
            "n_benign": self.n_benign,
            "n_attack": self.n_attack,
            "benign_fraction_requested": self.benign_fraction,
            "benign_fraction_actual": self.n_benign / n if n else 0.0,
            "random_state": self.seed,
            "n_features": len(self.features),
        }


def benign_heavy_sample(
    train: DataFrame,
    features: Sequence[str],
    n_samples: int = SAMPLE_SIZE,
    benign_fraction: float = BENIGN_FRACTION,
    seed: int = SEED,
    label: str = "label_binary",
    row_key: Sequence[str] | str | None = None,
) -> AnomalySample:
    """A mostly benign sample of exact size, capped by each class, median-imputed.

    The sample is written once, so its many later uses do not go back to the whole table.
    """
    pools = {r["y"]: r["n"] for r in train.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_samples = min(n_samples, sum(pools.values()))
    want_benign = round(n_samples * benign_fraction)
    n_benign = min(want_benign, pools.get(0, 0))
    n_attack = min(n_samples - want_benign, pools.get(1, 0))
    sample = settle(take_by_hash(train, label, {0: n_benign, 1: n_attack}, row_key, seed), "anomaly-sample")
    medians = collect_medians(sample, features)
    table = impute(sample, {f: medians.get(f) for f in features})
    return AnomalySample(table, list(features), medians, n_benign, n_attack, benign_fraction, seed)


def balanced_sample(
    df: DataFrame, label: str, n_samples: int, seed: int = SEED, row_key: Sequence[str] | str | None = None
) -> DataFrame:
    """``n_samples`` rows spread evenly over the classes; a shortfall is filled from the other rows.

    Rows without a label count as one more class of which nothing is drawn, so its share is filled from all
    rows that are left, unlabelled ones among them.
    """
    if n_samples <= 0:
        return df.limit(0)
    name = F.col(f"`{label}`").cast("string")
    pools = {r["c"]: r["n"] for r in df.groupBy(name.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if n_samples >= sum(pools.values()):
        return df
    each, extra = divmod(n_samples, len(pools))
    pools.pop(None, None)
    sizes = {c: min(pools[c], each + (1 if i < extra else 0)) for i, c in enumerate(sorted(pools))}
    short = n_samples - sum(sizes.values())
    ordered, order = _ordered(df, row_key, seed)
    ordered = ordered.withColumns({"_class": name, "_all": F.lit(0)})
    first_cuts = order_cuts(ordered, "_class", sizes, order)
    if not short:
        return _take(ordered, "_class", first_cuts, df.columns)
    # What the first cuts left over, copies of tied rows included, fills the shortfall.
    untouched = reduce(
        lambda a, b: a | b,
        [F.col("_class").eqNullSafe(F.lit(c)) & ~(cut.before() | cut.at()) for c, cut in first_cuts.items()],
        F.col("_class").isNull(),
    )
    rest = ordered.where(untouched)
    every = [F.col(f"`{c}`") for c in ordered.columns]
    for c, cut in first_cuts.items():
        if cut.splits_ties:
            same = ordered.where((F.col("_class") == F.lit(c)) & cut.at()).groupBy(*every).agg(
                F.count(F.lit(1)).alias("_copies")
            )
            rest = rest.unionByName(copies(same.withColumn("_copies", F.col("_copies") - cut.ties), "_copies"))
    fill_cut = order_cuts(rest, "_all", {0: short}, order)
    head = _take(ordered, "_class", first_cuts, df.columns)
    return head.unionByName(_take(rest, "_all", fill_cut, df.columns))


def capped_sample(
    df: DataFrame,
    features: Sequence[str],
    cap: int,
    by: str,
    seed: int = SEED,
    row_key: Sequence[str] | str | None = None,
) -> DataFrame:
    """``(by, feature, value)``: at most ``cap`` present values of each feature and group."""
    ordered, order = _ordered(df, row_key, seed)
    long = to_long(ordered, features, [by, *order]).withColumn(
        "_stratum", F.concat_ws("\x1f", F.col(f"`{by}`").cast("string"), "feature")
    )
    sizes = {r["_stratum"]: min(r["n"], cap) for r in long.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [s for s, n in sizes.items() if n < cap]
    cuts = order_cuts(long.where(~F.col("_stratum").isin(whole)) if whole else long, "_stratum",
                      {s: n for s, n in sizes.items() if s not in whole}, order)
    columns = [by, "feature", "value"]
    parts = _take(long, "_stratum", cuts, columns) if cuts else None
    if whole:
        rest = long.where(F.col("_stratum").isin(whole)).select(*[F.col(f"`{c}`") for c in columns])
        parts = rest if parts is None else parts.unionByName(rest)
    return parts if parts is not None else long.select(*[F.col(f"`{c}`") for c in columns])
