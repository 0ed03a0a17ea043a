"""Integrity checks that stop a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions.numeric import finite


def nonfinite_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, n_not_finite)`` from one aggregate."""
    counts = df.agg(*[F.count_if(finite(F.col(f"`{c}`")).isNull()).alias(f"n{i}") for i, c in enumerate(features)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_not_finite")) for i, c in enumerate(features)]
    return counts.select(F.inline(F.array(*rows)))


def assert_finite(df: DataFrame, features: Sequence[str]) -> None:
    bad = {r["feature"]: r["n_not_finite"] for r in nonfinite_counts(df, features).where("n_not_finite > 0").collect()}
    if bad:
        raise ValueError(f"missing or infinite values remain after imputation: {bad}")


def assert_feature_alignment(features: Sequence[str], fitted: Sequence[str] | None, context: str = "model") -> bool:
    """The ordered feature list must be the one the model was fitted on; False if the model has none."""
    if fitted is None:
        return False
    if list(features) != list(fitted):
        raise AssertionError(f"{context}: features {list(features)} differ from fitted {list(fitted)}")
    return True


def assert_features_present(features: Sequence[str], **tables: DataFrame) -> None:
    missing = {name: [f for f in features if f not in df.columns] for name, df in tables.items()}
    missing = {name: absent for name, absent in missing.items() if absent}
    if missing:
        raise KeyError(f"required features missing: {missing}")


def assert_no_split_key(features: Sequence[str], *split_keys: str) -> None:
    found = [f for f in features if f in split_keys]
    if found:
        raise AssertionError(f"split keys among the features: {found}")


def assert_labelled(df: DataFrame, label: str = "label_binary") -> None:
    unknown = df.agg(F.count_if(F.col(f"`{label}`").isNull()).alias("n")).first()["n"]
    if unknown:
        raise ValueError(f"{unknown} rows have no {label}")
