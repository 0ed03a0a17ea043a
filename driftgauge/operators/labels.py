"""Label columns: normalisation, mapping tables and the background policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions import labels as L

BACKGROUND_POLICIES = ("exclude", "treat_as_benign", "treat_as_malicious")


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise KeyError(f"column {column!r} not found in {df.columns}")


def normalize_labels(
    df: DataFrame,
    label: str,
    benign_aliases: Sequence[str] = L.BENIGN_ALIASES,
    blank_is_missing: bool = True,
) -> DataFrame:
    """Keeps the original as ``label_multiclass_raw``, rewrites the label to its canonical
    spelling, and adds ``label_multiclass`` and ``label_binary``. One projection, no shuffle."""
    _require(df, label)
    raw = F.col(f"`{label}`")
    return df.withColumns({"label_multiclass_raw": raw, "label_multiclass": L.canonical_label(raw)}).withColumns(
        {
            label: F.col("label_multiclass"),
            "label_binary": L.binary_label(F.col("label_multiclass"), benign_aliases, blank_is_missing),
        }
    )


def label_log(normalized: DataFrame) -> DataFrame:
    """What normalisation did, as ``(operator, column, n_affected, message)``, from one aggregate."""
    raw = F.col("label_multiclass_raw").cast("string")
    text, canonical = L.strip(raw), F.col("label_multiclass")
    counts = normalized.agg(
        F.count_if(raw != text).alias("stripped surrounding blanks"),
        F.count_if(~text.eqNullSafe(canonical)).alias("rewrote to the canonical spelling"),
        F.count_if(F.col("label_binary") == 0).alias("benign rows"),
        F.count_if(F.col("label_binary") == 1).alias("attack rows"),
        F.count_if(canonical == L.MISSING_LABEL).alias("missing labels"),
        F.count_if(canonical == "").alias("blank labels left unknown"),
        F.count_distinct(canonical).alias("distinct canonical labels"),
    )
    rows = [
        F.struct(
            F.lit("normalize_labels").alias("operator"),
            F.lit("label_multiclass").alias("column"),
            F.col(f"`{c}`").alias("n_affected"),
            F.lit(c).alias("message"),
        )
        for c in counts.columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def label_mapping(normalized: DataFrame) -> DataFrame:
    """One row for each original label: its binary and canonical values and row count."""
    return (
        normalized.groupBy(
            F.col("label_multiclass_raw").alias("original_label"),
            F.col("label_binary").alias("mapped_binary_label"),
            F.col("label_multiclass").alias("mapped_multiclass_label"),
        )
        .agg(F.count(F.lit(1)).alias("sample_count"))
        .orderBy(F.col("sample_count").desc(), "original_label")
    )


def _is_background(column, aliases: Sequence[str]):
    return F.coalesce(F.lower(L.strip(column.cast("string"))).isin(*aliases), F.lit(False))


def background_policy(
    df: DataFrame,
    original_label: str,
    policy: str = "exclude",
    aliases: Sequence[str] = L.BACKGROUND_ALIASES,
    binary: str = "label_binary",
) -> DataFrame:
    """Rows of the background class are dropped, or forced to benign or attack."""
    if policy not in BACKGROUND_POLICIES:
        raise ValueError(f"unknown background policy {policy!r}; choose one of {BACKGROUND_POLICIES}")
    _require(df, original_label)
    background = _is_background(F.col(f"`{original_label}`"), aliases)
    if policy == "exclude":
        return df.where(~background)
    forced = 0 if policy == "treat_as_benign" else 1
    return df.withColumn(binary, F.when(background, F.lit(forced)).otherwise(F.col(binary)).cast("int"))


def background_report(
    df: DataFrame, original_label: str, policy: str = "exclude", aliases: Sequence[str] = L.BACKGROUND_ALIASES
) -> DataFrame:
    background = _is_background(F.col(f"`{original_label}`"), aliases)
    used = F.count_if(~background) if policy == "exclude" else F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(background).alias("n_background"),
        used.alias("n_used"),
    ).withColumn("policy", F.lit(policy))


def check_benign_aliases(aliases: Sequence[str]) -> None:
    clash = {a.strip().lower() for a in aliases} & set(L.BACKGROUND_ALIASES)
    if clash:
        raise ValueError(f"{sorted(clash)} is handled by the background policy, not as a benign spelling")


def family_label(df: DataFrame, detailed: str | None = "detailedlabel") -> DataFrame:
    """``family``: the detailed label where there is one, else the canonical label."""
    if detailed and detailed in df.columns:
        return df.withColumn("family", F.coalesce(F.col(f"`{detailed}`"), F.col("label_multiclass")))
    return df.withColumn("family", F.col("label_multiclass"))
