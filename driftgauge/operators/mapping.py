"""Foreign datasets brought onto the frozen feature list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.functions.names import feature_key, feature_key_column
from driftgauge.functions.numeric import coerce_number, finite, ieee_divide, is_infinite

# Fixed value: connection durations are seconds, flow durations microseconds.
DURATION_FACTOR = 1_000_000.0

# Flow features taken straight from one connection-log field.
DIRECT_FEATURES = {
    "Flow Duration": "duration",
    "Total Fwd Packets": "orig_pkts",
    "Total Backward Packets": "resp_pkts",
    "Total Length of Fwd Packets": "orig_bytes",
    "Total Length of Bwd Packets": "resp_bytes",
}

# Derived flow features as (summed numerator fields, divisor field).
DERIVED_FEATURES = {
    "Flow Bytes/s": (("orig_bytes", "resp_bytes"), "duration"),
    "Flow Packets/s": (("orig_pkts", "resp_pkts"), "duration"),
    "Fwd Packets/s": (("orig_pkts",), "duration"),
    "Bwd Packets/s": (("resp_pkts",), "duration"),
    "Fwd Packet Length Mean": (("orig_bytes",), "orig_pkts"),
    "Bwd Packet Length Mean": (("resp_bytes",), "resp_pkts"),
}

UNKNOWN_SOURCE = "unknown_day6_source"


@dataclass(frozen=True)
class FeatureMapping:
    features: tuple[str, ...]
    mapped: dict[str, str]
    unmapped_features: tuple[str, ...]
    unmapped_external: tuple[str, ...]

    def provenance(self) -> dict[str, str]:
        return {f: "mapped" if f in self.mapped else "training_median_imputed" for f in self.features}

    def summary(self) -> dict:
        return {
            "n_features": len(self.features),
            "n_mapped": len(self.mapped),
            "n_unmapped_features": len(self.unmapped_features),
            "unmapped_features": list(self.unmapped_features),
            "n_unmapped_external_columns": len(self.unmapped_external),
            "unmapped_external_columns": list(self.unmapped_external),
            "mapping": dict(self.mapped),
        }


def map_features(
    features: Sequence[str], external: Sequence[str], aliases: Mapping[str, str] | None = None
) -> FeatureMapping:
    """Match features to foreign columns by normalised name, one to one, first match first.

    ``aliases`` may name further foreign spellings of a feature; off by default.
    """
    by_key: dict[str, str] = {}
    for column in external:
        by_key.setdefault(feature_key(column), column)
    mapped: dict[str, str] = {}
    free = set(external)
    for feature in features:
        for spelling in (feature, (aliases or {}).get(feature)):
            column = by_key.get(feature_key(spelling)) if spelling else None
            if column in free:
                mapped[feature] = column
                free.discard(column)
                break
    return FeatureMapping(
        tuple(features),
        mapped,
        tuple(f for f in features if f not in mapped),
        tuple(c for c in external if c in free),
    )


def map_feature_tables(features: DataFrame, external: DataFrame) -> DataFrame:
    """:func:`map_features` on two tables ``(position, name)``; full result with unmatched sides.

    Returns ``(feature, external, status)``, status mapped, unmapped_feature or unmapped_external.
    """
    def first_of_key(df, name):
        keyed = df.select(F.col("name").alias(name), "position", feature_key_column(F.col("name")).alias("key"))
        place = F.row_number().over(Window.partitionBy("key").orderBy("position"))
        return keyed.withColumn("place", place)

    left, right = first_of_key(features, "feature"), first_of_key(external, "external")
    # Later names with a key already used stay unmatched on both sides.
    joined = left.select("feature", "key", "place").join(
        right.select("external", "key", "place"),
        (left["key"] == right["key"]) & (left["place"] == 1) & (right["place"] == 1),
        "full",
    )
    status = (
        F.when(F.col("feature").isNull(), "unmapped_external")
        .when(F.col("external").isNull(), "unmapped_feature")
        .otherwise("mapped")
    )
    return joined.select("feature", "external", status.alias("status"))


def _coerced(mapping: FeatureMapping, feature: str, medians: Mapping[str, float]) -> Column:
    if feature in mapping.mapped:
        return coerce_number(F.col(f"`{mapping.mapped[feature]}`"))
    return F.lit(medians.get(feature)).cast("double")


def apply_mapping(
    df: DataFrame, mapping: FeatureMapping, medians: Mapping[str, float], keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly the mapped feature list, in order and finite: bad, missing and infinite values
    and unmapped features take the training median. One projection."""
    lost = [f for f in mapping.features if medians.get(f) is None or medians[f] != medians[f] or abs(medians[f]) == float("inf")]
    values = []
    for f in mapping.features:
        value = finite(_coerced(mapping, f, medians))
        values.append((value if f in lost else F.coalesce(value, F.lit(float(medians[f])))).alias(f))
    return df.select(*[F.col(f"`{k}`") for k in keep], *values)


def sanitisation_counts(df: DataFrame, mapping: FeatureMapping, medians: Mapping[str, float]) -> DataFrame:
    """One row: infinities and missing values met while mapping, and how many were imputed."""
    zero = F.lit(0).cast("long")
    positive, negative, missing = zero, zero, zero
    for f in mapping.features:
        value = _coerced(mapping, f, medians)
        infinite = is_infinite(value)
        positive = positive + F.count_if(infinite & (value > 0))
        negative = negative + F.count_if(infinite & (value < 0))
        missing = missing + F.count_if(value.isNull() | F.isnan(value))
    return df.agg(
        positive.alias("n_pos_inf_found"), negative.alias("n_neg_inf_found"), missing.alias("n_nan_found_before_imputation")
    ).select(
        "n_pos_inf_found",
        "n_neg_inf_found",
        (F.col("n_pos_inf_found") + F.col("n_neg_inf_found")).alias("n_inf_total_found"),
        "n_nan_found_before_imputation",
        (F.col("n_pos_inf_found") + F.col("n_neg_inf_found") + F.col("n_nan_found_before_imputation")).alias(
            "n_values_imputed_with_training_medians"
        ),
    )


@dataclass(frozen=True)
class AdapterReport:
    direct: tuple[str, ...]
    derived: tuple[str, ...]
    skipped: dict[str, list[str]]
    fields_used: tuple[str, ...]


def flow_features_from_connections(
    df: DataFrame, duration_factor: float = DURATION_FACTOR
) -> tuple[DataFrame, AdapterReport]:
    """Adds the flow features a connection log supports; a feature whose fields are absent is skipped.

    Rates use the raw seconds. Zero divisors give ±Inf or NaN, which mapping imputes later.
    """
    have = set(df.columns)
    needs = {f: (field,) for f, field in DIRECT_FEATURES.items()}
    needs |= {f: (*top, bottom) for f, (top, bottom) in DERIVED_FEATURES.items()}
    skipped = {f: [c for c in fields if c not in have] for f, fields in needs.items()}
    skipped = {f: fields for f, fields in skipped.items() if fields}

    def number(field):
        return coerce_number(F.col(f"`{field}`"))

    added: dict[str, Column] = {}
    for feature, field in DIRECT_FEATURES.items():
        if feature not in skipped:
            value = number(field)
            added[feature] = value * F.lit(duration_factor) if feature == "Flow Duration" else value
    for feature, (top, bottom) in DERIVED_FEATURES.items():
        if feature not in skipped:
            total = number(top[0])
            for field in top[1:]:
                total = total + number(field)
            added[feature] = ieee_divide(total, number(bottom))
    report = AdapterReport(
        tuple(f for f in DIRECT_FEATURES if f in added),
        tuple(f for f in DERIVED_FEATURES if f in added),
        skipped,
        tuple(sorted({c for f in added for c in needs[f]})),
    )
    return (df.withColumns(added) if added else df), report


def shiftable_features(top: DataFrame, mapped: DataFrame) -> DataFrame:
    """Top features that were really mapped (``testable``) and those that were not."""
    hits = mapped.where("status = 'mapped'").select("feature", F.lit(True).alias("hit"))
    return top.join(hits, "feature", "left").select(
        "feature", "importance", F.coalesce("hit", F.lit(False)).alias("testable")
    )
