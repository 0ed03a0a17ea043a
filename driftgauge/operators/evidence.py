"""Alerts, evidence records, findings and run metadata as nested columns and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from driftgauge.functions.numeric import finite

OUTCOMES = ("TP", "TN", "FP", "FN")

# Evidence wording that consumers match on.
DECISION_AUTHORITY = "machine_learning_detector"
NARRATION_ROLE = "narration_only_no_detection_override"
EXTERNAL_DATASETS = ("ctu-idseval-6", "ctu_idseval6", "day6")


def outcome(truth: Column, predicted: Column) -> Column:
    return (
        F.when((truth == 1) & (predicted == 1), "TP")
        .when((truth == 0) & (predicted == 0), "TN")
        .when((truth == 0) & (predicted == 1), "FP")
        .when((truth == 1) & (predicted == 0), "FN")
    )


def with_outcome(df: DataFrame, truth: str, predicted: str, column: str = "outcome") -> DataFrame:
    return df.withColumn(column, outcome(F.col(f"`{truth}`"), F.col(f"`{predicted}`")))


def top_values(features: Sequence[str], k: int = 5) -> Column:
    """Map of the ``k`` features with the largest absolute values; earlier features win ties."""
    cells, present = [], F.lit(0)
    for i, f in enumerate(features):
        value = F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double"))
        present = present + value.isNotNull().cast("int")
        cells.append(
            F.when(
                value.isNotNull(),
                F.struct(F.abs(value).alias("size"), F.lit(-i).alias("place"), F.lit(f).alias("key"), value.alias("value")),
            )
        )
    # Descending order puts the missing ones last, where the slice leaves them out.
    ranked = F.slice(F.sort_array(F.array(*cells), asc=False), 1, F.least(present, F.lit(k)))
    return F.map_from_arrays(ranked["key"], ranked["value"])


def alerts(
    df: DataFrame,
    features: Sequence[str],
    forest_threshold: float,
    hybrid_threshold: float,
    forest: str = "rf_score",
    anomaly: str = "anomaly_score",
    hybrid: str = "hybrid_score",
    timestamp: str | None = None,
    keep: Sequence[str] = (),
    k: int = 5,
) -> DataFrame:
    """One nested ``alert`` and its JSON for every row the hybrid flags. A projection, no shuffle."""
    forest_score, anomaly_score, hybrid_score = (F.col(f"`{c}`") for c in (forest, anomaly, hybrid))
    flagged = hybrid_score >= hybrid_threshold
    moment = F.col(f"`{timestamp}`").cast("string") if timestamp else F.lit(None).cast("string")
    alert = F.struct(
        moment.alias("timestamp"),
        flagged.cast("int").alias("predicted_label"),
        finite(forest_score).alias("rf_attack_probability"),
        finite(anomaly_score).alias("anomaly_score"),
        finite(hybrid_score).alias("hybrid_score"),
        F.struct(
            F.lit(float(forest_threshold)).alias("rf_threshold"),
            F.lit(float(hybrid_threshold)).alias("hybrid_threshold"),
        ).alias("thresholds_used"),
        F.struct(
            (forest_score >= forest_threshold).alias("random_forest"), flagged.alias("hybrid")
        ).alias("detector_decisions"),
        top_values(features, k).alias("top_feature_values"),
    )
    return df.where(flagged).select(*[F.col(f"`{c}`") for c in keep], alert.alias("alert")).withColumn(
        "alert_json", F.to_json("alert", {"ignoreNullFields": "false"})
    )


def first_alerts(df: DataFrame, row_key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key: a top-n report, kept per task before it is merged."""
    return df.orderBy(F.col(f"`{row_key}`")).limit(n)


def first_per_outcome(df: DataFrame, row_key: str, n: int = 1, column: str = "outcome") -> DataFrame:
    """The first ``n`` rows of each outcome by key, null keys last; ties are cut by content.

    Rows without an outcome are left out. Each task passes on ``n`` rows of an outcome at most.
    """
    content = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)]
    place = Window.partitionBy(column).orderBy(F.col(f"`{row_key}`").asc_nulls_last(), F.xxhash64(*content))
    known = df.where(F.col(f"`{column}`").isNotNull())
    return known.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")


def top_contributors(contributions: Column, k: int, sign: int) -> Column:
    """The ``k`` strongest positive (``sign`` 1) or negative (-1) contributions of a row.

    ``contributions`` is an array of ``struct<feature, value, contribution>``.
    """
    chosen = F.filter(contributions, lambda c: c["contribution"] * F.lit(sign) > 0)
    keyed = F.transform(
        chosen,
        lambda c, i: F.struct(
            (-F.abs(c["contribution"])).alias("size"), i.alias("place"),
            c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution"),
        ),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k),
        lambda c: F.struct(
            c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution")
        ),
    )


def strongest_contributors(positive: Column, negative: Column, k: int) -> Column:
    """Both signs merged by absolute size; positive ones first among equals."""
    keyed = F.transform(
        F.concat(positive, negative),
        lambda c, i: F.struct((-F.abs(c["contribution"])).alias("size"), i.alias("place"), c.alias("item")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda c: c["item"])


CONTRIBUTOR_LISTS = ("top_contributors", "top_positive_contributors", "top_negative_contributors")


def evidence_records(
    explanations: DataFrame,
    forest_threshold: float,
    anomaly_threshold: float,
    hybrid_threshold: float,
    weights: Mapping[str, float],
    provenance: Mapping[str, str] | None = None,
    n_mapped: int = 9,
    n_imputed: int = 49,
) -> DataFrame:
    """Explanations plus decision authority, frozen configuration, provenance and limitations.

    Adds ``evidence_json``. Provenance and the extra limitations apply to rows of the external dataset.
    """
    external = F.coalesce(F.lower(F.col("dataset")).isin(*EXTERNAL_DATASETS), F.lit(False))
    pairs = [F.lit(v) for item in (provenance or {}).items() for v in item]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    out = explanations
    for name in CONTRIBUTOR_LISTS:
        if name in out.columns:
            tagged = F.transform(
                F.col(name),
                lambda c: F.struct(
                    c["feature"].alias("feature"),
                    c["value"].alias("value"),
                    c["contribution"].alias("contribution"),
                    F.when(
                        external, F.coalesce(F.try_element_at(known, c["feature"]), F.lit("unknown_day6_source"))
                    ).alias("feature_source"),
                ),
            )
            out = out.withColumn(name, tagged)
    total = n_mapped + n_imputed
    extra = F.array(
        F.lit(f"CTU-IDSEVAL-6 limitation: {n_mapped}/{total} mapped; {n_imputed}/{total} training-median imputed."),
        F.lit("unknown_day6_source must not be described as directly observed."),
    )
    limits = F.coalesce(F.col("limitations"), F.array().cast("array<string>"))
    out = out.withColumns(
        {
            "decision_authority": F.lit(DECISION_AUTHORITY),
            "llm_role": F.lit(NARRATION_ROLE),
            "frozen_configuration": F.struct(
                F.lit(float(forest_threshold)).alias("random_forest_threshold"),
                F.lit(float(anomaly_threshold)).alias("isolation_forest_threshold"),
                F.lit(float(hybrid_threshold)).alias("hybrid_threshold"),
                F.struct(
                    F.lit(float(weights.get("rf", 0.7))).alias("rf"),
                    F.lit(float(weights.get("anomaly", 0.3))).alias("anomaly"),
                ).alias("hybrid_weights"),
            ),
            "day6_representation": F.when(
                external,
                F.struct(
                    F.lit(n_mapped).alias("mapped_feature_count"),
                    F.lit(n_imputed).alias("training_median_imputed_feature_count"),
                ),
            ),
            "limitations": F.array_distinct(F.when(external, F.concat(limits, extra)).otherwise(limits)),
        }
    )
    return out.withColumn("evidence_json", F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns])))


def findings(comparison: DataFrame, metric: str = "recall", by: Sequence[str] = (), margin: float = 0.0) -> DataFrame:
    """``(by..., rule, message)``: which detector leads and where the hybrid stands, from the numbers."""
    def of(detector):
        return F.max(F.when(F.col("detector") == detector, F.col(metric)))

    keys = [F.col(f"`{k}`") for k in by]
    wide = comparison.groupBy(*keys).agg(
        of("random_forest").alias("rf"), of("isolation_forest").alias("anomaly"), of("hybrid").alias("hybrid")
    )
    rf, anomaly, hybrid = F.col("rf"), F.col("anomaly"), F.col("hybrid")
    best = F.greatest(rf, anomaly, hybrid)
    leader = F.when(rf == best, "random_forest").when(anomaly == best, "isolation_forest").otherwise("hybrid")
    standing = (
        F.when(hybrid < F.least(rf, anomaly) - F.lit(margin), "hybrid_below_both")
        .when(hybrid > F.greatest(rf, anomaly), "hybrid_above_both")
        .otherwise("hybrid_between")
    )
    ahead = F.when(anomaly > rf, "anomaly_ahead_of_forest").otherwise("forest_at_least_anomaly")

    def shown(column):
        return F.format_number(column, 4)

    rows = F.array(
        F.struct(F.lit("best_detector").alias("rule"),
                 F.concat(leader, F.lit(f" has the highest {metric}: "), shown(best)).alias("message")),
        F.struct(ahead.alias("rule"),
                 F.concat(F.lit(f"{metric}: isolation_forest "), shown(anomaly), F.lit(", random_forest "), shown(rf)).alias("message")),
        F.struct(standing.alias("rule"), F.concat(F.lit(f"hybrid {metric}: "), shown(hybrid)).alias("message")),
    )
    complete = rf.isNotNull() & anomaly.isNotNull() & hybrid.isNotNull()
    return wide.where(complete).select(*keys, F.inline(rows))


def count_findings(
    spark, shift_tests: DataFrame | None = None, mapping: DataFrame | None = None, infinite: DataFrame | None = None,
    alpha: float = 0.01,
) -> DataFrame:
    """``(rule, message)`` of an evaluation on other data, each rule only where there is something to say.

    ``shift_tests`` has a ``p_value`` for each tested feature, ``mapping`` a ``mapped`` flag for each feature of
    the model, and ``infinite`` an ``n_infinite`` for each mapped column.
    """
    parts = []
    if shift_tests is not None:
        counted = shift_tests.agg(F.count_if(F.col("p_value") < alpha).alias("a"), F.count(F.lit(1)).alias("b"))
        parts.append((counted, "significant_shifts", f"tested features differ significantly (p<{alpha}); an association, not a cause", "b"))
    if mapping is not None:
        counted = mapping.agg(F.count_if(~F.col("mapped")).alias("a"), F.count(F.lit(1)).alias("b"))
        parts.append((counted, "unmapped_features", "features have no counterpart and were imputed with training medians", "a"))
    if infinite is not None:
        counted = infinite.agg(F.coalesce(F.sum("n_infinite"), F.lit(0)).alias("a"), F.lit(None).cast("long").alias("b"))
        parts.append((counted, "infinities_replaced", "infinite values were replaced and imputed with training medians", "a"))
    rows = spark.createDataFrame([], "rule string, message string")
    for counted, rule, text, needed in parts:
        amount = F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string"))
        rows = rows.unionByName(
            counted.where(F.col(needed) > 0).select(
                F.lit(rule).alias("rule"), F.concat(amount, F.lit(f" {text}")).alias("message")
            )
        )
    return rows


def run_metadata(spark, **facts) -> DataFrame:
    """One row of run facts, ready to be written as JSON."""
    return spark.range(1).select(*[_literal(v).alias(k) for k, v in facts.items()])


def _literal(value) -> Column:
    if isinstance(value, Mapping):
        if not value:
            return F.create_map().cast("map<string,string>")
        return F.struct(*[_literal(v).alias(str(k)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value]) if value else F.array().cast("array<string>")
    return F.lit(value)
