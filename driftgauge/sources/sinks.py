"""Outputs, frozen artifacts and status records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from driftgauge.operators.evidence import run_metadata
from driftgauge.operators.metrics import FOREST_THRESHOLD
from driftgauge.session import literal_table
from driftgauge.sources.files import _list_folder

# Thresholds used when none were selected and saved.
FALLBACK_ANOMALY_THRESHOLD = 0.15
FALLBACK_HYBRID_THRESHOLD = 0.50
STATUS_MISSING = "pipeline_ready_dataset_required"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """Parquet, one folder per partition value; refuses to replace existing parts unless told to."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_result(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """A small result table as CSV with header, or as JSON lines."""
    if file_format == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif file_format == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown result format {file_format!r}")


@dataclass(frozen=True)
class FrozenThresholds:
    forest: float
    anomaly: float
    hybrid: float
    source: str

    def by_detector(self) -> dict[str, float]:
        return {"random_forest": self.forest, "isolation_forest": self.anomaly, "hybrid": self.hybrid}


def save_thresholds(spark: SparkSession, path: str, selected: DataFrame) -> None:
    """``(detector, threshold)`` as selected on validation data."""
    selected.select("detector", "threshold").coalesce(1).write.mode("overwrite").json(path)


def load_thresholds(
    spark: SparkSession, path: str | None, anomaly: float | None = None, hybrid: float | None = None
) -> FrozenThresholds:
    """Given values first, then the saved selection, then the documented fallback.
    The forest's threshold is a fixed constant and is never selected here."""
    if anomaly is not None and hybrid is not None:
        return FrozenThresholds(FOREST_THRESHOLD, anomaly, hybrid, "override")
    saved: dict[str, float] = {}
    source = "fallback_default"
    if path and _list_folder(spark, path) is not None:
        rows = spark.read.schema("detector string, threshold double").json(path).collect()
        saved = {r["detector"]: r["threshold"] for r in rows}
        source = path

    def first(*values):
        return next(v for v in values if v is not None)

    return FrozenThresholds(
        FOREST_THRESHOLD,
        first(anomaly, saved.get("isolation_forest"), FALLBACK_ANOMALY_THRESHOLD),
        first(hybrid, saved.get("hybrid"), FALLBACK_HYBRID_THRESHOLD),
        source,
    )


def require_artifacts(spark: SparkSession, paths: Mapping[str, str]) -> None:
    missing = {name: path for name, path in paths.items() if _list_folder(spark, path) is None}
    if missing:
        raise FileNotFoundError(f"required artifacts are missing: {missing}")


def missing_dataset_status(
    spark: SparkSession, dataset: str, location: str, thresholds: FrozenThresholds
) -> DataFrame:
    """The one-row record written instead of results when the foreign data is absent."""
    return run_metadata(
        spark,
        status=STATUS_MISSING,
        dataset_name=dataset,
        expected_location=location,
        frozen_thresholds={**thresholds.by_detector(), "source": thresholds.source},
        no_models_retrained=True,
        no_preprocessing_statistics_from_external_data=True,
        no_threshold_tuning_on_external_data=True,
    )


def threshold_table(spark: SparkSession, thresholds: Mapping[str, float]) -> DataFrame:
    return literal_table(spark, [(d, float(t)) for d, t in thresholds.items()], "detector string, threshold double")
