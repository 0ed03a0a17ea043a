"""Raw files to leak-checked training and test tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import names
from driftgauge.operators import clean, guards, labels, quality, splits
from driftgauge.operators.evidence import run_metadata
from driftgauge.session import literal_table
from driftgauge.sources import sinks
from driftgauge.sources.files import read_flows

BOOKKEEPING = ("label_multiclass_raw", "label_multiclass", "label_binary", "capture_day", "source_file")


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]
    split: splits.Split
    method: str
    log: DataFrame


def clean_flows(
    flows: DataFrame,
    label: str,
    benign_aliases: Sequence[str] = ("benign",),
    day_from_file: bool = True,
    nonnegative: Sequence[str] = clean.NONNEGATIVE_FEATURES,
    check_types: bool = True,
) -> DataFrame:
    """All row-level cleaning as one fused projection; fit for batch and streaming tables alike."""
    df = labels.normalize_labels(flows, label, benign_aliases)
    df = clean.handle_nan_inf(df)
    df = clean.validate_nonnegative(df, nonnegative, check_types)
    if day_from_file and "source_file" in df.columns:
        df = clean.with_capture_day(df)
    return df


def choose_features(cleaned: DataFrame, label: str) -> quality.FeatureSelection:
    """Duplicates leave the table; identifiers, second targets and near-constant columns stay but are no features."""
    reserved = [c for c in (label, *BOOKKEEPING) if c in cleaned.columns]
    others = [c for c in cleaned.columns if c not in reserved]
    suspects = names.identifier_like(others) + names.label_like(others, label)
    candidates = [c for c in others if c not in suspects]
    constant = [r["feature"] for r in quality.near_constant(cleaned, primary_label=label, columns=candidates).collect()]
    return quality.select_features(cleaned, [*reserved, *suspects, *constant], drop_near_constant=False)


def files_name_days(flows: DataFrame) -> bool:
    """Whether every source file names a capture day; the files' names are known without reading them."""
    if "source_file" not in flows.columns:
        return False
    listed = flows.inputFiles()
    if listed:
        flows = literal_table(flows.sparkSession, [(f,) for f in listed], "source_file string")
    undetected = clean.assign_capture_days(flows).where("NOT detected")
    return undetected.limit(1).count() == 0


def prepare(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    label: str | None = None,
    benign_aliases: Sequence[str] = ("benign",),
    test_days: Sequence[str] = ("friday",),
    test_size: float = 0.2,
    timestamp: str | None = None,
    row_key: str | None = None,
    overwrite: bool = False,
    **read_options,
) -> Prepared:
    """Read, clean, write the cleaned parts, select features, split in time, check, publish.

    Raw files are parsed once for the cleaned parts and once for the counts of the log; every
    later pass reads pruned Parquet. The parts are partitioned by capture day, so a day split
    reads only its own folders.
    """
    flows = read_flows(spark, raw_dir, **read_options)
    label = label or names.detect_label_column(flows.columns)
    if label is None:
        raise ValueError("no label column found; name it explicitly")
    by_day = files_name_days(flows)
    parts_dir = f"{out_dir.rstrip('/')}/parts"
    sinks.write_table(
        clean_flows(flows, label, benign_aliases, by_day), parts_dir, ["capture_day"] if by_day else [], overwrite
    )
    cleaned = spark.read.parquet(parts_dir)
    selection = choose_features(cleaned, label)
    split, features, method = splits.split_in_time(
        selection.table, selection.features, test_size, test_days, timestamp=timestamp, row_key=row_key
    )
    guards.assert_no_split_key(features, split.column, "capture_day")
    log = quality.decision_log(
        labels.label_log(cleaned),
        clean.nan_inf_log(flows),
        clean.nonnegative_log(flows).drop("n_not_numeric"),
        selection.log,
    )
    out = out_dir.rstrip("/")
    sinks.write_table(split.train, f"{out}/train", overwrite=overwrite)
    sinks.write_table(split.test, f"{out}/test", overwrite=overwrite)
    sinks.write_result(log, f"{out}/decisions", "json")
    facts = run_metadata(
        spark, feature_names=list(features), label_col=label, split_method=method, split_column=split.column,
        train_days=list(split.train_days), test_days=list(split.test_days), leakage_check_passed=True,
    )
    sinks.write_result(facts, f"{out}/split_metadata", "json")
    return Prepared(
        spark.read.parquet(f"{out}/train"), spark.read.parquet(f"{out}/test"), features, split, method, log
    )


def load_prepared(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    out = out_dir.rstrip("/")
    sinks.require_artifacts(spark, {n: f"{out}/{n}" for n in ("train", "test", "split_metadata")})
    features = spark.read.json(f"{out}/split_metadata").select(F.col("feature_names")).first()[0]
    return spark.read.parquet(f"{out}/train"), spark.read.parquet(f"{out}/test"), list(features)
