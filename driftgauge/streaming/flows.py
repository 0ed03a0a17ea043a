"""Flow streams. Every step is row-wise, so no watermark or state is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftgauge.operators import clean, evidence
from driftgauge.plans.detect import Detectors
from driftgauge.plans.prepare import clean_flows
from driftgauge.sources.sinks import FrozenThresholds


def read_flow_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, files_per_trigger: int = 100
) -> DataFrame:
    """New Parquet files of a folder under a frozen schema, with their source file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder).select("*", F.col("_metadata.file_path").alias("source_file"))


def clean_flow_stream(
    stream: DataFrame, label: str, benign_aliases: Sequence[str] = ("benign",), day_from_file: bool = True,
    nonnegative: Sequence[str] = clean.NONNEGATIVE_FEATURES,
) -> DataFrame:
    """The batch cleaning projection; text in numeric columns is refused by the schema instead of a scan."""
    return clean_flows(stream, label, benign_aliases, day_from_file, nonnegative, check_types=False)


def score_flow_stream(
    stream: DataFrame, detectors: Detectors, thresholds: FrozenThresholds, keep: Sequence[str] = (),
    timestamp: str | None = None,
) -> DataFrame:
    """Alerts of the hybrid at frozen thresholds. The anomaly range must be frozen too: a batch range
    would change a score's meaning with every micro-batch."""
    if detectors.anomaly.low is None or detectors.anomaly.high is None:
        raise ValueError("freeze the anomaly detector's range before scoring a stream")
    scored = detectors.score_rows(stream)
    return evidence.alerts(
        scored, list(detectors.forest.features), thresholds.forest, thresholds.hybrid, timestamp=timestamp, keep=keep
    )


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), available_now: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
