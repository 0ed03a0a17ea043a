"""Weighted hybrid of two detector scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default weights and threshold.
FOREST_WEIGHT = 0.7
ANOMALY_WEIGHT = 0.3
HYBRID_THRESHOLD = 0.5


@dataclass(frozen=True)
class HybridConfig:
    forest_weight: float = FOREST_WEIGHT
    anomaly_weight: float = ANOMALY_WEIGHT
    threshold: float = HYBRID_THRESHOLD

    def __post_init__(self):
        if self.forest_weight + self.anomaly_weight <= 0:
            raise ValueError("the weights must sum to more than 0")

    def score(self, forest: Column, anomaly: Column) -> Column:
        total = self.forest_weight + self.anomaly_weight
        return (forest * self.forest_weight + anomaly * self.anomaly_weight) / total

    def decide(self, score: Column) -> Column:
        return (score >= self.threshold).cast("int")


def add_hybrid(
    df: DataFrame,
    config: HybridConfig = HybridConfig(),
    forest: str = "rf_score",
    anomaly: str = "anomaly_score",
    column: str = "hybrid_score",
) -> DataFrame:
    return df.withColumn(column, config.score(F.col(forest), F.col(anomaly)))
