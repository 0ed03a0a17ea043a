"""Registration of queries and the roles the test tables play."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.operators.hybrid import add_hybrid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SCORES = {"random_forest": "rf_score", "isolation_forest": "anomaly_score", "hybrid": "hybrid_score"}
THRESHOLDS = {"random_forest": 0.3, "isolation_forest": 0.25, "hybrid": 0.5}
BENIGN = "N"


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(function(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: doubles to six places, integers 64-bit, times as text."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(column.alias(field.name))
    return df.select(*out)


def rounded(sql: str, *columns: str) -> str:
    """The SQL side of :func:`tidy` for double columns."""
    places = ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({places}) FROM ({sql})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scored flows: class ``l_returnflag`` with N benign, two tied pseudo-scores."""
    scored = table(spark, sf_dir, "lineitem").withColumns(
        {
            "rf_score": F.col("l_discount") * 10.0,
            "anomaly_score": F.col("l_tax") * 12.5,
            "label_binary": (F.col("l_returnflag") != BENIGN).cast("int"),
        }
    )
    return add_hybrid(scored)


def train_side(df: DataFrame) -> DataFrame:
    return df.where("l_linestatus = 'F' AND l_returnflag <> 'A'")


def test_side(df: DataFrame) -> DataFrame:
    return df.where("l_linestatus = 'O'")


FLOWS = """
flows AS (
  SELECT *, (rf_score * 0.7e0 + anomaly_score * 0.3e0) / 1.0e0 AS hybrid_score
  FROM (SELECT *, l_discount * 10.0e0 AS rf_score, l_tax * 12.5e0 AS anomaly_score,
               CAST(l_returnflag <> 'N' AS INTEGER) AS label_binary FROM lineitem)
),
train AS (SELECT * FROM flows WHERE l_linestatus = 'F' AND l_returnflag <> 'A'),
test AS (SELECT * FROM flows WHERE l_linestatus = 'O')"""


def scores_sql(source: str, *keep: str) -> str:
    """Long scores ``(keep..., detector, score)`` of a table expression."""
    kept = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(
        f"SELECT {kept}'{d}' AS detector, {c} AS score FROM {source}" for d, c in SCORES.items()
    )


def threshold_sql(detector: str = "detector") -> str:
    cases = " ".join(f"WHEN '{d}' THEN {t}e0" for d, t in THRESHOLDS.items())
    return f"CASE {detector} {cases} END"


RATES = """
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
  fp / nullif(fp + tn, 0)::DOUBLE AS fpr,
  fn / nullif(fn + tp, 0)::DOUBLE AS fnr"""

CONFUSION = """
  count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp"""

RATE_COLUMNS = ("precision", "recall", "f1", "fpr", "fnr")


def long_features_sql(source: str, features: Sequence[str], *keep: str) -> str:
    kept = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(
        f"SELECT {kept}'{f}' AS feature, {f}::DOUBLE AS value FROM {source}" for f in features
    )
