"""Model training, scoring, explanation and streaming on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.catalog.registry import FEATURES, query, rounded, table
from driftgauge.operators import evidence, explain, isolation
from driftgauge.operators.forest import ForestDetector, train_forest
from driftgauge.operators.hybrid import HybridConfig
from driftgauge.operators.isolation import AnomalyDetector, train_isolation_forest
from driftgauge.operators.sampling import balanced_sample, benign_heavy_sample
from driftgauge.plans.detect import SCORES, Detectors
from driftgauge.plans.external import evaluate_external
from driftgauge.operators.metrics import compare_detectors, threshold_metrics
from driftgauge.session import scratch_path, settle
from driftgauge.sources.sinks import FrozenThresholds
from driftgauge.streaming import flows as streams

THRESHOLDS = FrozenThresholds(0.3, 0.5, 0.4, "override")
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _labelled(spark, sf_dir):
    """lineitem with a learnable target: large discounted lines are attacks."""
    target = (F.col("l_discount") >= 0.07) & (F.col("l_quantity") >= 25)
    return table(spark, sf_dir, "lineitem").withColumns(
        {"label_binary": target.cast("int"), "key": F.xxhash64(*KEY, *FEATURES, "l_shipdate")}
    )


def _train(spark, sf_dir):
    return _labelled(spark, sf_dir).where("l_linestatus = 'F'")


def _test(spark, sf_dir):
    return _labelled(spark, sf_dir).where("l_linestatus = 'O'")


_TRAINED: dict[tuple, object] = {}


def _once(spark, sf_dir, kind, train):
    """One model for all queries of a session that need it; the queries about training train their own."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _TRAINED:
        _TRAINED[key] = train(spark, sf_dir)
    return _TRAINED[key]


def _train_forest(spark, sf_dir) -> ForestDetector:
    return train_forest(_train(spark, sf_dir), FEATURES)


def _train_anomaly(spark, sf_dir) -> AnomalyDetector:
    sample = benign_heavy_sample(_train(spark, sf_dir), FEATURES, row_key="key")
    return train_isolation_forest(sample, row_key="key")


def _forest(spark, sf_dir) -> ForestDetector:
    return _once(spark, sf_dir, "forest", _train_forest)


def _anomaly(spark, sf_dir) -> AnomalyDetector:
    return _once(spark, sf_dir, "anomaly", _train_anomaly)


def _detectors(spark, sf_dir) -> Detectors:
    return Detectors(_forest(spark, sf_dir), _anomaly(spark, sf_dir).freeze_range(_train(spark, sf_dir)), HybridConfig())


@query(
    "forest_training",
    """SELECT 100::BIGINT AS trees, 4::BIGINT AS features, count(*) AS rows_scored, true AS separates, 0::BIGINT AS out_of_range
       FROM lineitem WHERE l_linestatus = 'O'""",
)
def forest_training(spark, sf_dir):
    """Trained on one side, scored on the other: attacks must score higher, all scores lie in [0, 1]."""
    detector = _train_forest(spark, sf_dir)
    scored = detector.score(_test(spark, sf_dir).select(*FEATURES, "label_binary"))
    mean = lambda y: F.avg(F.when(F.col("label_binary") == y, F.col("rf_score")))
    return scored.agg(
        F.lit(detector.model.getNumTrees).alias("trees"),
        F.lit(len(detector.features)).alias("features"),
        F.count("rf_score").alias("rows_scored"),
        (mean(1) - mean(0) > 0.5).alias("separates"),
        F.count_if(~F.col("rf_score").between(0, 1)).alias("out_of_range"),
    )


@query("forest_metrics")
def forest_metrics(spark, sf_dir):
    scored = _forest(spark, sf_dir).score(_test(spark, sf_dir).select(*FEATURES, "label_binary"))
    return threshold_metrics(scored, "label_binary", "rf_score", THRESHOLDS.forest)


@query("forest_importances")
def forest_importances(spark, sf_dir):
    return _forest(spark, sf_dir).importances(spark)


@query(
    "forest_artifacts",
    "SELECT 'saved' AS artifact, count(*) AS rows, 0::BIGINT AS differing FROM lineitem WHERE l_linestatus = 'O'",
)
def forest_artifacts(spark, sf_dir):
    """A saved and reloaded forest scores every row as before."""
    detector, path = _forest(spark, sf_dir), scratch_path(spark, "model")
    detector.save(path)
    again = ForestDetector.load(spark, path)
    both = again.score(detector.score(_test(spark, sf_dir).select(*FEATURES), "before"), "after")
    return both.agg(
        F.lit("saved").alias("artifact"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("before") != F.col("after")).alias("differing"),
    )


@query(
    "isolation_forest_training",
    """SELECT 100::BIGINT AS trees, 256::BIGINT AS root_rows, 0::BIGINT AS too_deep, 0::BIGINT AS unbalanced FROM lineitem HAVING count(*) > 0""",
)
def isolation_forest_training(spark, sf_dir):
    """Tree shape: full subsamples at the roots, bounded depth, children that add up to their parent."""
    nodes = _train_anomaly(spark, sf_dir).nodes
    children = nodes.select("tree", F.col("node").alias("child"), F.col("size").alias("child_size"))
    sums = (
        nodes.where("left >= 0").select("tree", "node", "size", F.explode(F.array("left", "right")).alias("child"))
        .join(children, ["tree", "child"]).groupBy("tree", "node", "size").agg(F.sum("child_size").alias("both"))
    )
    unbalanced = sums.agg(F.count_if(F.col("both") != F.col("size")).alias("unbalanced"))
    return nodes.agg(
        F.count_distinct("tree").alias("trees"),
        F.max(F.when(F.col("depth") == 0, F.col("size"))).alias("root_rows"),
        F.count_if(F.col("depth") > 8).alias("too_deep"),
    ).crossJoin(unbalanced)


@query(
    "anomaly_scores",
    """SELECT count(*) AS rows, 0.0::DOUBLE AS lowest, 1.0::DOUBLE AS highest, 0::BIGINT AS missing FROM lineitem WHERE l_linestatus = 'O'""",
)
def anomaly_scores(spark, sf_dir):
    gaps = F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("l_quantity")
    rows = _test(spark, sf_dir).select(gaps, *[f for f in FEATURES if f != "l_quantity"])
    scored = _train_anomaly(spark, sf_dir).score(rows)
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.min("anomaly_score").alias("lowest"), F.max("anomaly_score").alias("highest"),
        F.count_if(F.col("anomaly_score").isNull()).alias("missing"),
    )


@query(
    "min_max_scaling",
    rounded(
        """SELECT l_returnflag, avg((l_extendedprice - lo) / (hi - lo)) AS mean_score FROM lineitem,
             (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1""",
        "mean_score",
    ),
)
def min_max_scaling(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    ends = df.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).first()
    scaled = isolation.scale_to_unit(F.col("l_extendedprice"), ends["lo"], ends["hi"])
    return df.groupBy("l_returnflag").agg(F.avg(scaled).alias("mean_score"))


@query("embedding_anomalies")
def embedding_anomalies(spark, sf_dir):
    """Isolation forest over all embedding coordinates, summarised by label."""
    names = [f"x{i}" for i in range(table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0])]
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", (F.col("label") != 0).cast("int").alias("label_binary"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    sample = benign_heavy_sample(df, names, row_key="vec_id")
    scored = train_isolation_forest(sample, row_key="vec_id").score(df)
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("mean_score"))


@query(
    "frozen_model_rewrap",
    "SELECT 4::BIGINT AS features, 0::BIGINT AS changed FROM lineitem HAVING count(*) > 0",
)
def frozen_model_rewrap(spark, sf_dir):
    """Medians recomputed from the deterministic sample equal those stored with the model."""
    detector = _anomaly(spark, sf_dir)
    again = isolation.rewrap_detector(detector, _train(spark, sf_dir), row_key="key")
    changed = sum(detector.medians[f] != again.medians[f] for f in FEATURES)
    return detector.nodes.agg(F.lit(len(again.medians)).alias("features"), F.lit(changed).alias("changed"))


@query("detector_evaluation")
def detector_evaluation(spark, sf_dir):
    scored = _detectors(spark, sf_dir).score(_test(spark, sf_dir), ["label_binary"])
    return compare_detectors(scored, "label_binary", SCORES, THRESHOLDS.by_detector())


@query("forest_attribution")
def forest_attribution(spark, sf_dir):
    sample = balanced_sample(_test(spark, sf_dir), "label_binary", 2000, row_key="key")
    return explain.forest_global(_forest(spark, sf_dir), sample)


@query("forest_local_explanations")
def forest_local_explanations(spark, sf_dir):
    detector = _forest(spark, sf_dir)
    scored = settle(detector.score(_test(spark, sf_dir).select("key", "label_binary", *FEATURES)), "scored")
    local = explain.forest_local(detector, scored, "key", THRESHOLDS.forest)
    return local.withColumns(
        {c: F.to_json(c) for c in ("top_positive_contributors", "top_negative_contributors", "limitations")}
    )


@query("anomaly_attribution")
def anomaly_attribution(spark, sf_dir):
    sample = settle(balanced_sample(_test(spark, sf_dir), "label_binary", 2000, row_key="key"), "sample")
    return explain.anomaly_global(_anomaly(spark, sf_dir), sample)


@query("anomaly_local_explanations")
def anomaly_local_explanations(spark, sf_dir):
    detector = _anomaly(spark, sf_dir)
    scored = settle(detector.score(_test(spark, sf_dir).select("key", "label_binary", *FEATURES)), "scored")
    local = explain.anomaly_local(detector, scored, "key", THRESHOLDS.anomaly)
    lists = [c for c in local.columns if c.endswith("contributors")] + ["limitations"]
    return local.withColumns({c: F.to_json(c) for c in lists})


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    sample = settle(balanced_sample(_test(spark, sf_dir), "label_binary", 5000, row_key="key"), "sample")
    return explain.permutation_importance(_forest(spark, sf_dir), sample, "key", THRESHOLDS.forest)


@query("evidence_records")
def evidence_records(spark, sf_dir):
    detector = _forest(spark, sf_dir)
    scored = settle(detector.score(_test(spark, sf_dir).select("key", "label_binary", *FEATURES)), "scored")
    local = explain.forest_local(detector, scored, "key", THRESHOLDS.forest, dataset="CTU-IDSEVAL-6")
    records = evidence.evidence_records(
        local, THRESHOLDS.forest, THRESHOLDS.anomaly, THRESHOLDS.hybrid, {"rf": 0.7, "anomaly": 0.3},
        {"l_quantity": "mapped", "l_tax": "training_median_imputed"},
    )
    return records.select("outcome", "prediction", "decision_authority", "evidence_json")


@query("external_evaluation")
def external_evaluation(spark, sf_dir):
    """orders as a foreign dataset: one feature maps by name, the others take training medians."""
    foreign = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("L Extendedprice"),
        F.when(F.col("o_orderstatus") == "F", "Benign").otherwise(F.col("o_orderstatus")).alias("Label"),
    )
    return evaluate_external(_detectors(spark, sf_dir), foreign, THRESHOLDS).comparison


@query(
    "stream_cleaning",
    """SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END::BIGINT AS label_binary,
              count(*) AS n, count(*) FILTER (WHERE value >= 10) AS n_value FROM events GROUP BY 1, 2""",
)
def stream_cleaning(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = streams.read_flow_stream(spark, sf_dir, schema, "events.parquet")
    shifted = stream.withColumn("value", F.col("value") - 10)
    cleaned = streams.clean_flow_stream(shifted, "event_type", ["view", "click"], False, ["value"])
    out = scratch_path(spark, "stream")
    streams.write_stream(cleaned, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("event_type", "label_binary").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value")
    )


@query("stream_scoring")
def stream_scoring(spark, sf_dir):
    detectors = _detectors(spark, sf_dir)
    schema = table(spark, sf_dir, "lineitem").schema
    stream = streams.read_flow_stream(spark, sf_dir, schema, "lineitem.parquet")
    made = streams.score_flow_stream(stream, detectors, THRESHOLDS, keep=["l_returnflag"], timestamp="l_shipdate")
    out = scratch_path(spark, "alerts")
    streams.write_stream(made, f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.avg("alert.hybrid_score").alias("mean_score")
    )
