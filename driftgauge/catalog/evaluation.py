"""Populations and detector metrics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.catalog.registry import (
    BENIGN, CONFUSION, FLOWS, RATE_COLUMNS, RATES, SCORES, THRESHOLDS,
    flows, query, rounded, scores_sql, table, test_side, threshold_sql, train_side,
)
from driftgauge.operators import evidence, hybrid, metrics, populations
from driftgauge.session import scratch_path
from driftgauge.sources import sinks


def _long(source, *keep):
    return f"long AS ({scores_sql(source, *keep)})"


@query(
    "hybrid_scores",
    rounded(
        f"""WITH {FLOWS} SELECT l_returnflag, avg(hybrid_score) AS mean_score, count(*) FILTER (WHERE hybrid_score >= 0.5) AS flagged
            FROM flows GROUP BY 1""",
        "mean_score",
    ),
)
def hybrid_scores(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.groupBy("l_returnflag").agg(
        F.avg("hybrid_score").alias("mean_score"),
        F.sum(hybrid.HybridConfig().decide(F.col("hybrid_score"))).alias("flagged"),
    )


@query(
    "outcome_classes",
    f"""WITH {FLOWS} SELECT CASE WHEN label_binary = 1 THEN CASE WHEN hybrid_score >= 0.5 THEN 'TP' ELSE 'FN' END
        ELSE CASE WHEN hybrid_score >= 0.5 THEN 'FP' ELSE 'TN' END END AS outcome, count(*) AS n FROM flows GROUP BY 1""",
)
def outcome_classes(spark, sf_dir):
    df = flows(spark, sf_dir).withColumn("pred", metrics.decide(F.col("hybrid_score"), 0.5))
    return evidence.with_outcome(df, "label_binary", "pred").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "threshold_metrics",
    rounded(
        f"""WITH {FLOWS}, c AS (SELECT l_linestatus, {CONFUSION} FROM (SELECT l_linestatus, label_binary AS y,
              CAST(rf_score >= 0.3 AS INTEGER) AS p FROM flows) GROUP BY 1)
            SELECT *, 0.3::DOUBLE AS threshold, {RATES} FROM c""",
        *RATE_COLUMNS,
    ),
)
def threshold_metrics(spark, sf_dir):
    return metrics.threshold_metrics(flows(spark, sf_dir), "label_binary", "rf_score", 0.3, ["l_linestatus"])


_GRID_VALUES = ", ".join(f"({t}e0, {i}::BIGINT)" for i, t in enumerate(metrics.THRESHOLD_GRID))
GRID = f"""grid AS (SELECT * FROM (VALUES {_GRID_VALUES}) AS g(threshold, grid_pos)),
  cells AS (SELECT detector, threshold, grid_pos, {CONFUSION} FROM (SELECT detector, threshold, grid_pos, label_binary AS y,
     CAST(score >= threshold AS INTEGER) AS p FROM long, grid) GROUP BY 1, 2, 3),
  rated AS (SELECT *, {RATES} FROM cells)"""


@query("threshold_grid", rounded(f"WITH {FLOWS}, {_long('flows', 'label_binary')}, {GRID} SELECT * FROM rated", *RATE_COLUMNS))
def threshold_grid(spark, sf_dir):
    return metrics.threshold_grid(flows(spark, sf_dir), "label_binary", SCORES)


def _selected(metric):
    return rounded(
        f"""WITH {FLOWS}, {_long('flows', 'label_binary')}, {GRID},
            placed AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY {metric} DESC NULLS LAST, grid_pos) AS place FROM rated)
            SELECT * EXCLUDE (place) FROM placed WHERE place = 1""",
        *RATE_COLUMNS,
    )


@query("threshold_selection", _selected("f1"))
def threshold_selection(spark, sf_dir):
    return metrics.select_threshold(threshold_grid(spark, sf_dir))


@query("threshold_selection_precision", _selected("precision"))
def threshold_selection_precision(spark, sf_dir):
    return metrics.select_threshold(threshold_grid(spark, sf_dir), "precision")


@query(
    "frozen_thresholds",
    f"""WITH {FLOWS}, {_long('flows', 'label_binary')}, {GRID},
        placed AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY f1 DESC, grid_pos) AS place FROM rated)
        SELECT detector, CASE detector WHEN 'random_forest' THEN 0.01e0 ELSE threshold END AS threshold FROM placed WHERE place = 1""",
)
def frozen_thresholds(spark, sf_dir):
    path = scratch_path(spark, "thresholds")
    sinks.save_thresholds(spark, path, threshold_selection(spark, sf_dir))
    return sinks.threshold_table(spark, sinks.load_thresholds(spark, path).by_detector())


def ranking_sql(source, keys):
    """ROC-AUC and average precision of ``source(keys..., score, pos, neg)`` by window sums."""
    k = ", ".join(keys)
    return f"""SELECT {k},
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 1 - sum(pos * (cn - neg / 2.0))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)) END AS roc_auc,
        CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cp::DOUBLE / nullif(cp + cn, 0)) / sum(pos) END AS pr_auc
      FROM (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM {source}
            WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)) GROUP BY {k}"""


def comparison_sql(source, keys=("detector",)):
    """Detector comparison of ``source(keys..., label_binary, score)``."""
    k = ", ".join(keys)
    return f"""
      cells AS (SELECT {k}, score, count(*) FILTER (WHERE label_binary = 1) AS pos,
                       count(*) FILTER (WHERE label_binary = 0) AS neg FROM {source} GROUP BY {k}, score),
      ranked AS ({ranking_sql('cells', keys)}),
      counted AS (SELECT {k}, count(*) AS total_samples, count(*) FILTER (WHERE y = 0) AS benign_samples,
                         count(*) FILTER (WHERE y = 1) AS attack_samples, {CONFUSION}
                  FROM (SELECT {k}, label_binary AS y, CAST(score >= {threshold_sql()} AS INTEGER) AS p FROM {source}) GROUP BY {k}),
      compared AS (SELECT *, recall AS attack_detection_rate FROM
                   (SELECT *, {threshold_sql()} AS threshold, {RATES} FROM counted) JOIN ranked USING ({k}))"""


COMPARED = (*RATE_COLUMNS, "attack_detection_rate", "roc_auc", "pr_auc")
_COMPARE = f"WITH {FLOWS}, {_long('flows', 'label_binary')}, {comparison_sql('long')}"


@query("detector_comparison", rounded(f"{_COMPARE} SELECT * FROM compared", *COMPARED))
def detector_comparison(spark, sf_dir):
    return metrics.compare_detectors(flows(spark, sf_dir), "label_binary", SCORES, THRESHOLDS)


@query(
    "sparse_label_ranking",
    rounded(
        f"""WITH cells AS (SELECT 'length' AS detector, n_chars::DOUBLE AS score, count(*) FILTER (WHERE toxic = 1) AS pos,
              count(*) FILTER (WHERE toxic = 0) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY 2)
            {ranking_sql('cells', ['detector'])}""",
        "roc_auc", "pr_auc",
    ),
)
def sparse_label_ranking(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("length")).join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    return metrics.ranking_quality(metrics.score_cells(scored, "toxic", {"length": "length"}))


@query(
    "curve_points",
    rounded(
        f"""WITH {FLOWS}, {_long('flows', 'label_binary')}, {comparison_sql('long')},
        c AS (SELECT detector, score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM cells
              WINDOW w AS (PARTITION BY detector ORDER BY score DESC)),
        t AS (SELECT detector, sum(pos) AS p, sum(neg) AS n FROM cells GROUP BY 1),
        o AS (SELECT * FROM c UNION ALL SELECT detector, 'inf'::DOUBLE, 0, 0 FROM t)
        SELECT detector, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp / p::DOUBLE AS tpr, fp / n::DOUBLE AS fpr,
               coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1) AS precision, tp / p::DOUBLE AS recall FROM o JOIN t USING (detector)""",
        "threshold", "tpr", "fpr", "precision", "recall",
    ),
)
def curve_points(spark, sf_dir):
    return metrics.curve_points(metrics.score_cells(flows(spark, sf_dir), "label_binary", SCORES))


@query(
    "confusion_matrix",
    f"""{_COMPARE} SELECT detector, 'benign' AS actual, 'benign' AS predicted, tn AS rows FROM compared
        UNION ALL SELECT detector, 'benign', 'attack', fp FROM compared
        UNION ALL SELECT detector, 'attack', 'benign', fn FROM compared
        UNION ALL SELECT detector, 'attack', 'attack', tp FROM compared""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(detector_comparison(spark, sf_dir))


PER_CLASS = f"""per_class AS (SELECT detector, l_returnflag AS class, count(*) AS samples,
    count(*) FILTER (WHERE score >= {threshold_sql()}) AS predicted_attack, avg(score) AS mean_score, max(score) AS max_score,
    median(score) AS median_score FROM long GROUP BY 1, 2),
  rated_class AS (SELECT *, predicted_attack / samples::DOUBLE AS detection_rate,
    100 * predicted_attack / samples::DOUBLE AS pct_detected, 100 - 100 * predicted_attack / samples::DOUBLE AS pct_missed FROM per_class)"""
PER_CLASS_COLUMNS = ("mean_score", "max_score", "median_score", "detection_rate", "pct_detected", "pct_missed")


@query(
    "per_class_results",
    rounded(f"WITH {FLOWS}, {_long('flows', 'l_returnflag')}, {PER_CLASS} SELECT * FROM rated_class", *PER_CLASS_COLUMNS),
)
def per_class_results(spark, sf_dir):
    return metrics.per_class_results(flows(spark, sf_dir), "l_returnflag", SCORES, THRESHOLDS)


@query(
    "recall_with_support",
    rounded(
        f"""WITH {FLOWS}, n AS (SELECT l_returnflag AS class, count(*) AS n_in_train FROM train GROUP BY 1)
        SELECT l_returnflag AS class, count(*) AS n_in_test, avg(CAST(rf_score >= 0.3 AS INTEGER)) AS recall,
               coalesce(max(n_in_train), 0) AS n_in_train FROM test LEFT JOIN n ON class = l_returnflag GROUP BY 1""",
        "recall",
    ),
)
def recall_with_support(spark, sf_dir):
    df = flows(spark, sf_dir)
    return metrics.recall_with_support(test_side(df), train_side(df), "l_returnflag", "rf_score", 0.3)


def _summary_sql(source, keep):
    return f"""WITH {FLOWS}, {_long(source, keep)} SELECT {keep}, detector, count(*) AS count, avg(score) AS mean,
      stddev_samp(score) AS std, min(score) AS min, max(score) AS max, quantile_cont(score, 0.25) AS q25,
      quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q75 FROM long GROUP BY 1, 2"""


SUMMARY = ("mean", "std", "min", "max", "q25", "median", "q75")


@query("score_summary_by_split", rounded(_summary_sql("flows", "l_linestatus"), *SUMMARY))
def score_summary_by_split(spark, sf_dir):
    return metrics.score_summary(flows(spark, sf_dir), SCORES, ["l_linestatus"])


@query(
    "score_summary_of_attacks",
    rounded(_summary_sql("(SELECT * FROM flows WHERE label_binary = 1)", "l_returnflag"), *SUMMARY),
)
def score_summary_of_attacks(spark, sf_dir):
    return metrics.score_summary(flows(spark, sf_dir).where("label_binary = 1"), SCORES, ["l_returnflag"])


@query(
    "score_histogram",
    rounded(
        """WITH s AS (SELECT CAST(quality = 1 AS BIGINT) AS label, 'length' AS detector, n_chars::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
        e AS (SELECT label, detector, min(score) AS lo, max(score) AS hi, count(*) AS n FROM s GROUP BY 1, 2),
        f AS (SELECT *, (hi - lo) / 40 AS w, unnest(range(40)) AS bin FROM e),
        b AS (SELECT label, detector, least(floor((score - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS k FROM s JOIN e USING (label, detector) GROUP BY 1, 2, 3)
        SELECT label, detector, bin, lo + w * bin AS left_edge, lo + w * (bin + 1) AS right_edge, coalesce(k, 0) AS rows,
               coalesce(k, 0) / (n * w) AS density FROM f LEFT JOIN b USING (label, detector, bin)""",
        "left_edge", "right_edge", "density",
    ),
)
def score_histogram(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("length")).join(
        table(spark, sf_dir, "labels"), "doc_id"
    ).withColumn("label", (F.col("quality") == 1).cast("int"))
    return metrics.score_histogram(scored, {"length": "length"}, ["label"])


@query(
    "class_inventory",
    f"""WITH {FLOWS} SELECT class, bool_or(side = 'train') AS in_train, bool_or(side = 'test') AS in_test,
        CASE WHEN class = 'N' THEN 'benign' WHEN bool_or(side = 'train') THEN 'seen_attack' ELSE 'unseen_attack' END AS role
        FROM (SELECT l_returnflag AS class, 'train' AS side FROM train UNION ALL SELECT l_returnflag, 'test' FROM test) GROUP BY 1""",
)
def class_inventory(spark, sf_dir):
    df = flows(spark, sf_dir)
    return populations.class_inventory(train_side(df), test_side(df), "l_returnflag", BENIGN)


UNSEEN_SQL = """SELECT DISTINCT l_returnflag AS class FROM test WHERE l_returnflag NOT IN (SELECT l_returnflag FROM train)"""


@query("unseen_classes", f"WITH {FLOWS} {UNSEEN_SQL}")
def unseen_classes(spark, sf_dir):
    df = flows(spark, sf_dir)
    return populations.unseen_classes(train_side(df), test_side(df), "l_returnflag")


@query(
    "unseen_leakage",
    f"WITH {FLOWS} SELECT DISTINCT l_returnflag AS class FROM train WHERE l_returnflag IN ('A', 'R')",
)
def unseen_leakage(spark, sf_dir):
    return populations.leaked_classes(train_side(flows(spark, sf_dir)), ["A", "R"], "l_returnflag")


@query(
    "expected_unseen_classes",
    f"""WITH {FLOWS}, u AS ({UNSEEN_SQL}), c AS (SELECT class FROM u WHERE class IN ('A', 'X'))
        SELECT class, (SELECT count(*) FROM c) = 2 AS all_expected_found FROM u
        WHERE class IN ('A', 'X') OR (SELECT count(*) FROM c) = 0""",
)
def expected_unseen_classes(spark, sf_dir):
    return populations.restrict_unseen(unseen_classes(spark, sf_dir), ["A", "X"])


@query(
    "benign_and_unseen_population",
    f"WITH {FLOWS} SELECT l_returnflag, count(*) AS n FROM test WHERE l_returnflag IN ('A', 'N') GROUP BY 1",
)
def benign_and_unseen_population(spark, sf_dir):
    rows = populations.population(test_side(flows(spark, sf_dir)), ["A"], "l_returnflag", BENIGN)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


POPULATIONS = f"""pops AS (
   SELECT 'all_test' AS population, * FROM test
   UNION ALL SELECT 'unseen_attacks_vs_benign', * FROM test WHERE l_returnflag IN ('A', 'N')
   UNION ALL SELECT 'unseen__A', * FROM test WHERE l_returnflag IN ('A', 'N')),
 {_long('pops', 'population', 'label_binary')}, {comparison_sql('long', ('population', 'detector'))}"""


@query("population_comparison", rounded(f"WITH {FLOWS}, {POPULATIONS} SELECT * FROM compared", *COMPARED))
def population_comparison(spark, sf_dir):
    return populations.compare_populations(
        test_side(flows(spark, sf_dir)), "label_binary", "l_returnflag", SCORES, THRESHOLDS, ["A"], BENIGN
    )


_RATE_SQL = {
    d: f"count(*) FILTER (WHERE {c} >= {THRESHOLDS[d]}e0)" for d, c in SCORES.items()
}


@query(
    "unseen_detection_wide",
    rounded(
        f"""WITH {FLOWS} SELECT l_returnflag AS attack_class, count(*) AS samples,
        {_RATE_SQL['random_forest']} AS RF_detected, {_RATE_SQL['random_forest']} / count(*)::DOUBLE AS RF_detection_rate,
        {_RATE_SQL['isolation_forest']} AS IF_detected, {_RATE_SQL['isolation_forest']} / count(*)::DOUBLE AS IF_detection_rate,
        {_RATE_SQL['hybrid']} AS hybrid_detected, {_RATE_SQL['hybrid']} / count(*)::DOUBLE AS hybrid_detection_rate
        FROM test WHERE l_returnflag = 'A' GROUP BY 1""",
        "RF_detection_rate", "IF_detection_rate", "hybrid_detection_rate",
    ),
)
def unseen_detection_wide(spark, sf_dir):
    rows = test_side(flows(spark, sf_dir)).where("l_returnflag = 'A'")
    per_class = metrics.per_class_results(rows, "l_returnflag", SCORES, THRESHOLDS)
    return populations.unseen_detection_wide(
        per_class, {"random_forest": "RF", "isolation_forest": "IF", "hybrid": "hybrid"}
    )


@query(
    "detection_rate_pivot",
    rounded(
        f"""WITH {FLOWS} SELECT l_returnflag AS class, {_RATE_SQL['random_forest']} / count(*)::DOUBLE AS random_forest,
        {_RATE_SQL['isolation_forest']} / count(*)::DOUBLE AS isolation_forest, {_RATE_SQL['hybrid']} / count(*)::DOUBLE AS hybrid
        FROM flows GROUP BY 1""",
        "random_forest", "isolation_forest", "hybrid",
    ),
)
def detection_rate_pivot(spark, sf_dir):
    return populations.detection_rate_pivot(per_class_results(spark, sf_dir), list(SCORES))


@query(
    "detector_findings",
    f"""WITH {FLOWS}, {POPULATIONS}, w AS (SELECT population, max(recall) FILTER (WHERE detector = 'random_forest') AS rf,
          max(recall) FILTER (WHERE detector = 'isolation_forest') AS an, max(recall) FILTER (WHERE detector = 'hybrid') AS hy
          FROM compared GROUP BY 1)
        SELECT population, 'best_detector' AS rule, CASE WHEN rf >= an AND rf >= hy THEN 'random_forest'
             WHEN an >= hy THEN 'isolation_forest' ELSE 'hybrid' END AS leader FROM w
        UNION ALL SELECT population, CASE WHEN an > rf THEN 'anomaly_ahead_of_forest' ELSE 'forest_at_least_anomaly' END, NULL FROM w
        UNION ALL SELECT population, CASE WHEN hy < least(rf, an) - 0.05 THEN 'hybrid_below_both'
             WHEN hy > greatest(rf, an) THEN 'hybrid_above_both' ELSE 'hybrid_between' END, NULL FROM w""",
)
def detector_findings(spark, sf_dir):
    found = evidence.findings(population_comparison(spark, sf_dir), "recall", ["population"], margin=0.05)
    leader = F.when(F.col("rule") == "best_detector", F.substring_index("message", " ", 1))
    return found.select("population", "rule", leader.alias("leader"))


@query(
    "count_findings",
    """SELECT 'significant_shifts' AS rule, (count(*) FILTER (WHERE s_acctbal < 100)) || '/' || count(*) AS amount FROM supplier
       UNION ALL SELECT 'unmapped_features', (count(*) FILTER (WHERE c_acctbal < 0)) || '/' || count(*) FROM customer
       UNION ALL SELECT 'infinities_replaced', (count(*) FILTER (WHERE l_discount = 0))::VARCHAR FROM lineitem""",
)
def count_findings(spark, sf_dir):
    """Suppliers stand for shift tests, customers for features, lines by flag for columns with infinities."""
    found = evidence.count_findings(
        spark, table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 10000).alias("p_value")),
        table(spark, sf_dir, "customer").select((F.col("c_acctbal") >= 0).alias("mapped")),
        table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") == 0).alias("n_infinite")),
    )
    return found.select("rule", F.substring_index("message", " ", 1).alias("amount"))


_TIED = """WITH o AS (SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN value >= 10 THEN 'FP' ELSE 'TN' END
    ELSE CASE WHEN value >= 10 THEN 'TP' ELSE 'FN' END END AS outcome FROM events)
  SELECT outcome, user_id FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY user_id) AS place FROM o) WHERE place <= {n}"""


@query("first_per_outcome_tied", _TIED.format(n=1))
def first_per_outcome_tied(spark, sf_dir):
    """The key is not unique, and still one row of each outcome comes back."""
    return evidence.first_per_outcome(_judged(spark, sf_dir), "user_id").select("outcome", "user_id")


@query("first_five_per_outcome_tied", _TIED.format(n=5))
def first_five_per_outcome_tied(spark, sf_dir):
    return evidence.first_per_outcome(_judged(spark, sf_dir), "user_id", 5).select("outcome", "user_id")


@query(
    "run_metadata",
    f"""WITH {FLOWS} SELECT count(*) FILTER (WHERE label_binary = 0) AS n_benign, count(*) FILTER (WHERE label_binary = 1) AS n_attack,
        'hybrid' AS detector, 0.5::DOUBLE AS threshold FROM flows""",
)
def run_metadata(spark, sf_dir):
    sizes = flows(spark, sf_dir).agg(
        F.count_if(F.col("label_binary") == 0).alias("b"), F.count_if(F.col("label_binary") == 1).alias("a")
    ).first()
    facts = evidence.run_metadata(
        spark, n_benign=sizes["b"], n_attack=sizes["a"], thresholds={"hybrid": 0.5}, checks_passed=["finite"]
    )
    return facts.select("n_benign", "n_attack", F.lit("hybrid").alias("detector"), F.col("thresholds.hybrid").alias("threshold"))


_ABS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "alerts",
    rounded(
        f"""WITH {FLOWS}, a AS (SELECT l_returnflag, rf_score, hybrid_score, list_sort([
              {", ".join(f"{{'s': -abs({f}::DOUBLE), 'i': {i}, 'f': '{f}', 'v': {f}::DOUBLE}}" for i, f in enumerate(_ABS))}])[1:3] AS top
              FROM flows WHERE hybrid_score >= 0.5)
        SELECT l_returnflag, count(*) AS n, avg(rf_score) AS rf, avg(hybrid_score) AS hybrid,
               count(*) FILTER (WHERE rf_score >= 0.3) AS rf_flags, avg(top[1].v) / 1000 AS first_value, avg(top[2].v) AS second_value,
               count(*) FILTER (WHERE top[3].f = 'l_linenumber') AS third_is_linenumber FROM a GROUP BY 1""",
        "rf", "hybrid", "first_value", "second_value",
    ),
)
def alerts(spark, sf_dir):
    """Read back from JSON files, so what is compared went through serialisation."""
    made = evidence.alerts(flows(spark, sf_dir), _ABS, 0.3, 0.5, keep=["l_returnflag"], k=3)
    path = scratch_path(spark, "alerts")
    made.select("l_returnflag", "alert_json").write.partitionBy("l_returnflag").text(path)
    schema = """predicted_label int, rf_attack_probability double, hybrid_score double,
        detector_decisions struct<random_forest: boolean, hybrid: boolean>, top_feature_values map<string, double>,
        l_returnflag string"""
    a = spark.read.schema(schema).json(path)
    values = F.map_values("top_feature_values")
    return a.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rf_attack_probability").alias("rf"),
        F.avg("hybrid_score").alias("hybrid"),
        F.count_if("detector_decisions.random_forest").alias("rf_flags"),
        (F.avg(values[0]) / 1000).alias("first_value"),
        F.avg(values[1]).alias("second_value"),
        F.count_if(F.map_keys("top_feature_values")[2] == "l_linenumber").alias("third_is_linenumber"),
    )


@query("first_alerts", "SELECT event_id FROM events WHERE value >= 10 ORDER BY event_id LIMIT 20")
def first_alerts(spark, sf_dir):
    flagged = table(spark, sf_dir, "events").where("value >= 10")
    return evidence.first_alerts(flagged, "event_id", 20).select("event_id")


_FIRSTS = """WITH o AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN value >= 10 THEN 'FP' ELSE 'TN' END
    ELSE CASE WHEN value >= 10 THEN 'TP' ELSE 'FN' END END AS outcome FROM events)
  SELECT event_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY event_id) AS place FROM o) WHERE place <= {n}"""


def _judged(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns(
        {"y": (~F.col("event_type").isin("view", "click")).cast("int"), "p": (F.col("value") >= 10).cast("int")}
    )
    return evidence.with_outcome(events, "y", "p")


@query("first_per_outcome", _FIRSTS.format(n=1))
def first_per_outcome(spark, sf_dir):
    return evidence.first_per_outcome(_judged(spark, sf_dir), "event_id").select("event_id", "outcome")


@query("first_five_per_outcome", _FIRSTS.format(n=5))
def first_five_per_outcome(spark, sf_dir):
    return evidence.first_per_outcome(_judged(spark, sf_dir), "event_id", 5).select("event_id", "outcome")


@query(
    "detector_union",
    f"""WITH {FLOWS}, {_long('flows', 'label_binary')} SELECT detector, label_binary::BIGINT AS label_binary, count(*) AS n FROM long GROUP BY 1, 2""",
)
def detector_union(spark, sf_dir):
    long = metrics.scores_long(flows(spark, sf_dir), SCORES, ["label_binary"])
    return long.groupBy("detector", "label_binary").agg(F.count(F.lit(1)).alias("n"))
