"""Model operators on small trees written out here, so that SQL can state every value, and facts about trained ones."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftgauge.catalog import detectors
from driftgauge.catalog.registry import query, rounded, table
from driftgauge.operators import evidence, explain
from driftgauge.operators.clean import impute
from driftgauge.operators.forest import feature_array
from driftgauge.operators.isolation import NODE_SCHEMA, AnomalyDetector, average_path
from driftgauge.operators.metrics import decide
from driftgauge.plans.detect import SCORES
from driftgauge.session import literal_table, scratch_path, settle
from driftgauge.streaming import flows as streams

PAIR = ("l_quantity", "l_extendedprice")
_LEAF = (-1, 0.0, -1, -1)
#: (tree, node, feature, threshold, left, right, size, depth)
ISOLATION = [
    (0, 0, 0, 25.0, 1, 2, 256, 0), (0, 1, *_LEAF, 100, 1), (0, 2, 1, 30000.0, 3, 4, 156, 1), (0, 3, *_LEAF, 150, 2), (0, 4, *_LEAF, 6, 2),
    (1, 0, 1, 40000.0, 1, 2, 256, 0), (1, 1, *_LEAF, 200, 1), (1, 2, *_LEAF, 56, 1),
]
#: (tree, node, feature, threshold, left, right, cover, value)
FOREST = [
    (0, 0, 0, 25.0, 1, 2, 100.0, 0.0), (0, 1, *_LEAF, 40.0, 0.1), (0, 2, 1, 30000.0, 3, 4, 60.0, 0.0),
    (0, 3, *_LEAF, 45.0, 0.4), (0, 4, *_LEAF, 15.0, 0.9),
    (1, 0, 1, 40000.0, 1, 2, 100.0, 0.0), (1, 1, *_LEAF, 80.0, 0.2), (1, 2, *_LEAF, 20.0, 0.7),
]


def _path(depth: int, size: int) -> str:
    return f"{depth + float(average_path(size))!r}::DOUBLE"


def _raw(q: str, e: str) -> str:
    first = f"CASE WHEN {q} <= 25 THEN {_path(1, 100)} WHEN {e} <= 30000 THEN {_path(2, 150)} ELSE {_path(2, 6)} END"
    second = f"CASE WHEN {e} <= 40000 THEN {_path(1, 200)} ELSE {_path(1, 56)} END"
    return f"pow(2.0, -(({first}) + ({second})) / {2 * float(average_path(256))!r})"


def _detector(spark) -> AnomalyDetector:
    nodes = literal_table(spark, ISOLATION, NODE_SCHEMA)
    return AnomalyDetector(nodes, PAIR, {f: 0.0 for f in PAIR}, 256, n_trees=2)


@query(
    "literal_anomaly_scores",
    rounded(
        f"""WITH r AS (SELECT l_returnflag, {_raw('l_quantity', 'l_extendedprice')} AS raw FROM lineitem),
            s AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS scaled FROM r)
            SELECT l_returnflag, count(*) AS n, avg(raw) AS mean_raw, max(raw) AS max_raw, avg(scaled) AS mean_score FROM s GROUP BY 1""",
        "mean_raw", "max_raw", "mean_score",
    ),
)
def literal_anomaly_scores(spark, sf_dir):
    """Raw and batch-scaled scores of two written-out trees."""
    detector = _detector(spark)
    scored = detector.score(detector.score_raw(table(spark, sf_dir, "lineitem").select("l_returnflag", *PAIR)))
    return scored.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("anomaly_raw").alias("mean_raw"), F.max("anomaly_raw").alias("max_raw"),
        F.avg("anomaly_score").alias("mean_score"),
    )


@query(
    "literal_anomaly_attribution",
    rounded(
        f"""WITH m AS (SELECT median(l_quantity) AS q, median(l_extendedprice) AS e FROM lineitem),
            d AS (SELECT avg(abs({_raw('l_quantity', 'l_extendedprice')} - {_raw('m.q', 'l_extendedprice')})) AS dq,
                         avg(abs({_raw('l_quantity', 'l_extendedprice')} - {_raw('l_quantity', 'm.e')})) AS de FROM lineitem, m),
            f AS (SELECT 'l_quantity' AS feature, dq AS importance FROM d UNION ALL SELECT 'l_extendedprice', de FROM d)
            SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM f""",
        "importance",
    ),
)
def literal_anomaly_attribution(spark, sf_dir):
    """How far the raw score moves when one feature is set to its median."""
    found = explain.anomaly_global(_detector(spark), table(spark, sf_dir, "lineitem").select(*PAIR))
    return found.select("feature", "importance", "rank")


# v(S) of the first tree by the features known: none, q, e, both; the second tree has e only.
_SHAPLEY = """
v AS (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS e,
        0.40e0 * 0.1e0 + 0.45e0 * 0.4e0 + 0.15e0 * 0.9e0 AS v0,
        CASE WHEN l_quantity <= 25 THEN 0.1e0 ELSE 0.75e0 * 0.4e0 + 0.25e0 * 0.9e0 END AS vq,
        0.4e0 * 0.1e0 + 0.6e0 * CASE WHEN l_extendedprice <= 30000 THEN 0.4e0 ELSE 0.9e0 END AS ve,
        CASE WHEN l_quantity <= 25 THEN 0.1e0 WHEN l_extendedprice <= 30000 THEN 0.4e0 ELSE 0.9e0 END AS vqe,
        CASE WHEN l_extendedprice <= 40000 THEN 0.2e0 ELSE 0.7e0 END - (0.8e0 * 0.2e0 + 0.2e0 * 0.7e0) AS w FROM lineitem),
s AS (SELECT *, ((vq - v0) + (vqe - ve)) / 2 / 2 AS cq, (((ve - v0) + (vqe - vq)) / 2 + w) / 2 AS ce FROM v)"""


def _contributions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(*PAIR).alias("x"))
    trees = literal_table(
        spark, FOREST, "tree int, node int, feature int, threshold double, left int, right int, cover double, value double"
    )
    return explain.tree_contributions(trees, 2, 2, rows)


@query(
    "literal_tree_contributions",
    rounded(
        f"""WITH {_SHAPLEY} SELECT l_returnflag, avg(cq) AS quantity, avg(ce) AS price, avg(abs(cq)) AS quantity_size,
            max(ce) AS highest_price FROM s GROUP BY 1""",
        "quantity", "price", "quantity_size", "highest_price",
    ),
)
def literal_tree_contributions(spark, sf_dir):
    """Shapley contributions of two written-out trees, which SQL enumerates by coalition."""
    c = F.col("contributions")
    return _contributions(spark, sf_dir).groupBy("l_returnflag").agg(
        F.avg(c[0]).alias("quantity"), F.avg(c[1]).alias("price"), F.avg(F.abs(c[0])).alias("quantity_size"), F.max(c[1]).alias("highest_price")
    )


@query(
    "literal_contributors",
    f"""WITH {_SHAPLEY}, c AS (SELECT CASE WHEN cq > 1e-12 AND cq >= ce THEN 'l_quantity' WHEN ce > 1e-12 THEN 'l_extendedprice' END AS first_for,
          CASE WHEN cq < -1e-12 AND cq <= ce THEN 'l_quantity' WHEN ce < -1e-12 THEN 'l_extendedprice' END AS first_against FROM s)
        SELECT first_for, first_against, count(*) AS n FROM c GROUP BY 1, 2""",
)
def literal_contributors(spark, sf_dir):
    """The strongest contributor of each sign in every row."""
    items = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col("x")[i].alias("value"), F.round(F.col("contributions")[i], 12).alias("contribution"))
            for i, f in enumerate(PAIR)
        ]
    )
    best = lambda sign: F.get(evidence.top_contributors(items, 1, sign), F.lit(0))["feature"]
    return _contributions(spark, sf_dir).groupBy(best(1).alias("first_for"), best(-1).alias("first_against")).agg(
        F.count(F.lit(1)).alias("n")
    )


_FOREST_SCORE = """((CASE WHEN q <= 25 THEN 0.1e0 WHEN e <= 30000 THEN 0.4e0 ELSE 0.9e0 END)
  + (CASE WHEN e <= 40000 THEN 0.2e0 ELSE 0.7e0 END)) / 2"""
_REPEATS, _SEED, _ATTACK_SCORE = 3, 7, 0.35
_TRIALS = ", ".join(str((f, *explain.seat_permutation(i, r, _SEED))) for i, f in enumerate(PAIR) for r in range(_REPEATS))


class _WrittenForest:
    """The two trees of ``FOREST`` as a detector."""

    features, medians = PAIR, {f: 0.0 for f in PAIR}

    def score_vectors(self, df, vector, column):
        x = vector_to_array(F.col(vector))
        pair = df.withColumns({"q": x[0], "e": x[1]})
        return pair.withColumn(column, F.expr(_FOREST_SCORE)).drop("q", "e", vector)


@query(
    "literal_permutation_importance",
    rounded(
        f"""WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seat, count(*) OVER () AS n,
              l_quantity AS q, l_extendedprice AS e, l_returnflag = 'R' AS y FROM lineitem),
            t(feature, a, b) AS (VALUES {_TRIALS}),
            m AS (SELECT t.feature, t.a, s.y, CASE WHEN t.feature = 'l_quantity' THEN g.q ELSE s.q END AS q,
                    CASE WHEN t.feature = 'l_quantity' THEN s.e ELSE g.e END AS e
                  FROM t CROSS JOIN s AS g JOIN s ON s.seat = (t.a::BIGINT * g.seat + t.b) % g.n
                  UNION ALL SELECT 'none', 0, y, q, e FROM s),
            c AS (SELECT feature, a, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE y <> p) AS wrong
                  FROM (SELECT *, {_FOREST_SCORE} >= {_ATTACK_SCORE} AS p FROM m) GROUP BY 1, 2),
            f AS (SELECT feature, coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0) AS f1 FROM c)
            SELECT feature, avg(b.f1 - f.f1) AS importance, stddev_pop(b.f1 - f.f1) AS spread
            FROM f, (SELECT f1 FROM f WHERE feature = 'none') AS b WHERE feature <> 'none' GROUP BY 1""",
        "importance", "spread",
    ),
)
def literal_permutation_importance(spark, sf_dir):
    """Values trade places by an exchange of seats that SQL states too."""
    attack = (F.col("l_returnflag") == "R").cast("int")
    rows = table(spark, sf_dir, "lineitem").withColumn("label_binary", attack)
    found = explain.permutation_importance(
        _WrittenForest(), rows, "l_orderkey", _ATTACK_SCORE, repeats=_REPEATS, seed=_SEED, seats=[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    )
    return found.select(
        "feature", F.col("permutation_importance_mean").alias("importance"), F.col("permutation_importance_std").alias("spread")
    )


@query(
    "forest_facts",
    """SELECT 4::BIGINT AS features, 1.0::DOUBLE AS importance_sum, 0::BIGINT AS negative, 0::BIGINT AS not_additive,
              count(*) AS explained FROM lineitem WHERE l_linestatus = 'O'""",
)
def forest_facts(spark, sf_dir):
    """Shares add up to one, and the contributions of every row add up to its score less the mean of the trees' roots."""
    detector = detectors._forest(spark, sf_dir)
    shares = detector.importances(spark).agg(
        F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance_sum"), F.count_if(F.col("importance") < 0).alias("negative")
    )
    test = impute(detectors._test(spark, sf_dir).select(*detectors.FEATURES), detector.medians)
    rows = detector.score(test).select(feature_array(detectors.FEATURES).alias("x"), "rf_score")
    base = detector.nodes(spark).where("node = 0").agg(F.avg("value").alias("base"))
    explained = explain.contributions_by_cell(detector, rows).crossJoin(base)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    additive = F.abs(F.col("rf_score") - F.col("base") - total) <= 1e-6
    return shares.crossJoin(
        explained.agg(F.count_if(~F.coalesce(additive, F.lit(False))).alias("not_additive"), F.count("contributions").alias("explained"))
    )


_SIZES = """SELECT detector, count(*) AS n, count(*) FILTER (WHERE attack) AS attacks
  FROM ({rows}), (VALUES ('random_forest'), ('isolation_forest'), ('hybrid')) AS d(detector) GROUP BY 1"""


def _sizes(comparison):
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return comparison.select("detector", n.alias("n"), (F.col("tp") + F.col("fn")).alias("attacks"))


@query(
    "detector_sizes",
    _SIZES.format(rows="SELECT l_discount >= 0.07 AND l_quantity >= 25 AS attack FROM lineitem WHERE l_linestatus = 'O'"),
)
def detector_sizes(spark, sf_dir):
    return _sizes(detectors.detector_evaluation(spark, sf_dir))


@query("external_sizes", _SIZES.format(rows="SELECT o_orderstatus <> 'F' AS attack FROM orders"))
def external_sizes(spark, sf_dir):
    return _sizes(detectors.external_evaluation(spark, sf_dir))


@query("stream_and_batch", "SELECT l_returnflag, 0::BIGINT AS differing, count(*) AS n FROM lineitem GROUP BY 1")
def stream_and_batch(spark, sf_dir):
    """Rows scored on a stream have the alerts of the batch."""
    models = detectors._detectors(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    stream = streams.read_flow_stream(spark, sf_dir, lines.schema, "lineitem.parquet")
    made = streams.score_flow_stream(stream, models, detectors.THRESHOLDS, keep=["l_returnflag"], timestamp="l_shipdate")
    out = scratch_path(spark, "alerts")
    streams.write_stream(made, f"{out}/rows", f"{out}/progress").awaitTermination()
    hit = decide(F.col(SCORES["hybrid"]), detectors.THRESHOLDS.by_detector()["hybrid"])
    batch = models.score(lines, ["l_returnflag"]).groupBy("l_returnflag").agg(F.sum(hit).alias("any"), F.count(F.lit(1)).alias("n"))
    live = spark.read.parquet(f"{out}/rows").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("alerts"))
    return batch.join(live, "l_returnflag", "left").select(
        "l_returnflag", F.abs(F.coalesce("alerts", F.lit(0)) - F.col("any")).alias("differing"), "n"
    )


@query(
    "evidence_fields",
    """SELECT count(*) > 0 AS any, 'machine_learning_detector' AS authority, 0::BIGINT AS other_outcome, 0::BIGINT AS other_prediction,
              0::BIGINT AS unranked FROM lineitem""",
)
def evidence_fields(spark, sf_dir):
    """What the JSON of an evidence record says is what stands beside it."""
    records = settle(detectors.evidence_records(spark, sf_dir), "evidence")
    said = lambda path: F.get_json_object("evidence_json", path)
    sizes = F.from_json(said("$.top_positive_contributors"), "array<struct<contribution: double>>")["contribution"]
    return records.agg(
        (F.count(F.lit(1)) > 0).alias("any"), F.max(said("$.decision_authority")).alias("authority"),
        F.count_if(~said("$.outcome").eqNullSafe(F.col("outcome"))).alias("other_outcome"),
        F.count_if(~said("$.prediction").eqNullSafe(F.col("prediction"))).alias("other_prediction"),
        F.count_if(F.sort_array(sizes, False) != sizes).alias("unranked"),
    )
