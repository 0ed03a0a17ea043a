import json
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import cells, evidence, explain, isolation
from driftgauge.operators import forest as forest_module
from driftgauge.operators.forest import (
    ForestDetector, Leaf, expected_value, feature_array, shapley_values, train_forest, tree_leaves,
)
from driftgauge.operators.isolation import AnomalyDetector, average_path, rewrap_detector, train_isolation_forest
from driftgauge.operators.sampling import benign_heavy_sample

FEATURES = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (240, 3)), rng.normal(5, 1, (60, 3))])
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["label_binary"] = [0] * 240 + [1] * 60
    pdf["key"] = range(1000, 1300)
    return spark.createDataFrame(pdf).repartition(4, "key").cache()


@pytest.fixture(scope="module")
def forest(flows):
    return train_forest(flows, FEATURES, n_trees=6, max_depth=6)


@pytest.fixture(scope="module")
def anomaly(flows):
    return train_isolation_forest(benign_heavy_sample(flows, FEATURES, 200, row_key="key"), n_trees=60, row_key="key")


def test_forest_scores_and_reload(spark, flows, forest, tmp_path):
    means = {r["label_binary"]: r["m"] for r in forest.score(flows).groupBy("label_binary").agg(F.avg("rf_score").alias("m")).collect()}
    assert means[1] > 0.9 > 0.1 > means[0]
    assert forest.importances(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1)
    forest.save(str(tmp_path / "m"))
    again = ForestDetector.load(spark, str(tmp_path / "m"))
    assert again.features == forest.features and again.medians == forest.medians
    both = again.score(forest.score(flows, "a"), "b")
    assert both.where("a <> b").count() == 0


def test_forest_refuses_unlabelled_rows(flows):
    with pytest.raises(ValueError):
        train_forest(flows.withColumn("label_binary", F.lit(None).cast("int")), FEATURES, n_trees=1)


def test_missing_features_take_the_median(flows, forest):
    gap = flows.limit(5).withColumn("f1", F.lit(None).cast("double"))
    filled = flows.limit(5).withColumn("f1", F.lit(forest.medians["f1"]))
    key = lambda df: {r["key"]: r["rf_score"] for r in forest.score(df).collect()}
    assert key(gap.orderBy("key")) == key(filled.orderBy("key"))


@pytest.mark.parametrize("most_nodes", [explain.MOST_NODES, 3])
def test_contributions_add_up_to_the_score(spark, flows, forest, monkeypatch, most_nodes):
    """Both where the forest goes to every task and where it is spread by tree."""
    trees = forest.nodes(spark)
    nodes = trees.toPandas()
    base = np.mean([expected_value(tree_leaves(tree)) for _, tree in nodes.groupby("tree")])
    rows = forest.score(flows).select("key", feature_array(FEATURES).alias("v"), "rf_score")
    rows = rows.unionByName(rows.limit(5))
    monkeypatch.setattr(explain, "ROWS_PER_BLOCK", 70)
    found = explain.tree_contributions(trees, nodes["tree"].nunique(), len(FEATURES), rows, "v", "c", most_nodes)
    assert found.columns == ["key", "v", "rf_score", "c"]
    got = found.toPandas()
    total = np.stack(got["c"].to_numpy()).sum(axis=1)
    assert len(got) == 305 and np.abs(total + base - got["rf_score"]).max() < 1e-9
    assert explain.tree_contributions(trees, 1, len(FEATURES), rows.where("false"), "v", "c", most_nodes).collect() == []


def test_rows_are_explained_where_they_are(spark, forest):
    rows = spark.range(10).select(F.array(*[F.col("id").cast("double")] * 3).alias("x"))
    plan = explain.forest_contributions(forest, rows)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "CoGroup" not in plan


@pytest.mark.parametrize("bits,together", [(6, 128), (1, 3), (0, 1)])
def test_tree_tables_agree_at_any_setting(forest, spark, monkeypatch, bits, together):
    """Looked up or evaluated combination by combination: the same values, also at the thresholds themselves."""
    leaves = tree_leaves(forest.nodes(spark).where("tree = 1").toPandas())
    edges = [b for leaf in leaves for b in (*leaf.low, *leaf.high) if np.isfinite(b)]
    rng = np.random.default_rng(3)
    x = rng.choice(np.concatenate([edges, rng.normal(size=50), [np.inf, -np.inf]]), (200, len(FEATURES)))
    expected = np.zeros_like(x)
    for leaf in leaves:
        if len(leaf.features):
            mine = x[:, leaf.features]
            inside = ((mine > leaf.low) & (mine <= leaf.high)).astype(float)
            inside[(mine == -np.inf) & (leaf.low == -np.inf)] = 1.0
            expected[:, leaf.features] += forest_module._path_values(leaf, inside)
    monkeypatch.setattr(forest_module, "PATTERN_BITS", bits)
    monkeypatch.setattr(forest_module, "LEAVES_TOGETHER", together)
    assert np.abs(shapley_values(leaves, x) - expected).max() < 1e-12


def test_forest_grows_on_counts_of_cells(spark, flows, monkeypatch):
    """MLlib's training meets one row for each class, however many rows there are; the rest is counted."""
    met, fit = [], forest_module.RandomForestClassifier.fit
    monkeypatch.setattr(forest_module.RandomForestClassifier, "fit", lambda self, df: met.append(df.count()) or fit(self, df))
    many = flows.crossJoin(spark.range(40))
    detector = train_forest(many, FEATURES, n_trees=6, max_depth=6)
    assert met == [2]
    nodes = detector.nodes(spark).toPandas().set_index(["tree", "node"])
    roots, inner = nodes.xs(0, level="node"), nodes[nodes.left >= 0]
    assert len(roots) == 6 and len(inner) > 6 and 0 < inner.index.get_level_values("node").max() < 200
    weighted = 300 * 40  # balanced classes weigh as much as all rows together
    assert np.allclose(roots.cover, weighted, rtol=0.05) and roots.cover.nunique() == 6
    for side in ("left", "right"):
        assert nodes.index.isin(list(zip(inner.index.get_level_values("tree"), inner[side]))).sum() == len(inner)
    both = [nodes.loc[(t, r.left), "cover"] + nodes.loc[(t, r.right), "cover"] for (t, _), r in inner.iterrows()]
    assert np.allclose(both, inner.cover)
    means = {r[0]: r[1] for r in detector.score(flows).groupBy("label_binary").agg(F.avg("rf_score")).collect()}
    assert means[1] > 0.9 > 0.1 > means[0]


def test_scores_looked_up_by_cell_are_those_of_the_trees(spark, forest):
    assert forest.by_cell
    edges = [t for s in forest.splits for t in s]
    rng = np.random.default_rng(5)
    x = rng.choice(np.concatenate([edges, rng.normal(2, 3, 200), [np.inf, -np.inf, -0.0]]), (500, len(FEATURES)))
    df = spark.createDataFrame(pd.DataFrame(x, columns=FEATURES).assign(key=range(500)))
    rows = forest.score(df, "a").select("key", "a", forest_module.array_to_vector(feature_array(FEATURES)).alias("v"))
    found = forest._transformed(forest.score_vectors(rows, "v", "b"), "v", "c").toPandas()
    assert len(found) == 500 and (found.a == found.c).all() and (found.b == found.c).all() and found.a.nunique() > 5


def test_looking_up_scores_moves_no_row(spark, forest):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).select(*[F.col("id").cast("double").alias(f) for f in FEATURES])
        vectors = rows.select(forest_module.array_to_vector(feature_array(FEATURES)).alias("v"))
        for scored in (forest.score(rows), forest.score_vectors(vectors, "v", "s")):
            plan = scored._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_sample_is_explained_by_cell_in_few_tasks(spark, flows, forest, monkeypatch):
    met, whole = [], explain.forest_contributions
    monkeypatch.setattr(
        explain, "forest_contributions", lambda d, v, *a: met.append((v.count(), v.rdd.getNumPartitions())) or whole(d, v, *a)
    )
    rows = flows.crossJoin(spark.range(20)).where("id = 0 OR key % 3 = 0").repartition(40)
    got = {r["feature"]: (r["mean_abs_shap"], r["rank"]) for r in explain.forest_global(forest, rows).collect()}
    each = whole(forest, rows.select(feature_array(FEATURES).alias("x"))).toPandas()
    means = np.abs(np.stack(each["contributions"].to_numpy())).mean(axis=0)
    assert met[0][0] <= 300 and met[0][1] == 1
    assert {f: v for f, (v, _) in got.items()} == pytest.approx(dict(zip(FEATURES, means)))
    assert [got[f][1] for f in np.array(FEATURES)[np.argsort(-means)]] == [1, 2, 3]


def test_copies_are_explained_once(spark, flows, forest, monkeypatch):
    rows = flows.crossJoin(spark.range(20)).select("key", feature_array(FEATURES).alias("v"))
    met, whole = [], explain.forest_contributions
    monkeypatch.setattr(explain, "forest_contributions", lambda d, v, *a: met.append(v.count()) or whole(d, v, *a))
    got = explain.contributions_by_cell(forest, rows, "v", "c")
    each = whole(forest, flows.select("key", feature_array(FEATURES).alias("v")), "v", "c").select("key", F.col("c").alias("d"))
    both = got.join(each, "key").toPandas()
    assert got.columns == ["key", "v", "c"] and len(both) == 6000 and met[0] <= 300
    assert np.abs(np.stack(both.c.to_numpy()) - np.stack(both.d.to_numpy())).max() < 1e-12


def test_more_cells_than_a_task_holds_go_to_mllib(flows, monkeypatch):
    monkeypatch.setattr(forest_module, "MOST_CELLS", 3)
    monkeypatch.setattr(forest_module, "ROWS_PER_TASK", 100)
    detector = train_forest(flows, FEATURES, n_trees=6, max_depth=6)
    means = {r[0]: r[1] for r in detector.score(flows).groupBy("label_binary").agg(F.avg("rf_score")).collect()}
    assert detector.splits is None and means[1] > 0.9 > 0.1 > means[0]


def test_candidate_splits(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(1.0).alias("one"),
        F.when(F.col("id") < 5, 1.0).otherwise(0.0).alias("rare"),
    )
    few, many, one, rare = cells.candidate_splits(df, ["few", "many", "one", "rare"], 32)
    assert few == (0.5, 1.5) and one == () and rare == (0.5,) and len(many) == 31
    assert np.abs(np.asarray(many) - np.arange(1, 32) * 1000 / 32).max() < 8


def test_shapley_values_by_enumeration():
    leaves = [
        Leaf(np.array([0, 1, 2]), np.array([-np.inf, 0.0, -1.0]), np.array([0.5, np.inf, 1.0]), np.array([0.3, 0.6, 0.9]), 0.7),
        Leaf(np.array([1]), np.array([-np.inf]), np.array([0.0]), np.array([0.4]), 0.2),
    ]
    x = np.array([[0.0, 1.0, 0.0], [1.0, -1.0, 5.0]])

    def value(row, known):
        total = 0.0
        for leaf in leaves:
            share = leaf.value
            for f, low, high, kept in zip(leaf.features, leaf.low, leaf.high, leaf.kept):
                share *= float(low < row[f] <= high) if f in known else kept
            total += share
        return total

    for row, got in zip(x, shapley_values(leaves, x)):
        for j in range(3):
            others = [f for f in range(3) if f != j]
            expected = sum(
                factorial(k) * factorial(2 - k) / factorial(3) * (value(row, {*s, j}) - value(row, set(s)))
                for k in range(3) for s in combinations(others, k)
            )
            assert got[j] == pytest.approx(expected, abs=1e-12)


def test_isolation_trees(flows, anomaly):
    nodes = anomaly.nodes.toPandas()
    assert nodes.tree.nunique() == 60 and (nodes[nodes.depth == 0]["size"] == 200).all() and nodes.depth.max() <= 8
    inner = nodes[nodes.left >= 0].merge(nodes[["tree", "node", "size"]], left_on=["tree", "left"], right_on=["tree", "node"])
    inner = inner.merge(nodes[["tree", "node", "size"]], left_on=["tree", "right"], right_on=["tree", "node"], suffixes=("", "_r"))
    assert (inner["size_x"] == inner["size_y"] + inner["size"]).all()
    assert average_path([1, 2])[1] == 1.0 and average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_isolation_look_ups_score_like_the_walk(anomaly, monkeypatch):
    arrays = anomaly.arrays
    assert all(arrays.tables)
    rng = np.random.default_rng(3)
    odd = [np.nan, np.inf, -np.inf, 0.0]
    rows = np.stack([rng.choice(np.concatenate([e, e + 1e-9, rng.normal(2, 3, 200), odd]), 5000) for e in arrays.edges], axis=1)
    walked = isolation._score_trees((*arrays.parts()[:-1], [None] * len(arrays.feature)), rows)
    assert (arrays.score(rows) == walked).all()
    monkeypatch.setattr(isolation, "TABLE_ENTRIES", 100)
    small = isolation.TreeArrays(arrays.feature, arrays.threshold, arrays.length, arrays.depth, arrays.scale)
    assert not any(small.tables) and (small.score(rows) == walked).all()


def test_isolation_trees_without_a_split_or_with_many_features():
    rng = np.random.default_rng(4)
    grown = [isolation._grow(x, i, 5, 8) for i, x in enumerate([np.ones((256, 40)), rng.normal(size=(256, 40))])]
    nodes = pd.concat([tree.astype({"threshold": float}) for tree in grown])
    arrays = isolation.TreeArrays.of(nodes, 256)
    rows = rng.normal(size=(300, 40))
    assert [table is not None for table in arrays.tables] == [True, False]
    walked = isolation._score_trees((*arrays.parts()[:-1], [None, None]), rows)
    assert (arrays.score(rows) == walked).all()


def test_anomaly_scores(spark, flows, anomaly, tmp_path):
    scored = anomaly.score(flows).toPandas()
    assert scored.anomaly_score.min() == 0.0 and scored.anomaly_score.max() == 1.0
    means = scored.groupby("label_binary").anomaly_score.mean()
    assert means[1] > means[0]
    gaps = anomaly.score(flows.withColumn("f1", F.when(F.col("key") != 1000, F.col("f1"))))
    assert gaps.where("anomaly_score IS NULL").count() == 0
    constant = flows.select(*[F.lit(0.0).alias(f) for f in FEATURES])
    assert anomaly.score(constant).agg(F.max("anomaly_score")).first()[0] == 0.0
    frozen = anomaly.freeze_range(flows)
    frozen.save(str(tmp_path / "a"))
    again = AnomalyDetector.load(spark, str(tmp_path / "a"))
    one = flows.where("key = 1005")
    assert again.score(one).first()["anomaly_score"] == frozen.score(one).first()["anomaly_score"]
    assert again.config() == anomaly.config()


def test_training_is_repeatable(flows, anomaly):
    sample = benign_heavy_sample(flows.repartition(3), FEATURES, 200, row_key="key")
    again = train_isolation_forest(sample, n_trees=60, row_key="key")
    a, b = (d.nodes.orderBy("tree", "node").collect() for d in (anomaly, again))
    assert a == b and again.offset == anomaly.offset
    wrapped = rewrap_detector(anomaly, flows, row_key="key", n_samples=200)
    assert wrapped.medians == anomaly.medians
    with pytest.raises(KeyError):
        rewrap_detector(anomaly, flows.drop("f1"))


def test_global_anomaly_attribution_matches_perturbing_by_hand(flows, anomaly):
    got = {r["feature"]: r["importance"] for r in explain.anomaly_global(anomaly, flows).collect()}
    x = flows.toPandas()[FEATURES].to_numpy()
    base = anomaly.arrays.score(x)
    for j, f in enumerate(FEATURES):
        moved = x.copy()
        moved[:, j] = np.median(x[:, j])
        assert got[f] == pytest.approx(np.abs(base - anomaly.arrays.score(moved)).mean(), abs=1e-12)


def test_local_explanations_and_evidence(flows, forest, anomaly):
    scored = anomaly.score(forest.score(flows))
    local = explain.forest_local(forest, scored, "key", 0.5, k=2, dataset="CTU-IDSEVAL-6")
    rows = {r["outcome"]: r for r in local.collect()}
    assert rows["TP"]["sample_index"] == 1240 and rows["TN"]["sample_index"] == 1000
    assert all(c["contribution"] > 0 for c in rows["TP"]["top_positive_contributors"])
    sizes = [c["contribution"] for c in rows["TP"]["top_positive_contributors"]]
    assert len(sizes) <= 2 and sizes == sorted(sizes, reverse=True)
    other = explain.anomaly_local(anomaly, scored, "key", 0.5)
    assert other.first()["score_semantics"] == "normalized_anomaly_score_not_probability"
    both = local.unionByName(other, allowMissingColumns=True)
    records = evidence.evidence_records(both, 0.01, 0.15, 0.5, {"rf": 0.7, "anomaly": 0.3}, {"f1": "mapped"}).collect()
    for r in records:
        record = json.loads(r["evidence_json"])
        assert record["llm_role"] == "narration_only_no_detection_override"
        assert record["frozen_configuration"]["hybrid_weights"] == {"rf": 0.7, "anomaly": 0.3}
        external = record["dataset"] == "CTU-IDSEVAL-6"
        assert ("day6_representation" in record) == external
        if external:
            assert record["day6_representation"]["mapped_feature_count"] == 9
            tags = {c["feature"]: c["feature_source"] for c in record["top_positive_contributors"]}
            assert all(v == ("mapped" if k == "f1" else "unknown_day6_source") for k, v in tags.items())
        assert len(record["limitations"]) == len(set(record["limitations"]))


def test_permutation_importance(flows, forest):
    rows = {r["feature"]: r for r in explain.permutation_importance(forest, flows, "key", 0.5).collect()}
    again = {r["feature"]: r for r in explain.permutation_importance(forest, flows.repartition(2), "key", 0.5).collect()}
    assert set(rows) == set(FEATURES) and rows == again
    assert max(r["permutation_importance_mean"] for r in rows.values()) > 0


def test_importance_comparison(spark):
    s = spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 2)], "feature string, mean_abs_shap double, shap_rank int")
    b = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.7)], "feature string, rf_builtin_importance double")
    p = spark.createDataFrame([("a", 0.2, 0.01), ("b", -0.1, 0.01)], "feature string, permutation_importance_mean double, permutation_importance_std double")
    rows = explain.importance_comparison(s, b, p).collect()
    assert [r["feature"] for r in rows] == ["a", "b", "c"]
    assert sum(r["shap_normalized"] for r in rows) == pytest.approx(1)
    assert {r["feature"]: r["builtin_rank"] for r in rows} == {"a": 1, "b": 3, "c": 1}
    assert rows[1]["permutation_normalized"] == pytest.approx(1 / 3)
    zero = spark.createDataFrame([("a", 0.0)], "feature string, mean_abs_shap double")
    shares = explain.importance_comparison(zero, b, p).collect()
    assert all(r["shap_normalized"] == 0.0 for r in shares)


def test_outcomes_and_alerts(spark):
    df = spark.createDataFrame([(10, 1, 1), (11, 0, 0), (12, 0, 1), (13, 1, 0)], "id int, y int, p int")
    got = {r["outcome"]: r["id"] for r in evidence.with_outcome(df, "y", "p").collect()}
    assert got == {"TP": 10, "TN": 11, "FP": 12, "FN": 13}
    rows = spark.createDataFrame(
        [(1.0, -9.0, float("nan"), 0.9, 0.4, 0.8), (2.0, 2.0, None, 0.1, 0.1, 0.1)],
        "f1 double, f2 double, f3 double, rf_score double, anomaly_score double, hybrid_score double",
    )
    made = evidence.alerts(rows, FEATURES, 0.5, 0.5, k=5).collect()
    assert len(made) == 1
    alert = json.loads(made[0]["alert_json"])
    assert alert["timestamp"] is None and alert["predicted_label"] == 1
    assert list(alert["top_feature_values"].items()) == [("f2", -9.0), ("f1", 1.0)]
    assert alert["detector_decisions"] == {"random_forest": True, "hybrid": True}
    tied = spark.createDataFrame([(3.0, -3.0, 3.0)], "f1 double, f2 double, f3 double")
    assert tied.select(F.map_keys(evidence.top_values(FEATURES, 2)).alias("m")).first()["m"] == ["f1", "f2"]


def test_findings(spark):
    rows = [("random_forest", 0.8), ("isolation_forest", 0.9), ("hybrid", 0.5)]
    df = spark.createDataFrame(rows, "detector string, recall double")
    assert [r["rule"] for r in evidence.findings(df).collect()] == [
        "best_detector", "anomaly_ahead_of_forest", "hybrid_below_both"
    ]
    assert evidence.findings(df.where("recall > 0.6")).count() == 0


def test_scale_to_unit(spark):
    got = spark.range(3).select(isolation.scale_to_unit(F.col("id"), 0.0, 2.0).alias("v")).collect()
    assert [r["v"] for r in got] == [0.0, 0.5, 1.0]


def test_copies_of_a_row_have_tickets_of_their_own(spark):
    from driftgauge.operators.isolation import train_isolation_forest
    from driftgauge.operators.sampling import benign_heavy_sample

    df = spark.range(2000).selectExpr("cast(id % 20 as double) as f", "cast(id % 10 = 0 as int) as label_binary")
    detector = train_isolation_forest(benign_heavy_sample(df, ["f"]), n_trees=10)
    roots = detector.nodes.where("depth = 0").collect()
    assert len(roots) == 10 and {r["size"] for r in roots} == {256}


def test_first_of_an_outcome_is_one_row(spark):
    rows = [(1, "TP", "x"), (1, "TP", "y"), (None, "TP", "z"), (2, "FN", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "k int, outcome string, note string")
    assert sorted((r["outcome"], r["k"]) for r in evidence.first_per_outcome(df, "k").collect()) == [("FN", 2), ("TP", 1)]
    assert evidence.first_per_outcome(df, "k", 9).count() == 4


def test_count_findings(spark):
    tests = spark.createDataFrame([(0.001,), (0.5,)], "p_value double")
    known = spark.createDataFrame([(True,), (False,)], "mapped boolean")
    none = spark.createDataFrame([(0,)], "n_infinite long")
    assert [r["rule"] for r in evidence.count_findings(spark, tests, known, none).collect()] == ["significant_shifts", "unmapped_features"]
    assert evidence.count_findings(spark).count() == 0


def test_forest_facts_see_every_row(spark, monkeypatch):
    from driftgauge.catalog import QUERIES

    folder, whole = "/root/testdata/sf0.001", explain.forest_contributions
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_linestatus = 'O'").count()
    others = F.pmod(F.xxhash64("x"), F.lit(64)) != 0
    facts = QUERIES["forest_facts"](spark, folder).first()
    assert (facts["explained"], facts["not_additive"]) == (rows, 0)
    shifted = F.transform("contributions", lambda c: c + F.when(others, 1.0).otherwise(0.0))
    monkeypatch.setattr(explain, "forest_contributions", lambda d, v: whole(d, v).withColumn("contributions", shifted))
    assert QUERIES["forest_facts"](spark, folder).first()["not_additive"] > rows // 2
    monkeypatch.setattr(explain, "forest_contributions", lambda d, v: whole(d, v).where(~others))
    assert QUERIES["forest_facts"](spark, folder).first()["explained"] < rows // 2


@pytest.mark.parametrize("n", [1, 2, 97, 4096, 99_991])
def test_seats_are_exchanged_one_to_one(n):
    seen = set()
    for feature, repeat in ((0, 0), (3, 1), (7, 4)):
        a, b = explain.seat_permutation(feature, repeat, 42)
        assert all(a % k for k in range(2, 2000)) and (a, b) == explain.seat_permutation(feature, repeat, 42)
        seats = (a * np.arange(n, dtype=np.int64) + b) % n
        assert len(np.unique(seats)) == n
        seen.add(tuple(seats[:50].tolist()))
    assert n < 97 or len(seen) == 3


def test_traded_values_are_not_gathered_by_seat(spark):
    """A value is shuffled as (seat and trial, value) and meets its row there; lists by seat would be moved beside it."""
    from driftgauge.catalog.literal import _WrittenForest

    columns = [(F.col("id") * 7 % 50).cast("double").alias("l_quantity"), (F.col("id") * 900.0).alias("l_extendedprice")]
    df = spark.range(100).select(F.col("id").alias("key"), *columns, (F.col("id") % 2).cast("int").alias("label_binary"))
    found = explain.permutation_importance(_WrittenForest(), df, "key", 0.5, repeats=2)
    assert found.count() == 2 and "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def test_permutation_importance_of_a_plain_loop(spark):
    """A score that is one feature: trading its values costs what a plain loop says, trading the other costs nothing."""
    from pyspark.ml.functions import vector_to_array

    class First:
        features, medians = ("a", "b"), {"a": 0.0, "b": 0.0}

        def score_vectors(self, df, vector, column):
            return df.withColumn(column, vector_to_array(F.col(vector))[0])

    rng = np.random.default_rng(2)
    a, noise = rng.random(500), rng.random(500)
    y = ((a + 0.3 * noise) > 0.6).astype(int)
    rows = [(int(i), float(u), float(v), int(t)) for i, u, v, t in zip(rng.permutation(500), a, noise, y)]
    df = spark.createDataFrame(rows, "key long, a double, b double, label_binary int").repartition(5)
    got = {r["feature"]: r for r in explain.permutation_importance(First(), df, "key", 0.5, repeats=4, seed=3, seats=[F.col("key")]).collect()}
    by_key = sorted(rows)
    x, t = np.asarray([r[1] for r in by_key]), np.asarray([r[3] for r in by_key])

    def f1(p):
        tp = (p & (t == 1)).sum()
        return 2 * tp / (2 * tp + (p != (t == 1)).sum())

    losses = []
    for r in range(4):
        m, c = explain.seat_permutation(0, r, 3)
        new = np.empty(500)
        new[(m * np.arange(500) + c) % 500] = x
        losses.append(f1(x >= 0.5) - f1(new >= 0.5))
    assert got["a"]["permutation_importance_mean"] == pytest.approx(np.mean(losses)) and np.mean(losses) > 0.1
    assert got["a"]["permutation_importance_std"] == pytest.approx(np.std(losses))
    assert got["b"]["permutation_importance_mean"] == 0
