import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import drift, hybrid, metrics, populations


def scores(n=200, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.clip(0.6 * y + rng.normal(0, 0.2, n) + 0.2, 0, 1)
    return pd.DataFrame({"y": y, "s": s})


def confusion(y, s, t):
    p = s >= t
    return {"tn": ((y == 0) & ~p).sum(), "fp": ((y == 0) & p).sum(), "fn": ((y == 1) & ~p).sum(), "tp": ((y == 1) & p).sum()}


def auc_and_ap(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    ap = 0.0
    for v in np.unique(s):
        ap += ((s == v) & (y == 1)).sum() / len(pos) * ((s >= v) & (y == 1)).sum() / (s >= v).sum()
    return auc, ap


def test_threshold_grid_matches_counting(spark):
    pdf = scores()
    grid = metrics.threshold_grid(spark.createDataFrame(pdf), "y", {"d": "s"}).toPandas()
    assert len(grid) == len(metrics.THRESHOLD_GRID)
    for row in grid.itertuples():
        expected = confusion(pdf.y, pdf.s, row.threshold)
        assert {k: getattr(row, k) for k in expected} == expected
    best = metrics.select_threshold(metrics.threshold_grid(spark.createDataFrame(pdf), "y", {"d": "s"})).first()
    assert best["f1"] == pytest.approx(grid["f1"].max())
    assert best["threshold"] == grid.loc[grid.sort_values("grid_pos")["f1"].idxmax(), "threshold"] or best["f1"] == grid["f1"].max()


def test_first_threshold_wins_ties_whatever_its_value(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, s double")
    grid = metrics.threshold_grid(df, "y", {"d": "s"}, (0.5, 0.2, 0.3))
    assert metrics.select_threshold(grid).first()["threshold"] == 0.5


def test_detectors_get_thresholds_on_their_own_scale(spark):
    rows = [(y, 0.02 + 0.2 * y, 0.3 + 0.3 * y) for y in (0, 1)] * 4
    df = spark.createDataFrame(rows, "y int, rf double, other double")
    picked = metrics.select_threshold(metrics.threshold_grid(df, "y", {"rf": "rf", "other": "other"}))
    assert {r["detector"]: r["threshold"] for r in picked.collect()} == {"rf": 0.05, "other": 0.4}


def test_undefined_rates(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "y int, s double")
    row = metrics.threshold_metrics(df, "y", "s", 0.5).first()
    assert (row["precision"], row["recall"], row["f1"], row["fpr"], row["fnr"]) == (0.0, 0.0, 0.0, None, 1.0)


def test_ranking_quality_matches_pair_counting(spark):
    pdf = scores(300, 5).assign(s=lambda d: d.s.round(2))
    row = metrics.compare_detectors(spark.createDataFrame(pdf), "y", {"d": "s"}, {"d": 0.5}).first()
    auc, ap = auc_and_ap(pdf.y.to_numpy(), pdf.s.to_numpy())
    assert row["roc_auc"] == pytest.approx(auc) and row["pr_auc"] == pytest.approx(ap)
    assert row["total_samples"] == 300 and row["attack_detection_rate"] == row["recall"]


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "y int, s double")
    row = metrics.compare_detectors(df, "y", {"d": "s"}, {"d": 0.5}).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["fp"] == 1


def test_curves_end_where_they_must(spark):
    pdf = scores(100, 2)
    points = metrics.curve_points(metrics.score_cells(spark.createDataFrame(pdf), "y", {"d": "s"})).toPandas()
    points = points.sort_values("threshold", ascending=False)
    first, last = points.iloc[0], points.iloc[-1]
    assert math.isinf(first.threshold) and (first.tpr, first.fpr, first.precision, first.recall) == (0, 0, 1, 0)
    assert (last.tpr, last.fpr) == (1, 1) and points["tp"].is_monotonic_increasing


def test_per_class_results(spark):
    rows = [("DDoS", 0.9), ("DDoS", 0.2), ("Benign", 0.1), ("Benign", 0.6)]
    df = spark.createDataFrame(rows, "c string, s double")
    got = {r["class"]: r for r in metrics.per_class_results(df, "c", {"d": "s"}, {"d": 0.5}).collect()}
    assert got["DDoS"]["predicted_attack"] == 1 and got["DDoS"]["pct_missed"] == 50.0
    assert got["Benign"]["median_score"] == pytest.approx(0.35) and got["Benign"]["max_score"] == 0.6


def test_histogram_counts_every_row_and_integrates_to_one(spark):
    pdf = scores(500, 9)
    hist = metrics.score_histogram(spark.createDataFrame(pdf), {"d": "s"}, ["y"]).toPandas()
    assert len(hist) == 80 and hist["rows"].sum() == 500
    for y, part in hist.groupby("y"):
        counts, _ = np.histogram(pdf.s[pdf.y == y], bins=40)
        assert list(part.sort_values("bin")["rows"]) == list(counts)
        assert (part.density * (part.right_edge - part.left_edge)).sum() == pytest.approx(1)


def test_hybrid(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.5, 0.5)], "rf_score double, anomaly_score double")
    got = [r["hybrid_score"] for r in hybrid.add_hybrid(df).collect()]
    assert got == pytest.approx([0.7, 0.5])
    even = hybrid.add_hybrid(df, hybrid.HybridConfig(2.0, 2.0)).first()
    assert even["hybrid_score"] == 0.5
    with pytest.raises(ValueError):
        hybrid.HybridConfig(0.0, 0.0)


TRAIN = ["Benign"] * 5 + ["DoS Hulk"] * 2 + ["FTP-Patator"]
TEST = ["Benign"] * 4 + ["DoS Hulk"] + ["DDoS"] * 2 + ["PortScan"] * 2


def classes(spark, values):
    return spark.createDataFrame([(v,) for v in values], "label_multiclass string")


def test_inventory_and_unseen(spark):
    train, test = classes(spark, TRAIN + [None]), classes(spark, TEST + [None])
    roles = {r["class"]: r["role"] for r in populations.class_inventory(train, test, "label_multiclass").collect()}
    assert roles == {
        "Benign": "benign", "DoS Hulk": "seen_attack", "FTP-Patator": "seen_attack",
        "DDoS": "unseen_attack", "PortScan": "unseen_attack",
    }
    unseen = populations.collect_unseen(train, test, "label_multiclass")
    assert unseen == ["DDoS", "PortScan"]
    populations.assert_no_unseen_leakage(train, unseen, "label_multiclass")
    with pytest.raises(AssertionError):
        populations.assert_no_unseen_leakage(train, ["DoS Hulk"], "label_multiclass")
    with pytest.raises(KeyError):
        populations.class_inventory(train, test, "absent")
    assert populations.population(test, ["DDoS"], "label_multiclass").count() == 6


def test_restrict_unseen_falls_back_to_what_was_measured(spark):
    measured = classes(spark, ["A", "B"]).toDF("class")
    some = populations.restrict_unseen(measured, ["B", "C"]).collect()
    assert [(r["class"], r["all_expected_found"]) for r in some] == [("B", False)]
    none = populations.restrict_unseen(measured, ["C"]).collect()
    assert [r["class"] for r in none] == ["A", "B"]


def test_populations_equal_separate_evaluations(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"c": rng.choice(["Benign", "seen", "x", "y"], 400), "s": rng.random(400).round(2)})
    pdf["label"] = (pdf.c != "Benign").astype(int)
    df = spark.createDataFrame(pdf)
    got = populations.compare_populations(df, "label", "c", {"d": "s"}, {"d": 0.5}, ["x", "y"]).toPandas()
    members = {
        "all_test": ["Benign", "seen", "x", "y"], "unseen_attacks_vs_benign": ["Benign", "x", "y"],
        "unseen__x": ["Benign", "x"], "unseen__y": ["Benign", "y"],
    }
    assert set(got.population) == set(members)
    for row in got.itertuples():
        part = pdf[pdf.c.isin(members[row.population])]
        auc, ap = auc_and_ap(part.label.to_numpy(), part.s.to_numpy())
        assert row.total_samples == len(part)
        assert row.roc_auc == pytest.approx(auc) and row.pr_auc == pytest.approx(ap)
        expected = confusion(part.label, part.s, 0.5)
        assert {k: getattr(row, k) for k in expected} == expected


def brute_u(a, b):
    return sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)


def test_shift_tests_match_pair_counting(spark):
    rng = np.random.default_rng(4)
    train = pd.DataFrame({"g": "train", "f": rng.integers(0, 9, 300).astype(float), "h": rng.normal(size=300)})
    groups = pd.DataFrame({"g": ["p"] * 120 + ["q"] * 80, "f": rng.integers(2, 12, 200).astype(float), "h": rng.normal(5, 1, 200)})
    groups.loc[3, "f"] = np.nan
    got = drift.shift_tests(spark.createDataFrame(train), spark.createDataFrame(groups), "g", ["f", "h"], ["p", "q"])
    got = got.toPandas()
    assert len(got) == 4
    for row in got.itertuples():
        a, b = train[row.feature], groups.loc[groups.g == row.group, row.feature].dropna()
        n1, n2 = len(a), len(b)
        u = brute_u(a.to_numpy(), b.to_numpy())
        ties = pd.concat([a, b]).value_counts()
        n = n1 + n2
        spread = math.sqrt(n1 * n2 / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
        assert (row.n_train, row.n_group, row.mannwhitney_u) == (n1, n2, u)
        assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)
        assert row.rank_biserial_effect_size == pytest.approx(1 - 2 * u / (n1 * n2))
        pooled = math.sqrt(((n1 - 1) * a.var() + (n2 - 1) * b.var()) / (n - 2))
        assert row.cohens_d == pytest.approx((b.mean() - a.mean()) / pooled)
    assert (got[got.feature == "h"].p_value < 0.01).all()


def test_too_few_values_are_not_tested(spark):
    train = spark.createDataFrame([("t", 1.0), ("t", 2.0)], "g string, f double")
    one = spark.createDataFrame([("p", 1.0)], "g string, f double")
    assert drift.shift_tests(train, one, "g", ["f"], ["p"]).count() == 0


def test_identical_constant_columns(spark):
    df = spark.createDataFrame([("p", 1.0)] * 5, "g string, f double")
    row = drift.shift_tests(df, df, "g", ["f"], ["p"]).first()
    assert row["mannwhitney_u"] == 12.5 and row["cohens_d"] is None and row["p_value"] == 1.0


def test_shift_table_and_ranking(spark):
    train = spark.createDataFrame([(100.0, 0.0, 10.0)], "a double, zero double, c double")
    test = spark.createDataFrame([("x", 150.0, 3.0, 2.0), ("y", 90.0, 1.0, 10.5)], "g string, a double, zero double, c double")
    importances = spark.createDataFrame([("a", 0.5), ("c", 0.3), ("zero", 0.2)], "feature string, importance double")
    shifts = drift.shift_long(train, test, "g", ["a", "zero", "c"])
    table = {r["feature"]: r for r in drift.shift_table(shifts, importances, ["x", "y"]).collect()}
    assert table["a"]["x_shift_pct"] == 50.0 and table["zero"]["x_shift_pct"] is None
    top = drift.top_shifted(shifts, importances, 2).where("class = 'x'").orderBy("rank").collect()
    assert [r["feature"] for r in top] == ["c", "a"]


def test_threshold_crossing(spark):
    rows = [("DDoS", s) for s in (0.9, 0.9, 0.1, 0.2)] + [("Bot", s) for s in (0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "c string, s double")
    got = {r["attack_class"]: r for r in drift.threshold_crossing(df, "c", "s", 0.5).collect()}
    assert got["DDoS"]["above_threshold"] == 2 and got["DDoS"]["detection_rate"] == 0.5
    assert got["Bot"]["above_threshold"] == 0 and got["Bot"]["median_score"] == 0.2


def test_group_statistics(spark):
    df = spark.createDataFrame([(float(i), 10.0 * i) for i in range(1, 5)], "f1 double, f2 double")
    rows = {r["feature"]: r for r in drift.group_statistics(df, ["f1", "f2"]).collect()}
    assert rows["f1"]["median"] == 2.5 and rows["f1"]["q25"] == 1.75 and rows["f2"]["mean"] == 25.0
    assert rows["f1"]["std"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))
    assert drift.group_statistics(df.limit(1), ["f1"]).first()["std"] is None
    assert drift.drift_report(df, df, ["f1"], spark.createDataFrame([("f1", 1.0)], "feature string, importance double")).first()["mean_shift_pct"] == 0.0
    assert df.where(F.col("f1") > 9).count() == 0


@pytest.mark.parametrize("n1,n2", [(2, 3), (6, 5), (8, 4), (1, 7)])
def test_exact_tail_is_enumeration(n1, n2):
    places = range(n1 + n2)
    found = [sum(j < i for i in mine for j in places if j not in mine) for mine in combinations(places, n1)]
    for u in range(n1 * n2 + 1):
        assert drift.exact_tail(n1, n2, u) == pytest.approx(sum(x <= u for x in found) / len(found), abs=1e-12)


def test_small_samples_without_ties_are_tested_exactly(spark):
    rng = np.random.default_rng(6)
    train = pd.DataFrame({"g": "train", "f": rng.normal(size=30), "h": rng.integers(0, 3, 30).astype(float)})
    groups = pd.DataFrame({"g": ["p"] * 5 + ["q"] * 9, "f": rng.normal(1, 1, 14), "h": rng.normal(size=14)})
    got = drift.shift_tests(spark.createDataFrame(train), spark.createDataFrame(groups), "g", ["f", "h"], ["p", "q"]).toPandas()
    method = {(r.feature, r.group): r.method for r in got.itertuples()}
    assert method == {("f", "p"): "exact", ("f", "q"): "normal_approximation", ("h", "p"): "normal_approximation", ("h", "q"): "normal_approximation"}
    row = got[(got.feature == "f") & (got.group == "p")].iloc[0]
    u = min(row.mannwhitney_u, 150 - row.mannwhitney_u)
    assert row.p_value == pytest.approx(min(1.0, 2 * drift.exact_tail(30, 5, int(u))))
    assert list(got.columns) == list(drift.shift_tests(spark.createDataFrame(train), spark.createDataFrame(groups), "g", ["h"], ["q"]).columns)
