"""Drift, rank tests and importance tables on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.catalog.registry import (
    FEATURES, FLOWS, SCORES, THRESHOLDS, flows, long_features_sql, query, rounded, test_side, train_side,
)
from driftgauge.operators import drift, explain
from driftgauge.session import settle

GROUPS = ["A", "N", "R"]

MOMENTS = f"""tl AS ({long_features_sql('train', FEATURES)}), gl AS ({long_features_sql('test', FEATURES, 'l_returnflag')}),
  tm AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n, median(value) AS med FROM tl GROUP BY 1),
  gm AS (SELECT l_returnflag AS grp, feature, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM gl GROUP BY 1, 2),
  imp AS (SELECT feature, std / mean AS importance FROM tm),
  shifts AS (SELECT grp, feature, tm.mean AS train_mean, gm.mean AS group_mean,
     (gm.mean - tm.mean) / abs(nullif(tm.mean, 0)) * 100 AS shift_pct FROM gm JOIN tm USING (feature))"""


def _sides(spark, sf_dir):
    df = flows(spark, sf_dir)
    return train_side(df), test_side(df)


def _importances(spark, sf_dir):
    """Stand-in importances from the data: each feature's relative spread in training."""
    moments = drift.feature_moments(_sides(spark, sf_dir)[0], FEATURES)
    return settle(moments.select("feature", (F.col("std") / F.col("mean")).alias("importance")), "importances")


def _shifts(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return drift.shift_long(train, test, "l_returnflag", FEATURES)


@query(
    "group_statistics",
    rounded(
        f"""WITH {FLOWS}, {MOMENTS} SELECT l_returnflag, feature, avg(value) AS mean, stddev_samp(value) AS std,
          median(value) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM gl GROUP BY 1, 2""",
        "mean", "std", "median", "q25", "q75",
    ),
)
def group_statistics(spark, sf_dir):
    return drift.group_statistics(_sides(spark, sf_dir)[1], FEATURES, ["l_returnflag"])


@query(
    "class_feature_shift",
    rounded(
        f"WITH {FLOWS}, {MOMENTS} SELECT feature, max(train_mean) AS train_mean, "
        + ", ".join(
            f"max(group_mean) FILTER (WHERE grp = '{g}') AS {g}_mean, max(shift_pct) FILTER (WHERE grp = '{g}') AS {g}_shift_pct"
            for g in GROUPS
        )
        + ", max(importance) AS importance FROM shifts JOIN imp USING (feature) GROUP BY 1",
        "train_mean", "importance", *[f"{g}_{c}" for g in GROUPS for c in ("mean", "shift_pct")],
    ),
)
def class_feature_shift(spark, sf_dir):
    return drift.shift_table(_shifts(spark, sf_dir), _importances(spark, sf_dir), GROUPS)


@query(
    "zero_mean_shift",
    rounded(
        """WITH t AS (SELECT 'balance' AS feature, avg(CASE WHEN l_linenumber > 0 THEN 0.0 END) AS m FROM lineitem WHERE l_linestatus = 'F')
        SELECT l_returnflag AS "group", 'balance' AS feature, max(m) AS train_mean, avg(l_tax) AS group_mean, NULL::DOUBLE AS shift_pct
        FROM lineitem, t WHERE l_linestatus = 'O' GROUP BY 1""",
        "train_mean", "group_mean",
    ),
)
def zero_mean_shift(spark, sf_dir):
    df = flows(spark, sf_dir)
    train = df.where("l_linestatus = 'F'").withColumn("balance", F.when(F.col("l_linenumber") > 0, 0.0))
    test = test_side(df).withColumn("balance", F.col("l_tax"))
    return drift.shift_long(train, test, "l_returnflag", ["balance"])


@query(
    "top_features",
    rounded(f"WITH {FLOWS}, {MOMENTS} SELECT feature, importance FROM imp ORDER BY importance DESC, feature LIMIT 3", "importance"),
)
def top_features(spark, sf_dir):
    return drift.top_features(_importances(spark, sf_dir), 3)


@query(
    "top_shifted_features",
    rounded(
        f"""WITH {FLOWS}, {MOMENTS} SELECT * FROM (SELECT grp AS class, feature, importance, shift_pct, abs(shift_pct) AS abs_shift_pct,
            row_number() OVER (PARTITION BY grp ORDER BY abs(shift_pct) DESC NULLS LAST, feature) AS rank FROM shifts JOIN imp USING (feature))
            WHERE rank <= 2""",
        "importance", "shift_pct", "abs_shift_pct",
    ),
)
def top_shifted_features(spark, sf_dir):
    return drift.top_shifted(_shifts(spark, sf_dir), _importances(spark, sf_dir), 2)


@query(
    "drift_report",
    rounded(
        f"""WITH {FLOWS}, {MOMENTS}, te AS (SELECT feature, avg(value) AS mean, median(value) AS med FROM gl GROUP BY 1)
        SELECT feature, tm.mean AS train_mean, tm.med AS train_median, te.mean AS test_mean, te.med AS test_median,
          (te.mean - tm.mean) / abs(nullif(tm.mean, 0)) * 100 AS mean_shift_pct,
          (te.med - tm.med) / abs(nullif(tm.med, 0)) * 100 AS median_shift_pct, importance
        FROM tm JOIN te USING (feature) JOIN imp USING (feature)""",
        "train_mean", "train_median", "test_mean", "test_median", "mean_shift_pct", "median_shift_pct", "importance",
    ),
)
def drift_report(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return drift.drift_report(train, test, FEATURES, _importances(spark, sf_dir))


@query(
    "threshold_crossing",
    rounded(
        f"""WITH {FLOWS} SELECT l_returnflag AS attack_class, count(*) AS samples, count(*) FILTER (WHERE hybrid_score >= 0.5) AS above_threshold,
          avg(hybrid_score) AS mean_score, max(hybrid_score) AS max_score, median(hybrid_score) AS median_score,
          count(*) FILTER (WHERE hybrid_score >= 0.5) / count(*)::DOUBLE AS detection_rate FROM test GROUP BY 1""",
        "mean_score", "max_score", "median_score", "detection_rate",
    ),
)
def threshold_crossing(spark, sf_dir):
    return drift.threshold_crossing(_sides(spark, sf_dir)[1], "l_returnflag", "hybrid_score", 0.5)


_RATES = ", ".join(
    f"avg(CAST({c} >= {THRESHOLDS[d]}e0 AS INTEGER)) AS {d}_detection_rate" for d, c in SCORES.items()
)
_RATE_NAMES = [f"{d}_detection_rate" for d in SCORES]
VERSUS = f"""rates AS (SELECT l_returnflag AS class, count(*) AS samples, {_RATES} FROM test GROUP BY 1),
  sizes AS (SELECT grp AS class, avg(abs(shift_pct)) AS mean_abs_feature_shift_pct FROM shifts GROUP BY 1)"""


@query(
    "detection_vs_shift",
    rounded(
        f"WITH {FLOWS}, {MOMENTS}, {VERSUS} SELECT * FROM rates JOIN sizes USING (class)",
        "mean_abs_feature_shift_pct", *_RATE_NAMES,
    ),
)
def detection_vs_shift(spark, sf_dir):
    rates = drift.detection_rates(_sides(spark, sf_dir)[1], "l_returnflag", SCORES, THRESHOLDS)
    return drift.detection_vs_shift(_shifts(spark, sf_dir), rates)


@query(
    "unseen_attack_summary",
    rounded(
        f"WITH {FLOWS}, {MOMENTS}, {VERSUS} SELECT * FROM rates JOIN sizes USING (class) WHERE class = 'A'",
        "mean_abs_feature_shift_pct", *_RATE_NAMES,
    ),
)
def unseen_attack_summary(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    unseen = test.where("l_returnflag = 'A'")
    rates = drift.detection_rates(unseen, "l_returnflag", SCORES, THRESHOLDS)
    shifts = drift.shift_long(train, unseen, "l_returnflag", FEATURES)
    return drift.unseen_summary(shifts, rates, "random_forest_detection_rate")


TESTS = f"""both_sides AS (SELECT g.grp, v.feature, v.value, v.side FROM (SELECT DISTINCT l_returnflag AS grp FROM test) g
     JOIN (SELECT feature, value, 'train' AS side FROM tl UNION ALL SELECT feature, value, l_returnflag FROM gl) v
     ON v.side = 'train' OR v.side = g.grp),
  ranks AS (SELECT *, count(*) OVER (PARTITION BY grp, feature, value) AS t,
     rank() OVER (PARTITION BY grp, feature ORDER BY value) AS first_rank FROM both_sides),
  sums AS (SELECT grp, feature, count(*) FILTER (WHERE side = 'train')::DOUBLE AS n1, count(*) FILTER (WHERE side <> 'train')::DOUBLE AS n2,
     sum(first_rank + (t - 1) / 2.0e0) FILTER (WHERE side = 'train') AS r1, sum(t::DOUBLE * t - 1) AS tie FROM ranks GROUP BY 1, 2),
  us AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM sums),
  tested AS (SELECT feature, grp AS "group", n1::BIGINT AS n_train, n2::BIGINT AS n_group, u AS mannwhitney_u,
     (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5e0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS z,
     1 - 2 * u / (n1 * n2) AS rank_biserial_effect_size,
     (gm.mean - tm.mean) / sqrt(((n1 - 1) * tm.std ** 2 + (n2 - 1) * gm.std ** 2) / (n1 + n2 - 2)) AS cohens_d,
     'normal_approximation' AS method FROM us JOIN gm USING (grp, feature) JOIN tm USING (feature))"""


@query(
    "distribution_shift_tests",
    rounded(
        f"WITH {FLOWS}, {MOMENTS}, {TESTS} SELECT * FROM tested",
        "mannwhitney_u", "z", "rank_biserial_effect_size", "cohens_d",
    ),
)
def distribution_shift_tests(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return drift.shift_tests(train, test, "l_returnflag", FEATURES, GROUPS).drop("p_value")


# Two-sided p < 0.01 is |z| beyond the normal 0.995 quantile, 2.5758293035489004.
@query(
    "significant_shifts",
    f"""WITH {FLOWS}, {MOMENTS}, {TESTS} SELECT count(*) FILTER (WHERE z > 2.5758293035489004e0) AS n_significant,
        count(*) AS n_tests FROM tested""",
)
def significant_shifts(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return drift.significant_shifts(drift.shift_tests(train, test, "l_returnflag", FEATURES, GROUPS))


@query(
    "importance_comparison",
    rounded(
        f"""WITH {FLOWS}, {MOMENTS},
        s AS (SELECT feature, std / mean AS mean_abs_shap FROM tm WHERE feature <> 'l_tax'),
        b AS (SELECT feature, mean / 1000 AS rf_builtin_importance FROM tm WHERE feature <> 'l_quantity'),
        p AS (SELECT feature, -std / 1000 AS permutation_importance_mean, mean / 1000 AS permutation_importance_std FROM tm WHERE feature <> 'l_discount'),
        j AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY mean_abs_shap DESC) AS shap_rank FROM s)
              FULL JOIN (SELECT *, rank() OVER (ORDER BY rf_builtin_importance DESC) AS builtin_rank FROM b) USING (feature)
              FULL JOIN (SELECT *, rank() OVER (ORDER BY permutation_importance_mean DESC) AS permutation_rank FROM p) USING (feature))
        SELECT *, abs(coalesce(mean_abs_shap, 0)) / sum(abs(coalesce(mean_abs_shap, 0))) OVER () AS shap_normalized,
          abs(coalesce(rf_builtin_importance, 0)) / sum(abs(coalesce(rf_builtin_importance, 0))) OVER () AS builtin_normalized,
          abs(coalesce(permutation_importance_mean, 0)) / sum(abs(coalesce(permutation_importance_mean, 0))) OVER () AS permutation_normalized
        FROM j""",
        "mean_abs_shap", "rf_builtin_importance", "permutation_importance_mean", "permutation_importance_std",
        "shap_normalized", "builtin_normalized", "permutation_normalized",
    ),
)
def importance_comparison(spark, sf_dir):
    m = settle(drift.feature_moments(_sides(spark, sf_dir)[0], FEATURES), "moments")
    mean, std = F.col("mean"), F.col("std")
    return explain.importance_comparison(
        m.where("feature <> 'l_tax'").select("feature", (std / mean).alias("mean_abs_shap")),
        m.where("feature <> 'l_quantity'").select("feature", (mean / 1000).alias("rf_builtin_importance")),
        m.where("feature <> 'l_discount'").select(
            "feature", (-std / 1000).alias("permutation_importance_mean"), (mean / 1000).alias("permutation_importance_std")
        ),
    )
