import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import guards, sampling, splits

START = dt.datetime(2017, 7, 1)


def series(spark, n=100, step=1):
    rows = [(START + dt.timedelta(minutes=i // step), i, "BENIGN" if i % 3 else "DoS Hulk") for i in range(n)]
    return spark.createDataFrame(rows, "Timestamp timestamp_ntz, `Feature A` long, Label string")


def test_timestamp_detection(spark):
    found = splits.detect_timestamp_column(series(spark, 10)).first()
    assert found["column"] == "Timestamp" and found["parsed"]
    none = splits.detect_timestamp_column(spark.createDataFrame([(1,)], "A int")).first()
    assert none["column"] is None and not none["parsed"]
    text = spark.createDataFrame([("2017-01-01",), ("junk",), (None,)], "`Start Time` string")
    row = splits.detect_timestamp_column(text).first()
    assert row["n_unparseable"] == 1 and row["parsed"]
    with pytest.raises(KeyError):
        splits.detect_timestamp_column(text, "absent")


def test_chronological_split(spark):
    split = splits.chronological_split(series(spark), "Timestamp")
    bounds = splits.split_bounds(split).first()
    assert (bounds["n_train"], bounds["n_test"]) == (80, 20) and bounds["train_end"] < bounds["test_start"]
    assert splits.check_time_leakage(split).first()["passed"]


@pytest.mark.parametrize("n, size, train", [(5, 0.5, 2), (7, 0.5, 4), (3, 0.99, 1), (3, 0.01, 2), (2, 0.5, 1)])
def test_split_size_rounding_and_clamping(spark, n, size, train):
    split = splits.chronological_split(series(spark, n), "Timestamp", size)
    assert (split.train.count(), split.test.count()) == (train, n - train)


def test_split_errors(spark):
    df = series(spark, 10)
    with pytest.raises(ValueError):
        splits.chronological_split(df, "Timestamp", 1.5)
    with pytest.raises(KeyError):
        splits.chronological_split(df, "absent")
    with pytest.raises(ValueError):
        splits.chronological_split(df.limit(0), "Timestamp")
    with pytest.raises(ValueError):
        splits.chronological_split(spark.createDataFrame([("not a date",)], "t string"), "t")


def test_shared_timestamps_are_found(spark):
    split = splits.chronological_split(series(spark, 100, step=7), "Timestamp", 0.2, "Feature A")
    check = splits.check_time_leakage(split).first()
    # Minute 11 holds rows 77..83: three of them train, four of them test.
    assert not check["passed"] and check["order_ok"] and check["n_overlapping_rows"] == 7
    swapped = splits.Split(split.test, split.train, "Timestamp")
    assert not splits.check_time_leakage(swapped).first()["order_ok"]


def test_identical_rows_across_the_cut_are_shared_out(spark):
    rows = [(START, "same")] * 700 + [(START - dt.timedelta(days=1), "early")] * 100
    df = spark.createDataFrame(rows, "t timestamp_ntz, v string")
    split = splits.chronological_split(df, "t", 0.5)
    counted = lambda d: dict(map(tuple, d.groupBy("v").count().collect()))
    assert counted(split.train) == {"early": 100, "same": 300}
    assert counted(split.test) == {"same": 400}


def days(spark):
    names = ["monday"] * 4 + ["Wednesday "] * 3 + ["friday"] * 3 + ["sunday"] * 2
    return spark.createDataFrame([(i, d) for i, d in enumerate(names)], "a long, capture_day string")


def test_day_split(spark):
    split = splits.day_split(days(spark), ["Friday"])
    assert split.train_days == ("monday", "wednesday") and split.test_days == ("friday",)
    assert (split.train.count(), split.test.count()) == (7, 3)
    assert splits.check_day_leakage(split).first()["passed"]


@pytest.mark.parametrize(
    "test, train", [(["notaday"], None), (["friday"], ["friday"]), (["monday"], ["friday"]), (["tuesday"], ["monday"]),
                    (["friday"], ["holiday"]), ([], None)]
)
def test_day_split_errors(spark, test, train):
    with pytest.raises(ValueError):
        splits.day_split(days(spark), test, train)


def test_day_leakage_is_judged_on_rows(spark):
    df = days(spark)
    bad = splits.Split(df, df.where("a > 6"), "capture_day")
    row = splits.check_day_leakage(bad).first()
    assert not row["passed"] and row["n_shared_days"] == 1
    with pytest.raises(splits.LeakageError):
        splits.require(splits.check_day_leakage(bad), "days")


def test_validation_split(spark):
    rows = [(d, i) for d in ("monday", "tuesday", "wednesday", "thursday") for i in range(20)]
    df = spark.createDataFrame(rows, "capture_day string, v int")
    split = splits.validation_split(df)
    assert (split.train.count(), split.test.count()) == (60, 20)
    with pytest.raises(KeyError):
        splits.validation_split(df.drop("capture_day"))


def test_split_choice_and_feature_list(spark):
    timed = series(spark).withColumn("capture_day", F.lit("monday"))
    _, features, method = splits.split_in_time(timed, ["Feature A", "Timestamp", "capture_day"])
    assert method == "timestamp" and features == ["Feature A"]
    guards.assert_no_split_key(features, "Timestamp", "capture_day")
    with pytest.raises(AssertionError):
        guards.assert_no_split_key(["Timestamp"], "Timestamp")
    with pytest.raises(ValueError):
        splits.split_in_time(spark.createDataFrame([(1,)], "x int"), ["x"])


def test_benign_heavy_sample(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 5 == 0).cast("int").alias("label_binary"),
        F.when(F.col("id") % 10 != 3, F.col("id").cast("double")).alias("f"),
    )
    sample = sampling.benign_heavy_sample(df, ["f"], 100, row_key="id")
    assert (sample.n_benign, sample.n_attack) == (90, 10) and sample.table.count() == 100
    assert sample.table.where("f IS NULL").count() == 0
    ids = lambda s: sorted(r["id"] for r in s.table.collect())
    assert ids(sample) == ids(sampling.benign_heavy_sample(df.repartition(7), ["f"], 100, row_key="id"))
    assert ids(sample) != ids(sampling.benign_heavy_sample(df, ["f"], 100, seed=1, row_key="id"))
    capped = sampling.benign_heavy_sample(df, ["f"], 10_000, row_key="id")
    assert (capped.n_benign, capped.n_attack) == (240, 30)


def test_samples_of_identical_rows_have_exact_size(spark):
    df = spark.createDataFrame([(0, 1.0)] * 400 + [(1, 2.0)] * 100, "label_binary int, f double")
    sample = sampling.take_by_hash(df, "label_binary", {0: 123, 1: 100})
    assert dict(map(tuple, sample.groupBy("label_binary").count().collect())) == {0: 123, 1: 100}
    balanced = sampling.balanced_sample(df, "label_binary", 350)
    assert dict(map(tuple, balanced.groupBy("label_binary").count().collect())) == {0: 250, 1: 100}


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 40, 2)]) for i in range(100)], "id int, c string")
    size = lambda n: dict(map(tuple, sampling.balanced_sample(df, "c", n, row_key="id").groupBy("c").count().collect()))
    assert size(31) == {"a": 11, "b": 10, "c": 10}
    filled = size(75)
    assert filled["c"] == 20 and sum(filled.values()) == 75
    assert sum(size(1000).values()) == 100 and size(0) == {}


def test_capped_sample(spark):
    pdf = pd.DataFrame({"g": ["x"] * 80 + ["y"] * 20, "id": range(100), "f": [float(i) for i in range(100)]})
    df = spark.createDataFrame(pdf).withColumn("h", F.when(F.col("id") % 2 == 0, F.col("f")))
    rows = sampling.capped_sample(df, ["f", "h"], 25, "g", row_key="id").groupBy("g", "feature").count().collect()
    assert {(r["g"], r["feature"]): r["count"] for r in rows} == {("x", "f"): 25, ("x", "h"): 25, ("y", "f"): 20, ("y", "h"): 10}


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 0), (float("inf"), None)], "f double, label_binary int")
    with pytest.raises(ValueError):
        guards.assert_finite(df, ["f"])
    guards.assert_finite(df.limit(1), ["f"])
    with pytest.raises(ValueError):
        guards.assert_labelled(df)
    with pytest.raises(KeyError):
        guards.assert_features_present(["f", "g"], train=df)
    with pytest.raises(AssertionError):
        guards.assert_feature_alignment(["a", "b"], ["b", "a"])
    assert not guards.assert_feature_alignment(["a"], None)


def test_split_order_does_not_depend_on_the_session_time_zone(spark):
    gap = dt.datetime(2021, 3, 14, 1, 30)
    rows = [(gap + dt.timedelta(minutes=15 * i), i) for i in range(8)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        split = splits.chronological_split(df, "t", 0.5)
        assert sorted(r["i"] for r in split.train.collect()) == [0, 1, 2, 3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_balanced_sample_with_unlabelled_rows(spark):
    from driftgauge.operators.sampling import balanced_sample

    df = spark.range(150).selectExpr("id", "case when id < 30 then 'a' when id < 50 then 'b' end as label")
    assert balanced_sample(df, "label", 60, row_key="id").count() == 60
    assert balanced_sample(df, "label", 200, row_key="id").count() == 150
    few = balanced_sample(df, "label", 9, row_key="id").groupBy("label").count().collect()
    assert sum(r["count"] for r in few) == 9


@pytest.mark.parametrize("moments", [list(range(10)), [0, 1, 1, 1, 1, 1, 2, 3], [5] * 9, [0, 0, 0, 0, 9]])
def test_leak_check_of_a_cut_is_that_of_any_split(spark, moments):
    """What one pass around the edge says is what grouping the shared range says."""
    import dataclasses

    rows = [(i, f"2024-01-01 00:00:{m:02d}") for i, m in enumerate(moments)]
    df = spark.createDataFrame(rows, "id long, ts string")
    split = splits.chronological_split(df, "ts", 0.5, row_key="id")
    assert split.edge is not None
    plain = dataclasses.replace(split, edge=None)
    assert splits.check_time_leakage(split).collect() == splits.check_time_leakage(plain).collect()
    wrong = dataclasses.replace(split, edge=split.edge - 1)  # an edge that isn't one: rows lie beyond it
    assert splits.check_time_leakage(wrong).collect() == splits.check_time_leakage(plain).collect()
    swapped = dataclasses.replace(split, train=split.test, test=split.train)
    assert splits.check_time_leakage(swapped).collect() == splits.check_time_leakage(dataclasses.replace(swapped, edge=None)).collect()


def test_leak_check_of_a_cut_reads_the_sides_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(20)], "id long, ts string")
    split = splits.chronological_split(df, "ts", 0.3)
    monkeypatch.setattr(splits, "split_bounds", lambda s: pytest.fail("a second pass"))
    assert splits.check_time_leakage(split).first()["passed"]
