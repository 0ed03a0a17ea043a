import math

import pytest
from pyspark.sql import functions as F

from driftgauge.operators import clean, labels, mapping, quality
from driftgauge.session import literal_table


def test_schema_report(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")], "A int, A2 int, `Unnamed: 0` int, Label string")
    row = quality.schema_report(df, header=["A", "A", "Unnamed: 0", "Label"]).first()
    assert row["duplicate_columns"] == ["A"] and row["unnamed_columns"] == ["Unnamed: 0"]
    assert row["detected_label_column"] == "Label" and row["n_rows"] == 1 and len(row["notes"]) == 2


def test_missing_report(spark):
    rows = [(1.0, "a"), (math.nan, None), (math.inf, "b"), (-math.inf, "c"), (5.0, "d")]
    df = spark.createDataFrame(rows, "num double, cat string").withColumn("gone", F.lit(None).cast("int"))
    got = {r["column"]: (r["n_missing"], r["n_infinite"], r["all_missing"]) for r in quality.missing_report(df).collect()}
    assert got == {"num": (1, 2, False), "cat": (1, 0, False), "gone": (5, 0, True)}


def test_schema_drift(spark):
    row = quality.schema_drift(spark, [("f1", ["A", "Label"], 1), ("f2", ["A", "B", "Label"], 4)]).first()
    assert row["drift"] and row["n_rows"] == 5 and row["columns"] == ["A", "Label"]
    assert not quality.schema_drift(spark, [("f1", ["A"], 1), ("f2", ["A"], 1)]).first()["drift"]
    with pytest.raises(ValueError):
        quality.schema_drift(spark, [])


def test_near_constant(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") == 7, 2).otherwise(1).alias("A"),
        F.col("id").alias("B"),
        F.when(F.col("id") == 7, "x").alias("mostly_null"),
        F.when(F.col("id") < 600, "top").otherwise(F.col("id").cast("string")).alias("C"),
        F.lit(1).alias("Flow ID"),
        F.lit("y").alias("Attack Category"),
    )
    found = {r["feature"]: r["top_share"] for r in quality.near_constant(df).collect()}
    assert found == {"A": 0.999, "mostly_null": 0.999}
    low = {r["feature"]: r["top_share"] for r in quality.near_constant(df, 0.6).collect()}
    assert low == {"A": 0.999, "mostly_null": 0.999, "C": 0.6}
    counted = {r["feature"] for r in quality.near_constant(df, 0.3).collect()}
    assert counted == {"A", "mostly_null", "C"}
    with pytest.raises(ValueError):
        quality.near_constant(df, 1.5)


def test_duplicate_columns_compare_every_row(spark):
    df = spark.range(500).select(
        F.col("id").alias("a"), F.col("id").alias("a2"), F.col("id").cast("double").alias("as_double"),
        (F.lit(499) - F.col("id")).alias("same_values_other_order"),
        F.when(F.col("id") > 3, F.col("id")).alias("n"), F.when(F.col("id") > 3, F.col("id")).alias("n2"),
    )
    got = {(r["column"], r["duplicate_of"]) for r in quality.duplicate_columns(df).collect()}
    assert got == {("a2", "a"), ("n2", "n")}


def test_select_features(spark):
    df = spark.createDataFrame(
        [("B", "f1", 1, 1, 5), ("B", "f2", 2, 2, 5), ("A", "f3", 3, 3, 5), ("A", "f4", 4, 4, 5)],
        "Label string, `Flow ID` string, `Feature A` long, `Feature A Copy` long, `Constant Feature` long",
    )
    chosen = quality.select_features(df, ["Label", "Flow ID", "absent"])
    assert chosen.features == ["Feature A"]
    assert chosen.table.columns == ["Label", "Flow ID", "Feature A"]
    operators = [r["operator"] for r in chosen.log.orderBy("step").collect()]
    assert operators == ["drop_duplicate", "drop_near_constant", "exclude_absent", "features"]


def test_normalize_labels(spark):
    df = spark.createDataFrame([(" BENIGN",), ("BENIGN",), ("DoS Hulk ",), ("PortScan",), (None,), ("",)], "Label string")
    rows = labels.normalize_labels(df, "Label").collect()
    assert [r["Label"] for r in rows] == ["Benign", "Benign", "DoS Hulk", "PortScan", "NaN", ""]
    assert [r["label_binary"] for r in rows] == [0, 0, 1, 1, None, None]
    assert rows[0]["label_multiclass_raw"] == " BENIGN"
    blank_attack = labels.normalize_labels(df, "Label", blank_is_missing=False).collect()
    assert [r["label_binary"] for r in blank_attack] == [0, 0, 1, 1, None, 1]
    with pytest.raises(KeyError):
        labels.normalize_labels(df, "absent")


def test_custom_benign_aliases(spark):
    df = spark.createDataFrame([("Normal",), ("Attack",), ("normal",)], "Label string")
    assert [r["label_binary"] for r in labels.normalize_labels(df, "Label", ["normal"]).collect()] == [0, 1, 0]


def test_background_policies(spark):
    df = spark.createDataFrame([("Benign", 0), ("Malicious", 1), (" background ", 1), (None, None)], "o string, label_binary int")
    kept = {p: [r["label_binary"] for r in labels.background_policy(df, "o", p).collect()] for p in labels.BACKGROUND_POLICIES}
    assert kept["exclude"] == [0, 1, None]
    assert kept["treat_as_benign"] == [0, 1, 0, None]
    assert kept["treat_as_malicious"] == [0, 1, 1, None]
    with pytest.raises(ValueError):
        labels.background_policy(df, "o", "guess")
    with pytest.raises(ValueError):
        labels.check_benign_aliases(["Benign", "Background"])


def test_handle_nan_inf(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (4.0,)], "a double")
    assert [r["a"] for r in clean.handle_nan_inf(df).collect()] == [1.0, None, None, 4.0]
    assert [r["a"] for r in clean.handle_nan_inf(df, "keep").collect()] == [1.0, math.inf, -math.inf, 4.0]
    with pytest.raises(ValueError):
        clean.handle_nan_inf(df, "zero")
    with pytest.raises(ValueError):
        clean.handle_nan_inf(df, nan_strategy="drop")


def test_nonnegative(spark):
    df = spark.createDataFrame([("1", 1.0), ("-2", -1.0), (None, None)], "s string, d double")
    rows = clean.validate_nonnegative(df, ["s", "d", "absent"]).collect()
    assert [tuple(r) for r in rows] == [("1", 1.0), (None, None), (None, None)]
    with pytest.raises(TypeError):
        clean.validate_nonnegative(spark.createDataFrame([("x",)], "s string"), ["s"])


def test_capture_day_refuses_unknown_files(spark):
    df = spark.createDataFrame([("p/Monday-a.csv",), ("p/merged.csv",)], "source_file string")
    assert clean.with_capture_day(df.where("source_file LIKE '%Monday%'")).first()["capture_day"] == "monday"
    with pytest.raises(Exception, match="no capture day"):
        clean.with_capture_day(df).collect()
    with pytest.raises(KeyError):
        clean.with_capture_day(df.toDF("x"))
    found = [tuple(r) for r in clean.assign_capture_days(df).collect()]
    assert found == [("p/merged.csv", None, False), ("p/Monday-a.csv", "monday", True)]


def test_mapping_and_application(spark):
    features = ["Destination Port", "Flow Duration", "Idle Mean"]
    matched = mapping.map_features(features, ["Dst Port", "dst_port", "Flow Duration", "Label"])
    assert matched.mapped == {"Destination Port": "Dst Port", "Flow Duration": "Flow Duration"}
    assert matched.unmapped_features == ("Idle Mean",) and matched.unmapped_external == ("dst_port", "Label")
    df = spark.createDataFrame(
        [("80", math.inf), ("bad", 5.0), (None, math.nan)], "`Dst Port` string, `Flow Duration` double"
    )
    medians = {"Destination Port": 443.0, "Flow Duration": 7.0, "Idle Mean": 12345.0}
    rows = [tuple(r) for r in mapping.apply_mapping(df, matched, medians).collect()]
    assert rows == [(80.0, 7.0, 12345.0), (443.0, 5.0, 12345.0), (443.0, 7.0, 12345.0)]
    counts = mapping.sanitisation_counts(df, matched, medians).first()
    assert (counts["n_pos_inf_found"], counts["n_nan_found_before_imputation"]) == (1, 3)
    assert counts["n_values_imputed_with_training_medians"] == 4


def test_mapping_tables_agree_with_the_driver_rule(spark):
    features = ["Flow Bytes/s", "Flow Byts/s", "Total Fwd Packets", "X"]
    external = ["flow_byts_s", "Tot Fwd Pkts", "tot fwd packets", "Y"]
    table = lambda v: literal_table(spark, list(enumerate(v)), "position int, name string")
    got = mapping.map_feature_tables(table(features), table(external)).collect()
    matched = mapping.map_features(features, external)
    assert {(r["feature"], r["external"]) for r in got if r["status"] == "mapped"} == set(matched.mapped.items())
    assert {r["feature"] for r in got if r["status"] == "unmapped_feature"} == set(matched.unmapped_features)
    assert {r["external"] for r in got if r["status"] == "unmapped_external"} == set(matched.unmapped_external)


def test_connection_features(spark):
    df = spark.createDataFrame(
        [(1.5, 100, 200, 4, 2), (0.0, 10, 0, 1, 0), (2.0, 0, 50, 0, 5)],
        "duration double, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long",
    )
    out, report = mapping.flow_features_from_connections(df)
    rows = out.collect()
    assert len(report.direct) == 5 and len(report.derived) == 6 and not report.skipped
    assert rows[0]["Flow Duration"] == 1_500_000.0 and rows[0]["Flow Bytes/s"] == pytest.approx(200.0)
    assert rows[1]["Flow Bytes/s"] == math.inf and math.isnan(rows[1]["Bwd Packet Length Mean"])
    assert math.isnan(rows[2]["Fwd Packet Length Mean"])
    few, skipped = mapping.flow_features_from_connections(df.select("duration", "orig_pkts"))
    assert "Flow Bytes/s" in skipped.skipped and "Fwd Packets/s" in few.columns
