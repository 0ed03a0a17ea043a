import math

import pytest
from pyspark.sql import functions as F

from driftgauge.functions import days, labels, names, numeric


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "top, bottom, expected",
    [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (6.0, 3.0, 2.0), (None, 0.0, None), (1.0, None, None)],
)
def test_ieee_divide(spark, top, bottom, expected):
    value = numeric.ieee_divide(F.lit(top).cast("double"), F.lit(bottom).cast("double"))
    assert one(spark, value) == expected


def test_zero_by_zero_is_nan(spark):
    assert math.isnan(one(spark, numeric.ieee_divide(F.lit(0.0), F.lit(0.0))))


@pytest.mark.parametrize("value, kept", [(1.5, 1.5), (math.nan, None), (math.inf, None), (-math.inf, None)])
def test_finite(spark, value, kept):
    assert one(spark, numeric.finite(F.lit(value))) == kept


def test_percent_shift(spark):
    assert one(spark, numeric.percent_shift(F.lit(150.0), F.lit(100.0))) == 50.0
    assert one(spark, numeric.percent_shift(F.lit(-5.0), F.lit(-10.0))) == 50.0
    assert one(spark, numeric.percent_shift(F.lit(1.0), F.lit(0.0))) is None


@pytest.mark.parametrize(
    "raw, canonical",
    [
        (" BENIGN", "Benign"), ("BENIGN", "Benign"), ("DoS Hulk ", "DoS Hulk"), ("PortScan", "PortScan"),
        ("\tddos\n", "DDoS"), ("dosslowhttptest", "DoS Slowhttptest"), ("Web Attack - XSS", "Web Attack � XSS"),
        ("web attack \x96 Brute Force", "Web Attack � Brute Force"), ("Web Attack injection", "Web Attack � Sql Injection"),
        ("web attack other", "web attack other"), ("Brand New", "Brand New"), ("   ", ""), (None, "NaN"),
    ],
)
def test_canonical_label(spark, raw, canonical):
    assert one(spark, labels.canonical_label(F.lit(raw).cast("string"))) == canonical


@pytest.mark.parametrize(
    "name, day",
    [
        ("Tuesday-WorkingHours.pcap_ISCX.csv", "tuesday"), ("x/y/DDoS-Friday-no-metadata.parquet", "friday"),
        ("Thursday_morning.csv", "thursday"), ("money_flow_stats.csv", None), ("xmonday.csv", None),
        ("friday/plain.csv", None), ("MONDAY.csv", "monday"),
    ],
)
def test_capture_day(spark, name, day):
    assert one(spark, days.capture_day(F.lit(name))) == day


@pytest.mark.parametrize(
    "left, right",
    [
        ("Destination Port", "Dst Port"), ("Bwd Packets/s", "Bwd Pkts/s"),
        ("Total Length of Fwd Packets", "TotLen Fwd Pkts"), ("Flow_Bytes.s", "flow byts-s"),
    ],
)
def test_feature_keys_meet(spark, left, right):
    assert names.feature_key(left) == names.feature_key(right)
    for name in (left, right):
        assert one(spark, names.feature_key_column(F.lit(name))) == names.feature_key(name)


def test_label_column_detection():
    assert names.detect_label_column(["a", " Label"]) == " Label"
    assert names.detect_label_column(["attack", "label"]) == "label"
    assert names.detect_label_column(["LABEL"]) == "LABEL"
    assert names.detect_label_column(["a", "b"]) is None


def test_name_rules():
    columns = ["Flow ID", "Src IP", "Dst Port", "Feature A", "Label", "Attack Category", "Unnamed: 0"]
    assert names.identifier_like(columns) == ["Flow ID", "Src IP", "Dst Port", "Unnamed: 0"]
    assert names.label_like(columns, "Label") == ["Attack Category"]
    assert names.timestamp_candidates(["a", "Flow Start Time", "TimeStamp"]) == ["Flow Start Time", "TimeStamp"]
    assert names.repeated(["A", "A", "B"]) == ["A"]
