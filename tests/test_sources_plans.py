import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.plans import detect, explanations, external, prepare, unseen
from driftgauge.session import settle
from driftgauge.sources import files, sinks, zeek
from driftgauge.streaming import flows as streams


def small(n=5, label=" Label"):
    return pd.DataFrame({"Flow Duration": np.arange(n), "Total Fwd Packets": np.arange(n, dtype="int32"),
                         label: ["BENIGN", "DoS Hulk"] * (n // 2) + ["BENIGN"] * (n % 2)})


def test_canonical_folders_win_over_copies(spark, tmp_path):
    (tmp_path / "parquet" / "deep").mkdir(parents=True)
    for path in ("b.parquet", "parquet/B.parquet", "parquet/a.PQ", "parquet/deep/c.parquet", "x.csv"):
        target = tmp_path / path
        small().to_csv(target, index=False) if path.endswith("csv") else small().to_parquet(target)
    found = files.find_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in found.parquet] == ["a.PQ", "B.parquet"]
    assert len(found.csv) == 1 and found.preferred == "parquet"
    df = files.read_flows(spark, str(tmp_path))
    assert df.count() == 10 and dict(df.dtypes)["Total Fwd Packets"] == "bigint"
    assert files.read_flows(spark, str(tmp_path), prefer="csv").count() == 5
    assert files.read_flows(spark, str(tmp_path), columns=["Flow Duration"]).columns == ["Flow Duration", "source_file"]
    with pytest.raises(KeyError):
        files.read_flows(spark, str(tmp_path), columns=["absent"])
    with pytest.raises(ValueError):
        files.read_flows(spark, str(tmp_path), prefer="xml")
    with pytest.raises(FileNotFoundError):
        files.find_files(spark, str(tmp_path / "absent"))
    with pytest.raises(FileNotFoundError):
        files.read_flows(spark, str(tmp_path / "parquet" / "deep" / ".."), prefer="csv").count() and files.read_flows(
            spark, str(tmp_path / "absent"))


def test_csv_names_encodings_and_headers(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("Flow Duration , Label\n1, BENIGN\n2,Web Attack \ufffd XSS\n".encode())
    (tmp_path / "l.csv").write_bytes("Flow Duration, Label,Extra\n3,caf\xe9,1\n".encode("latin-1"))
    df = files.read_flows(spark, str(tmp_path))
    assert {"Flow Duration", "Label", "Extra"} <= set(df.columns)
    rows = {r["Flow Duration"]: (r["Label"], r["Extra"]) for r in df.collect()}
    assert rows == {1: ("BENIGN", None), 2: ("Web Attack \ufffd XSS", None), 3: ("café", 1)}
    (tmp_path / "dup").mkdir()
    (tmp_path / "dup" / "d.csv").write_text("A,A,B\n1,2,3\n")
    assert files.csv_header(spark, str(tmp_path / "dup" / "d.csv")) == ["A", "A", "B"]
    with pytest.raises(ValueError):
        files.peek(df, 0)
    assert files.read_external_csv(spark, str(tmp_path / "absent")) is None
    assert files.read_external_csv(spark, str(tmp_path)).count() == 3


HEADER = "#separator \\x09\n#set_separator\t,\n#fields\tuid\tduration\torig_bytes\tresp_bytes\torig_pkts\tresp_pkts\tlabel\n#types\tx\n"


def log_text(n, start=0):
    kinds = ["Benign", "Malicious", "Background"]
    return HEADER + "".join(
        f"C{i}\t{'-' if i % 7 == 0 else i / 10}\t{i * 10}\t{i * 3}\t{i % 5}\t{'(empty)' if i % 11 == 0 else i % 3}\t{kinds[i % 3]}\n"
        for i in range(start, start + n)
    ) + "#close\t2017\n"


def test_connection_logs(spark, tmp_path):
    (tmp_path / "a" / "_macros").mkdir(parents=True)
    (tmp_path / "a" / "one.conn-labeled.log").write_text(log_text(50))
    (tmp_path / "two.conn-labeled.log").write_text("#separator |\n#fields|label|uid|note\r\nBenign|X|-\r\n")
    (tmp_path / "a" / "_macros" / "m.conn-labeled.log").write_text("not a log\n")
    (tmp_path / "other.log").write_text("not a log\n")
    logs = zeek.read_connection_logs(spark, str(tmp_path))
    assert tuple(logs.report.first()) == (2, 51, 0)
    rows = {r["uid"]: r for r in logs.table.collect()}
    assert rows["C7"]["duration"] is None and rows["C11"]["resp_pkts"] is None and rows["C8"]["duration"] == "0.8"
    assert rows["X"]["label"] == "Benign" and rows["X"]["note"] is None and rows["X"]["orig_bytes"] is None
    assert zeek.read_connection_logs(spark, str(tmp_path / "absent")) is None


@pytest.mark.parametrize("text", ["a\tb\n#fields\tx\ty\na\tb\n", "a\tb\n", "#separator |\na\n"])
def test_bad_log_headers(spark, tmp_path, text):
    (tmp_path / "bad.conn-labeled.log").write_text(text)
    with pytest.raises(ValueError):
        zeek.read_connection_logs(spark, str(tmp_path))


def changing_log(n):
    """A log whose header changes every few lines, and its rows."""
    text, rows = ["# a comment"], []
    layouts = [("\\x09", "\t", ["uid", "label", "a"]), ("|", "|", ["b", "uid", "label"]), (None, "|", ["label", "uid"]), ("\\t", "\t", ["uid", "a"])]
    for i in range(n):
        code, mark, names = layouts[i // 7 % 4]
        if i % 7 == 0:
            text += ["", *([f"#separator {code}"] if code else []), "#fields" + mark + mark.join(names), "#types" + mark + "string"]
        row = {k: f"{k}{i}" for k in names}
        text.append(mark.join(row.values()))
        rows.append({**dict.fromkeys(("uid", "label", "a", "b")), **row})
    return "\n".join(text) + "\n", rows


@pytest.mark.parametrize("split", [None, 64, 300])
def test_logs_may_change_their_header_midway(spark, tmp_path, split):
    """Headers beyond the first file split too, and splits without a header of their own."""
    text, rows = changing_log(100)
    (tmp_path / "one.conn-labeled.log").write_text(text)
    (tmp_path / "two.conn-labeled.log").write_text("#fields\tuid\n" + "x\n" * 300 + "#separator |\nx|y\n".replace("x|y", "z") + "#fields|a|uid\n-|last\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        logs = zeek.read_connection_logs(spark, str(tmp_path))
        assert tuple(logs.report.first()) == (2, 402, 0)
        got = [r.asDict() for r in logs.table.select("uid", "label", "a", "b").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows += [{"uid": u, "label": None, "a": None, "b": None} for u in ["x"] * 300 + ["z", "last"]]
    key = lambda r: tuple(str(r[k]) for k in ("uid", "label", "a", "b"))
    assert sorted(map(key, got)) == sorted(map(key, rows))


def test_lines_do_not_carry_the_headers_of_their_split(spark, tmp_path):
    """Work by line is the same with few and with many headers: none but the last one above reaches a line."""
    text, rows = changing_log(1400)
    (tmp_path / "one.conn-labeled.log").write_text(text)
    (tmp_path / "two.conn-labeled.log").write_text(log_text(20))
    table = zeek.read_connection_logs(spark, str(tmp_path)).table
    got = [r.asDict() for r in table.where("source_file LIKE '%one%'").select("uid", "label", "a", "b").collect()]
    key = lambda r: tuple(str(r[k]) for k in ("uid", "label", "a", "b"))
    assert sorted(map(key, got)) == sorted(map(key, rows)) and table.count() == 1420
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "headers" not in plan and "lambdafunction" not in plan


def test_logs_read_in_other_splits_are_refused(spark, tmp_path):
    (tmp_path / "one.conn-labeled.log").write_text(changing_log(100)[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    logs = zeek.read_connection_logs(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    try:
        with pytest.raises(Exception, match="file splits changed"):
            logs.table.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_malformed_log_line(spark, tmp_path):
    (tmp_path / "bad.conn-labeled.log").write_text("#fields\tx\ty\na\tb\nonly one\n")
    with pytest.raises(Exception, match="malformed line"):
        zeek.read_connection_logs(spark, str(tmp_path)).table.collect()


def test_thresholds_and_status(spark, tmp_path):
    path = str(tmp_path / "t")
    fallback = sinks.load_thresholds(spark, path)
    assert (fallback.forest, fallback.anomaly, fallback.hybrid, fallback.source) == (0.01, 0.15, 0.5, "fallback_default")
    picked = sinks.threshold_table(spark, {"random_forest": 0.3, "isolation_forest": 0.2, "hybrid": 0.4})
    sinks.save_thresholds(spark, path, picked)
    saved = sinks.load_thresholds(spark, path)
    assert (saved.forest, saved.anomaly, saved.hybrid) == (0.01, 0.2, 0.4)
    assert sinks.load_thresholds(spark, path, hybrid=0.9).hybrid == 0.9
    assert sinks.load_thresholds(spark, path, 0.7, 0.8).source == "override"
    with pytest.raises(FileNotFoundError):
        sinks.require_artifacts(spark, {"model": str(tmp_path / "absent")})
    status = sinks.missing_dataset_status(spark, "x", "/nowhere", saved).first()
    assert status["status"] == "pipeline_ready_dataset_required" and status["no_models_retrained"]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    rng = random.Random(1)
    for day in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"):
        rows = []
        for i in range(300):
            attack = rng.random() < 0.3
            late = ["DDoS", "Bot", "DoS Hulk"][i % 3]
            label = (late if day == "Friday" else ["DoS Hulk", "FTP-Patator"][i % 2]) if attack else " BENIGN"
            base = 5 if attack else 0
            rows.append(
                (rng.gauss(base, 1), abs(rng.gauss(100 + base * 20, 30)), -1.0 if i % 97 == 0 else i % 50,
                 float("inf") if i % 111 == 0 else rng.gauss(base, 2), 3, f"10.0.0.{i % 9}", label)
            )
        df = pd.DataFrame(rows, columns=["f1", "Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "const", "Src IP", "Label"])
        df["f1 again"] = df["f1"]
        df.to_parquet(folder / f"Traffic-{day}-part.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def prepared(spark, raw, tmp_path_factory):
    return prepare.prepare(spark, raw, str(tmp_path_factory.mktemp("out") / "p"))


@pytest.fixture(scope="module")
def trained(spark, prepared):
    detectors = detect.train_detectors(
        prepared.train, prepared.features, forest_options=dict(n_trees=8, max_depth=5),
        sample_options=dict(n_samples=500), anomaly_options=dict(n_trees=30),
    )
    test = settle(prepared.test.withColumn("key", F.monotonically_increasing_id()), "keyed")
    return detectors, detect.evaluate(detectors, prepared.train, test, keep=["key"])


def test_prepare(spark, prepared):
    assert prepared.features == ["f1", "Flow Duration", "Total Fwd Packets", "Flow Bytes/s"]
    assert prepared.method == "capture_day" and (prepared.train.count(), prepared.test.count()) == (1200, 300)
    assert "f1 again" not in prepared.train.columns and "const" in prepared.train.columns
    assert prepared.train.where("`Total Fwd Packets` < 0").count() == 0
    assert {r["operator"] for r in prepared.log.collect()} >= {"normalize_labels", "handle_nan_inf", "validate_nonnegative", "drop_duplicate"}


def test_evaluation_and_unseen(prepared, trained):
    detectors, result = trained
    assert result.unseen == ["Bot", "DDoS"] and result.selection.thresholds.forest == 0.01
    rows = {r["detector"]: r for r in result.comparison.collect()}
    assert rows["random_forest"]["roc_auc"] > 0.95 and rows["hybrid"]["total_samples"] == 300
    assert result.alerts.count() == rows["hybrid"]["tp"] + rows["hybrid"]["fp"]
    found = unseen.evaluate_unseen(detectors, prepared.train, result.scored_test, result.selection.thresholds)
    assert found.comparison.count() == 12 and found.wide.count() == 2 and found.findings.count() == 3
    drift = unseen.analyse_drift(
        detectors, prepared.train, result.scored_test, result.selection.thresholds, ["Bot", "DDoS", "PortScan"]
    )
    assert drift.tests.count() == 12 and drift.summary.count() == 2
    same = result.scored_test.where("label_multiclass = 'Benign'")
    with pytest.raises(ValueError):
        unseen.evaluate_unseen(detectors, prepared.train, same, result.selection.thresholds)


def test_external_logs_and_missing_data(spark, prepared, trained, tmp_path):
    detectors, result = trained
    (tmp_path / "one.conn-labeled.log").write_text(log_text(90))
    thresholds = result.selection.thresholds
    got = external.evaluate_connection_logs(spark, detectors, str(tmp_path), thresholds, train=prepared.train)
    assert tuple(got.background.first())[:3] == (90, 30, 60)
    assert all(r["total_samples"] == 60 for r in got.comparison.collect())
    assert "f1" in got.feature_mapping.unmapped_features and got.shift_tests.count() == 3
    status = external.evaluate_csv_folder(spark, detectors, str(tmp_path), thresholds)
    assert status.first()["status"] == "pipeline_ready_dataset_required"
    (tmp_path / "e.csv").write_text("Flow Duration,Label\n5,Benign\n7,Bot\n")
    csv = external.evaluate_csv_folder(spark, detectors, str(tmp_path), thresholds)
    assert csv.comparison.first()["total_samples"] == 2 and csv.families.count() == 6


def test_explanations(trained):
    detectors, result = trained
    made = explanations.explain_detectors(detectors, result.scored_test, result.selection.thresholds, "key")
    assert made.comparison.count() == 4 and made.anomaly.count() == 4
    assert made.evidence.count() == made.forest_local.count() + made.anomaly_local.count()


def test_streams(spark, raw, prepared, trained, tmp_path):
    detectors, result = trained
    schema = spark.read.parquet(raw).schema
    cleaned = streams.clean_flow_stream(streams.read_flow_stream(spark, raw, schema, files_per_trigger=2), "Label")
    streams.write_stream(cleaned, str(tmp_path / "rows"), str(tmp_path / "c1"), ["capture_day"]).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "rows"))
    columns = ["f1", "Flow Bytes/s", "Total Fwd Packets", "Label", "label_binary"]
    batch = prepare.clean_flows(files.read_flows(spark, raw), "Label").select(*columns)
    assert rows.count() == 1500 and rows.select(*columns).exceptAll(batch).count() == 0
    with pytest.raises(ValueError):
        streams.score_flow_stream(cleaned, detectors, result.selection.thresholds)
    frozen = detect.Detectors(detectors.forest, detectors.anomaly.freeze_range(prepared.train), detectors.hybrid)
    alerts = streams.score_flow_stream(cleaned, frozen, result.selection.thresholds, keep=["capture_day"])
    streams.write_stream(alerts, str(tmp_path / "alerts"), str(tmp_path / "c2")).awaitTermination()
    expected = frozen.score_rows(rows).where(F.col("hybrid_score") >= result.selection.thresholds.hybrid).count()
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == expected


def test_parquet_files_may_differ(spark, tmp_path):
    folder = str(tmp_path / "raw")
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{folder}/parquet")
    spark.createDataFrame([(1 << 40, 3, 0.5)], "a long, b int, c double").write.mode("append").parquet(f"{folder}/parquet")
    spark.createDataFrame([("x", 4)], "a string, b int").write.mode("append").parquet(f"{folder}/parquet")
    got = files.read_flows(spark, folder).select("a", "b", "c").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [("1", 2, None), (str(1 << 40), 3, 0.5), ("x", 4, None)]


def test_csv_heads_are_found_without_a_sort(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n" + "1,2\n" * 500)
    (folder / "b.csv").write_bytes("z,é\n1,2\n".encode("latin-1"))
    plans, collect = [], DataFrame.collect
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
        found = files._heads(spark, [str(folder / "a.csv"), str(folder / "b.csv")])
    assert [(used, header) for _, used, header in found] == [("UTF-8", ("x", "y")), ("ISO-8859-1", ("z", "é"))]
    assert len(plans) == 1 and "ObjectHashAggregate" in plans[0] and "Sort" not in plans[0]


def test_csv_files_may_differ_in_type(spark, tmp_path):
    folder = str(tmp_path / "raw")
    spark.createDataFrame([(1.5, "p")], "x double, y string").write.option("header", True).csv(f"{folder}/csv")
    spark.createDataFrame([("bad",)], "x string").write.mode("append").option("header", True).csv(f"{folder}/csv")
    assert sorted(tuple(r) for r in files.read_flows(spark, folder).select("x").collect()) == [("1.5",), ("bad",)]


def test_malformed_lines_are_counted_and_refused(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.conn-labeled.log").write_text("#separator \\x09\n#fields\ta\tb\tc\n1\t2\t3\n1\t2\n4\t5\t6\n")
    logs = zeek.read_connection_logs(spark, str(folder))
    report = logs.report.first()
    assert (report["rows_read"], report["malformed_rows"]) == (3, 1)
    with pytest.raises(Exception, match="expected 3 fields, got 2"):
        logs.table.count()
    assert zeek.read_connection_logs(spark, str(tmp_path / "none")) is None
