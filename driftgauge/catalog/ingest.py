"""Sources and sinks on data derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.catalog.registry import query, rounded, table
from driftgauge.operators import clean
from driftgauge.session import scratch_path
from driftgauge.sources import files, sinks, zeek

_SUMS = rounded(
    """SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, sum(l_quantity) AS quantity
       FROM lineitem GROUP BY 1""",
    "quantity",
)


def _line_sums(df):
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), F.sum("l_quantity").alias("quantity")
    )


def _write_raw(spark, sf_dir, formats=("parquet", "csv")):
    """A dataset folder whose canonical subfolder and root hold the same rows."""
    raw = scratch_path(spark, "raw")
    columns = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    if "parquet" in formats:
        columns.write.parquet(f"{raw}/parquet")
        columns.write.mode("append").parquet(raw)
    if "csv" in formats:
        columns.write.option("header", True).csv(f"{raw}/csv")
    return raw


@query("parquet_flow_scan", _SUMS)
def parquet_flow_scan(spark, sf_dir):
    return _line_sums(files.read_flows(spark, _write_raw(spark, sf_dir, ["parquet"])))


_MIXED = rounded(
    """SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS quantity
       FROM lineitem GROUP BY 1""",
    "quantity",
)


@query("mixed_parquet_scan", _MIXED)
def mixed_parquet_scan(spark, sf_dir):
    """One part of the files has narrow integers and a column less; no row, column or digit is lost."""
    raw = scratch_path(spark, "mixed")
    lines = table(spark, sf_dir, "lineitem")
    lines.where("l_linestatus = 'F'").select("l_returnflag", F.col("l_linenumber").cast("int")).write.parquet(f"{raw}/parquet")
    lines.where("l_linestatus = 'O'").select("l_returnflag", F.col("l_linenumber").cast("long"), "l_quantity").write.mode(
        "append"
    ).parquet(f"{raw}/parquet")
    return _line_sums(files.read_flows(spark, raw))


@query(
    "mixed_csv_scan",
    rounded(
        """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS numbers,
                  sum(value) FILTER (WHERE user_id % 2 = 0) AS total FROM events GROUP BY 1""",
        "total",
    ),
)
def mixed_csv_scan(spark, sf_dir):
    """One part of the files has text in a number column; coercion decides afterwards."""
    raw = scratch_path(spark, "mixed")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    events.where("user_id % 2 = 0").write.option("header", True).csv(f"{raw}/csv")
    odd = events.where("user_id % 2 = 1").select("event_type", F.lit("bad").alias("value"), "event_id")
    odd.write.mode("append").option("header", True).csv(f"{raw}/csv")
    number = F.col("value").try_cast("double")
    return files.read_flows(spark, raw).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("numbers"), F.sum(number).alias("total")
    )


@query("csv_flow_scan", _SUMS)
def csv_flow_scan(spark, sf_dir):
    return _line_sums(files.read_flows(spark, _write_raw(spark, sf_dir, ["csv"]), prefer="csv"))


@query(
    "column_subset_scan",
    "SELECT count(*) AS n, count(DISTINCT l_linenumber) AS line_numbers, 2::BIGINT AS columns_read FROM lineitem",
)
def column_subset_scan(spark, sf_dir):
    df = files.read_flows(spark, _write_raw(spark, sf_dir, ["parquet"]), columns=["l_linenumber"])
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_linenumber").alias("line_numbers"),
        F.lit(len(df.columns)).alias("columns_read"),
    )


@query("source_resolution", "SELECT 'parquet' AS preferred, count(*) AS rows_once FROM lineitem")
def source_resolution(spark, sf_dir):
    found = files.find_files(spark, _write_raw(spark, sf_dir))
    rows = files.read_parquet(spark, found.of(found.preferred))
    return rows.agg(F.lit(found.preferred).alias("preferred"), F.count(F.lit(1)).alias("rows_once"))


@query("peek_rows", "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 7)")
def peek_rows(spark, sf_dir):
    return files.peek(table(spark, sf_dir, "events"), 7).agg(F.count(F.lit(1)).alias("n"))


@query(
    "external_csv_scan",
    rounded("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", "total"),
)
def external_csv_scan(spark, sf_dir):
    folder = scratch_path(spark, "external")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events.repartition(3, "event_id").write.option("header", True).csv(folder)
    return files.read_external_csv(spark, folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


def _write_logs(spark, sf_dir, broken=None, run=None):
    """events as connection logs: one folder per log, header lines first, two different field lists.

    With ``run`` a log changes its fields and its separator each time that many event ids have gone by.
    """
    folder = scratch_path(spark, "logs")
    log, part = F.pmod("user_id", F.lit(4)).cast("int"), F.expr(f"event_id div {run}") if run else F.lit(0).cast("long")
    events = table(spark, sf_dir, "events").withColumn("log", log).withColumn("part", part)
    reverse = F.pmod(F.col("part"), F.lit(2)) == 1 if run else F.col("log") >= 2
    mark = F.when(reverse, F.lit("|")).otherwise(F.lit("\t")) if run else F.lit("\t")
    cells = [F.col("event_id").cast("string"), F.col("event_type"), F.when(F.col("value") < 5, F.lit("-")).otherwise(F.col("value").cast("string"))]
    names = [F.lit(n) for n in ("event_id", "label", "duration")]
    joined = lambda parts: F.array_join(F.when(reverse, F.array(*reversed(parts))).otherwise(F.array(*parts)), "\x01")
    text = lambda parts: F.replace(joined(parts), F.lit("\x01"), mark)
    tail = F.when(broken, F.concat(mark, F.lit("one too many"))).otherwise("") if broken is not None else F.lit("")
    lines = events.select("log", "part", F.lit(1).alias("kind"), "event_id", F.concat(text(cells), tail).alias("value"))
    code = F.when(mark == "|", F.lit("#separator |")).otherwise(F.lit("#separator \\x09"))
    heads = events.select("log", "part").distinct().select(
        "log", "part", F.lit(0).alias("kind"),
        F.posexplode(F.array(code, F.concat(F.lit("#fields"), mark, text(names)))).alias("event_id", "value"),
    ).withColumn("event_id", F.col("event_id").cast("long"))
    (
        lines.unionByName(heads).repartition("log").sortWithinPartitions("log", "part", "kind", "event_id")
        .select("log", "value").write.partitionBy("log").text(folder)
    )
    return folder


@query(
    "connection_log_scan",
    rounded(
        """SELECT event_type AS label, count(*) AS n, count(*) FILTER (WHERE value < 5) AS missing,
                  sum(value) FILTER (WHERE value >= 5) AS duration FROM events GROUP BY 1""",
        "duration",
    ),
)
def connection_log_scan(spark, sf_dir):
    logs = zeek.read_connection_logs(spark, _write_logs(spark, sf_dir), pattern="*.txt")
    duration = F.col("duration").try_cast("double")
    return logs.table.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(duration.isNull()).alias("missing"),
        F.sum(duration).alias("duration"),
    )


@query(
    "changing_log_scan",
    rounded(
        """SELECT event_type AS label, count(*) AS n, count(*) FILTER (WHERE value < 5) AS missing,
                  sum(event_id) AS ids, sum(value) FILTER (WHERE value >= 5) AS duration FROM events GROUP BY 1""",
        "duration",
    ),
)
def changing_log_scan(spark, sf_dir):
    """Logs that change their fields and their separator midway, many times."""
    logs = zeek.read_connection_logs(spark, _write_logs(spark, sf_dir, run=500), pattern="*.txt")
    duration = F.col("duration").try_cast("double")
    return logs.table.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(duration.isNull()).alias("missing"),
        F.sum(F.col("event_id").cast("long")).alias("ids"), F.sum(duration).alias("duration"),
    )


@query(
    "connection_log_report",
    """SELECT count(DISTINCT user_id % 4) AS files_parsed, count(*) AS rows_read, 0::BIGINT AS malformed_rows FROM events""",
)
def connection_log_report(spark, sf_dir):
    return zeek.read_connection_logs(spark, _write_logs(spark, sf_dir), pattern="*.txt").report


@query(
    "partitioned_sink",
    """SELECT lower(dayname(ts)) AS capture_day, count(*) AS n FROM events
       WHERE dayname(ts) IN ('Thursday', 'Friday') GROUP BY 1""",
)
def partitioned_sink(spark, sf_dir):
    path = scratch_path(spark, "parts")
    events = table(spark, sf_dir, "events").withColumn("capture_day", F.lower(F.date_format("ts", "EEEE")))
    sinks.write_table(events, path, ["capture_day"])
    kept = spark.read.parquet(path).where(F.col("capture_day").isin("thursday", "friday"))
    return kept.groupBy("capture_day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "result_sinks",
    """SELECT 'csv' AS format, event_type, count(*) AS n FROM events GROUP BY 2
       UNION ALL SELECT 'json', event_type, count(*) FROM events GROUP BY 2""",
)
def result_sinks(spark, sf_dir):
    result = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    csv, json = scratch_path(spark, "csv"), scratch_path(spark, "json")
    sinks.write_result(result, csv, "csv")
    sinks.write_result(result, json, "json")
    schema = result.schema
    return (
        spark.read.schema(schema).option("header", True).csv(csv).withColumn("format", F.lit("csv"))
        .unionByName(spark.read.schema(schema).json(json).withColumn("format", F.lit("json")))
        .select("format", "event_type", "n")
    )


@query(
    "capture_days_of_files",
    """SELECT DISTINCT 'flows/Traffic-' || dayname(ts) || '-part.csv' AS source_file,
              CASE WHEN dayname(ts) IN ('Saturday', 'Sunday') THEN NULL ELSE lower(dayname(ts)) END AS capture_day,
              dayname(ts) NOT IN ('Saturday', 'Sunday') AS detected FROM events""",
)
def capture_days_of_files(spark, sf_dir):
    return clean.assign_capture_days(_named_files(spark, sf_dir))


def _named_files(spark, sf_dir):
    day = F.date_format("ts", "EEEE")
    return table(spark, sf_dir, "events").withColumn(
        "source_file", F.concat(F.lit("flows/Traffic-"), day, F.lit("-part.csv"))
    )


@query(
    "rows_with_capture_day",
    """SELECT lower(dayname(ts)) AS capture_day, count(*) AS n FROM events
       WHERE dayname(ts) NOT IN ('Saturday', 'Sunday') GROUP BY 1""",
)
def rows_with_capture_day(spark, sf_dir):
    weekdays = _named_files(spark, sf_dir).where(~F.date_format("ts", "EEEE").isin("Saturday", "Sunday"))
    return clean.with_capture_day(weekdays).groupBy("capture_day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "broken_log_report",
    """SELECT count(DISTINCT user_id % 4) AS files_parsed, count(*) AS rows_read,
              count(*) FILTER (WHERE event_id % 97 = 5) AS malformed_rows FROM events""",
)
def broken_log_report(spark, sf_dir):
    """Some lines have a field too many: the report counts them, and the table refuses to be read."""
    folder = _write_logs(spark, sf_dir, F.col("event_id") % 97 == 5)
    return zeek.read_connection_logs(spark, folder, pattern="*.txt").report
