"""Splits, leakage checks and samples on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.catalog.registry import FEATURES, FLOWS, flows, query, table, train_side
from driftgauge.operators import sampling, splits

TIMED = """ordered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events),
  sided AS (SELECT *, CASE WHEN pos <= round_even(n * 0.8e0, 0) THEN 'train' ELSE 'test' END AS side FROM ordered)"""


def _events_split(spark, sf_dir):
    return splits.chronological_split(table(spark, sf_dir, "events"), "ts", 0.2, "event_id")


def _lines(spark, sf_dir):
    return splits.chronological_split(table(spark, sf_dir, "lineitem"), "l_shipdate", 0.2)


def _with_day(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("capture_day", F.lower(F.date_format("ts", "EEEE")))


@query(
    "timestamp_detection",
    """SELECT 'flow start' AS "column", count(t) AS n_values, count(*) FILTER (WHERE t IS NOT NULL AND try_cast(t AS TIMESTAMP) IS NULL) AS n_unparseable,
              true AS parsed FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'no time' WHEN event_id % 10 = 1 THEN NULL
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)""",
)
def timestamp_detection(spark, sf_dir):
    text = (
        F.when(F.col("event_id") % 10 == 0, "no time")
        .when(F.col("event_id") % 10 != 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    events = table(spark, sf_dir, "events").select("event_id", text.alias("flow start"))
    return splits.detect_timestamp_column(events).drop("candidates")


@query("chronological_split_rows", f"WITH {TIMED} SELECT event_id, side FROM sided")
def chronological_split_rows(spark, sf_dir):
    split = _events_split(spark, sf_dir)
    side = lambda df, name: df.select("event_id", F.lit(name).alias("side"))
    return side(split.train, "train").unionByName(side(split.test, "test"))


@query(
    "chronological_split_bounds",
    f"""WITH {TIMED} SELECT count(*) FILTER (WHERE side = 'train') AS n_train,
        strftime(min(ts) FILTER (WHERE side = 'train'), '%Y-%m-%d %H:%M:%S.%f') AS train_start,
        strftime(max(ts) FILTER (WHERE side = 'train'), '%Y-%m-%d %H:%M:%S.%f') AS train_end,
        count(*) FILTER (WHERE side = 'test') AS n_test,
        strftime(min(ts) FILTER (WHERE side = 'test'), '%Y-%m-%d %H:%M:%S.%f') AS test_start,
        strftime(max(ts) FILTER (WHERE side = 'test'), '%Y-%m-%d %H:%M:%S.%f') AS test_end FROM sided""",
)
def chronological_split_bounds(spark, sf_dir):
    return splits.split_bounds(_events_split(spark, sf_dir))


@query(
    "time_leakage_clean",
    f"""WITH {TIMED}, shared AS (SELECT ts FROM sided GROUP BY ts HAVING count(DISTINCT side) = 2)
    SELECT count(*) = 0 AS passed, true AS order_ok, count(*) AS n_shared_timestamps,
           0::BIGINT AS n_overlapping_rows FROM shared""",
)
def time_leakage_clean(spark, sf_dir):
    return splits.check_time_leakage(_events_split(spark, sf_dir)).drop("train_end", "test_start")


@query(
    "time_leakage_found",
    """WITH o AS (SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) AS pos, count(*) OVER () AS n FROM lineitem),
       s AS (SELECT l_shipdate, count(*) AS rows, count(DISTINCT pos <= round_even(n * 0.8e0, 0)) AS sides FROM o GROUP BY 1)
       SELECT count(*) FILTER (WHERE sides = 2) = 0 AS passed, true AS order_ok,
              count(*) FILTER (WHERE sides = 2) AS n_shared_timestamps,
              coalesce(sum(rows) FILTER (WHERE sides = 2), 0)::BIGINT AS n_overlapping_rows FROM s""",
)
def time_leakage_found(spark, sf_dir):
    return splits.check_time_leakage(_lines(spark, sf_dir)).drop("train_end", "test_start")


@query(
    "tied_split_sizes",
    """SELECT round_even(count(*) * 0.8e0, 0)::BIGINT AS n_train, count(*) - round_even(count(*) * 0.8e0, 0)::BIGINT AS n_test
       FROM lineitem""",
)
def tied_split_sizes(spark, sf_dir):
    return splits.split_bounds(_lines(spark, sf_dir)).select("n_train", "n_test")


@query(
    "day_split_rows",
    """SELECT event_id, CASE WHEN dayname(ts) = 'Friday' THEN 'test' ELSE 'train' END AS side FROM events
       WHERE dayname(ts) NOT IN ('Saturday', 'Sunday')""",
)
def day_split_rows(spark, sf_dir):
    split = splits.day_split(_with_day(spark, sf_dir), ["friday"])
    side = lambda df, name: df.select("event_id", F.lit(name).alias("side"))
    return side(split.train, "train").unionByName(side(split.test, "test"))


@query(
    "day_leakage_check",
    """SELECT true AS passed, true AS order_ok, 0::BIGINT AS n_shared_days, 'monday,tuesday,wednesday,thursday' AS train_days,
              'friday' AS test_days FROM events HAVING count(DISTINCT dayname(ts)) = 7""",
)
def day_leakage_check(spark, sf_dir):
    check = splits.check_day_leakage(splits.day_split(_with_day(spark, sf_dir), ["friday"]))
    return check.withColumns({c: F.array_join(c, ",") for c in ("train_days", "test_days")})


@query(
    "validation_split_sizes",
    """SELECT 'subtrain' AS side, count(*) AS n FROM events WHERE dayname(ts) IN ('Monday', 'Tuesday', 'Wednesday')
       UNION ALL SELECT 'validation', count(*) FROM events WHERE dayname(ts) = 'Thursday'""",
)
def validation_split_sizes(spark, sf_dir):
    outer = splits.day_split(_with_day(spark, sf_dir), ["friday"])
    inner = splits.validation_split(outer.train)
    size = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return size(inner.train, "subtrain").unionByName(size(inner.test, "validation"))


@query(
    "split_method_choice",
    f"""WITH {TIMED} SELECT 'timestamp' AS method, side, count(*) AS n, 'value' AS features FROM sided GROUP BY side
    UNION ALL SELECT 'capture_day', CASE WHEN dayname(ts) = 'Friday' THEN 'test' ELSE 'train' END, count(*), 'value'
    FROM events WHERE dayname(ts) NOT IN ('Saturday', 'Sunday') GROUP BY 2""",
)
def split_method_choice(spark, sf_dir):
    """The same rows with and without a timestamp column; both keep only the value as a feature."""
    events = _with_day(spark, sf_dir)
    parts = None
    for df, features in (
        (events.withColumnRenamed("ts", "timestamp"), ["value", "timestamp", "capture_day"]),
        (events.drop("ts"), ["value", "capture_day"]),
    ):
        split, left, method = splits.split_in_time(df, features, row_key="event_id")
        for name, side in (("train", split.train), ("test", split.test)):
            part = side.agg(
                F.lit(method).alias("method"), F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"),
                F.lit(",".join(left)).alias("features"),
            )
            parts = part if parts is None else parts.unionByName(part)
    return parts


@query(
    "day_label_table",
    """SELECT lower(dayname(ts)) AS capture_day, count(*) FILTER (WHERE event_type = 'click') AS click,
         count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
         count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view
       FROM events WHERE dayname(ts) NOT IN ('Saturday', 'Sunday') GROUP BY 1""",
)
def day_label_table(spark, sf_dir):
    return splits.day_label_table(_with_day(spark, sf_dir), "event_type")


@query(
    "benign_heavy_sample",
    f"""WITH {FLOWS}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE label_binary = 0) AS b, count(*) FILTER (WHERE label_binary = 1) AS a FROM train),
        w AS (SELECT *, least(100000, n) AS k FROM s)
    SELECT 0::BIGINT AS label_binary, least(round_even(k * 0.9e0, 0), b)::BIGINT AS n FROM w
    UNION ALL SELECT 1, least(k - round_even(k * 0.9e0, 0), a)::BIGINT FROM w""",
)
def benign_heavy_sample(spark, sf_dir):
    sample = sampling.benign_heavy_sample(train_side(flows(spark, sf_dir)), FEATURES)
    return sample.table.groupBy("label_binary").agg(F.count(F.lit(1)).alias("n"))


@query(
    "balanced_sample",
    """WITH c AS (SELECT o_orderstatus AS class, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus) AS i,
                         count(*) OVER () AS k FROM orders GROUP BY 1)
       SELECT class, least(n, 100 // k + CASE WHEN i <= 100 % k THEN 1 ELSE 0 END)::BIGINT AS n FROM c""",
)
def balanced_sample(spark, sf_dir):
    sample = sampling.balanced_sample(table(spark, sf_dir, "orders"), "o_orderstatus", 100, row_key="o_orderkey")
    return sample.groupBy(F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "balanced_sample_shortfall",
    """SELECT least(count(*), (SELECT count(*) FROM labels WHERE toxic = 1) * 2 + 40) AS n,
              count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM labels""",
)
def balanced_sample_shortfall(spark, sf_dir):
    df = table(spark, sf_dir, "labels")
    toxic = df.where("toxic = 1").count()
    sample = sampling.balanced_sample(df, "toxic", 2 * toxic + 40, row_key="doc_id")
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query(
    "capped_feature_sample",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{f}' AS feature, least(500, count({f})) AS n FROM
            (SELECT l_returnflag, l_discount, CASE WHEN l_tax = 0.01 THEN l_tax END AS rare_tax FROM lineitem) GROUP BY 1"""
        for f in ("l_discount", "rare_tax")
    ),
)
def capped_feature_sample(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("rare_tax", F.when(F.col("l_tax") == 0.01, F.col("l_tax")))
    sample = sampling.capped_sample(df, ["l_discount", "rare_tax"], 500, "l_returnflag")
    return sample.groupBy("l_returnflag", "feature").agg(F.count(F.lit(1)).alias("n"))
