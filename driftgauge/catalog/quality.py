"""Schema, quality, labels, cleaning and feature mapping on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.catalog.registry import FEATURES, FLOWS, flows, query, rounded, table, train_side
from driftgauge.functions import labels as L
from driftgauge.functions import names
from driftgauge.functions.names import feature_key_column
from driftgauge.functions.numeric import coerce_number, ieee_divide
from driftgauge.operators import clean, guards, labels, mapping, quality
from driftgauge.operators.order_stats import collect_medians, column_medians, exact_quantiles
from driftgauge.plans.prepare import choose_features
from driftgauge.sources import files


@query(
    "schema_report",
    """SELECT count(*) AS n_rows, 3::BIGINT AS n_columns, 'doc_id,label,Unnamed: 0' AS columns,
              'label' AS detected_label_column, '' AS duplicate_columns, 'Unnamed: 0' AS unnamed_columns FROM labels""",
)
def schema_report(spark, sf_dir):
    report = quality.schema_report(table(spark, sf_dir, "labels").toDF("doc_id", "label", "Unnamed: 0"))
    lists = ["columns", "duplicate_columns", "unnamed_columns"]
    return report.select(
        "n_rows", "n_columns", "detected_label_column", *[F.array_join(c, ",").alias(c) for c in lists]
    )


def _rates(spark, sf_dir):
    """lineitem with an infinite rate at zero tax, a negative difference and missing values."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "rate": ieee_divide(F.col("l_extendedprice"), F.col("l_tax")),
            "margin": F.col("l_discount") - 0.05,
            "gap": F.when(F.col("l_quantity") > 10, F.col("l_quantity")),
        }
    ).select("l_orderkey", "l_returnflag", "rate", "margin", "gap")


RATES_SQL = """rates AS (SELECT l_orderkey, l_returnflag,
    CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_tax END AS rate,
    l_discount - 0.05e0 AS margin, CASE WHEN l_quantity > 10 THEN l_quantity END AS gap FROM lineitem)"""


@query(
    "missing_infinite_report",
    f"""WITH {RATES_SQL}
    SELECT 'l_orderkey' AS "column", count(*) AS n_rows, count(*) - count(l_orderkey) AS n_missing, 0 AS n_infinite, false AS all_missing FROM rates
    UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), 0, false FROM rates
    UNION ALL SELECT 'rate', count(*), count(*) - count(rate), count(*) FILTER (WHERE isinf(rate)), false FROM rates
    UNION ALL SELECT 'margin', count(*), count(*) - count(margin), count(*) FILTER (WHERE isinf(margin)), false FROM rates
    UNION ALL SELECT 'gap', count(*), count(*) - count(gap), count(*) FILTER (WHERE isinf(gap)), false FROM rates""",
)
def missing_infinite_report(spark, sf_dir):
    return quality.missing_report(_rates(spark, sf_dir)).select(
        "column", "n_rows", "n_missing", "n_infinite", "all_missing"
    )


@query(
    "schema_drift",
    """SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS n_rows, 2::BIGINT AS n_files,
              2::BIGINT AS n_column_sets, true AS drift""",
)
def schema_drift(spark, sf_dir):
    parts = files.file_schemas(spark, [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet"])
    return quality.merge_schemas(parts).drop("columns")


@query(
    "label_distribution",
    rounded(
        """SELECT event_type AS label, count(*) AS rows, count(*) / sum(count(*)) OVER () AS share
           FROM events GROUP BY 1""",
        "share",
    ),
)
def label_distribution(spark, sf_dir):
    return quality.label_distribution(table(spark, sf_dir, "events"), "event_type")


def _screened(spark, sf_dir):
    """lineitem with a constant, a rare flag, a mostly missing column and two repeated columns."""
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_tax",
        F.col("l_tax").alias("l_tax_again"),
        (F.col("l_quantity") >= 0).cast("int").alias("constant"),
        ((F.col("l_quantity") == 1) & (F.col("l_tax") == 0)).cast("int").alias("rare"),
        F.when((F.col("l_quantity") == 2) & (F.col("l_tax") == 0), "seen").alias("mostly_missing"),
        F.col("l_quantity").alias("l_quantity_again"),
    )


SCREENED_SQL = """screened AS (SELECT l_quantity, l_tax, l_tax AS l_tax_again,
    CAST(l_quantity >= 0 AS INTEGER) AS constant, CAST(l_quantity = 1 AND l_tax = 0 AS INTEGER) AS rare,
    CASE WHEN l_quantity = 2 AND l_tax = 0 THEN 'seen' END AS mostly_missing,
    l_quantity AS l_quantity_again FROM lineitem)"""


def _share_sql(column):
    return (
        f"SELECT '{column}' AS feature, max(n) / sum(n)::DOUBLE AS top_share "
        f"FROM (SELECT {column}, count(*) AS n FROM screened GROUP BY 1)"
    )


@query(
    "near_constant_columns",
    rounded(
        f"WITH {SCREENED_SQL} SELECT * FROM ("
        + " UNION ALL ".join(_share_sql(c) for c in ("l_quantity", "l_tax", "constant", "rare", "mostly_missing"))
        + ") WHERE top_share >= 0.99",
        "top_share",
    ),
)
def near_constant_columns(spark, sf_dir):
    df = _screened(spark, sf_dir).drop("l_tax_again", "l_quantity_again")
    return quality.near_constant(df, 0.99)


@query(
    "dominant_values",
    rounded(
        f"WITH {SCREENED_SQL} SELECT * FROM ("
        + " UNION ALL ".join(_share_sql(c) for c in ("l_quantity", "l_tax", "constant", "rare", "mostly_missing"))
        + ") WHERE top_share >= 0.1",
        "top_share",
    ),
)
def dominant_values(spark, sf_dir):
    df = _screened(spark, sf_dir).drop("l_tax_again", "l_quantity_again")
    return quality.near_constant(df, 0.1)


@query(
    "duplicate_columns",
    f"""WITH {SCREENED_SQL} SELECT "column", duplicate_of FROM (
        SELECT 'l_tax_again' AS "column", 'l_tax' AS duplicate_of, bool_and(l_tax IS NOT DISTINCT FROM l_tax_again) AS same FROM screened
        UNION ALL SELECT 'l_quantity_again', 'l_quantity', bool_and(l_quantity IS NOT DISTINCT FROM l_quantity_again) FROM screened
    ) WHERE same""",
)
def duplicate_columns(spark, sf_dir):
    return quality.duplicate_columns(_screened(spark, sf_dir))


@query(
    "feature_selection",
    f"""WITH {SCREENED_SQL}, dup AS (
          SELECT bool_and(l_tax IS NOT DISTINCT FROM l_tax_again) AS t, bool_and(l_quantity IS NOT DISTINCT FROM l_quantity_again) AS q FROM screened),
        con AS (SELECT feature FROM ({" UNION ALL ".join(_share_sql(c) for c in ("l_quantity", "constant", "mostly_missing"))}) WHERE top_share >= 0.999)
    SELECT 'drop_duplicate' AS operator, 'l_tax_again' AS "column" FROM dup WHERE t
    UNION ALL SELECT 'drop_duplicate', 'l_quantity_again' FROM dup WHERE q
    UNION ALL SELECT 'drop_near_constant', feature FROM con
    UNION ALL SELECT 'features', NULL""",
)
def feature_selection(spark, sf_dir):
    selection = quality.select_features(_screened(spark, sf_dir), ["l_tax", "rare"], threshold=0.999)
    duplicate = quality.select_features(_screened(spark, sf_dir).select("l_tax", "l_tax_again"), drop_near_constant=False)
    # The excluded original keeps its copy in the selection above; the second call drops the copy.
    return selection.log.unionByName(duplicate.log.where("operator = 'drop_duplicate'")).select("operator", "column")


@query(
    "decision_log",
    f"""WITH {RATES_SQL}
    SELECT 1::BIGINT AS step, 'handle_nan_inf' AS operator, NULL AS "column", count(*) FILTER (WHERE isinf(rate)) AS n_affected FROM rates
    UNION ALL SELECT 2, 'handle_nan_inf', NULL, count(*) FILTER (WHERE isinf(rate)) + count(*) - count(gap) FROM rates
    UNION ALL SELECT 3, 'validate_nonnegative', 'margin', count(*) FILTER (WHERE margin < 0) FROM rates
    UNION ALL SELECT 4, 'validate_nonnegative', 'absent', 0""",
)
def decision_log(spark, sf_dir):
    rates = _rates(spark, sf_dir)
    log = quality.decision_log(clean.nan_inf_log(rates), clean.nonnegative_log(rates, ["margin", "absent"]))
    return log.select("step", "operator", "column", "n_affected")


@query(
    "describe_column",
    rounded(
        """SELECT 'o_totalprice' AS "column", count(o_totalprice) AS count, avg(o_totalprice) AS mean,
             stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
             quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50,
             quantile_cont(o_totalprice, 0.75) AS p75, quantile_cont(o_totalprice, 0.9) AS p90,
             quantile_cont(o_totalprice, 0.99) AS p99 FROM orders""",
        "mean", "std", "min", "max", "p25", "p50", "p75", "p90", "p99",
    ),
)
def describe_column(spark, sf_dir):
    return quality.describe(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "inspection_report",
    f"""WITH {RATES_SQL} SELECT 'parquet' AS format, count(*) AS n_rows, 5::BIGINT AS n_columns,
        count(*) - count(gap) AS n_missing, count(*) FILTER (WHERE isinf(rate)) AS n_infinite FROM rates""",
)
def inspection_report(spark, sf_dir):
    report = quality.inspection_report(_rates(spark, sf_dir), [f"{sf_dir}/lineitem.parquet"], "parquet")
    total = lambda name: F.aggregate("missing", F.lit(0).cast("long"), lambda a, m: a + m[name])
    return report.select(
        "format", F.col("schema.n_rows").alias("n_rows"), F.col("schema.n_columns").alias("n_columns"),
        total("n_missing").alias("n_missing"), total("n_infinite").alias("n_infinite"),
    )


# Raw spellings stand in for the event types, so every branch of the canonical form is met.
SPELLINGS = {"view": "  BENIGN ", "click": "dos hulk", "purchase": "Web Attack - SQL", "signup": "New Class ", "error": ""}


def _spelled(spark, sf_dir):
    raw = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(s)) for e, s in SPELLINGS.items()])
    events = table(spark, sf_dir, "events")
    return events.withColumn("Label", F.when(F.col("value") >= 3, raw)).select("event_id", "Label")


SPELLED_SQL = """spelled AS (SELECT event_id, CASE WHEN value >= 3 THEN CASE event_type WHEN 'view' THEN '  BENIGN '
      WHEN 'click' THEN 'dos hulk' WHEN 'purchase' THEN 'Web Attack - SQL' WHEN 'signup' THEN 'New Class '
      WHEN 'error' THEN '' END END AS raw FROM events),
    named AS (SELECT event_id, raw, CASE WHEN raw IS NULL THEN 'NaN' WHEN trim(raw) = '' THEN ''
      WHEN lower(trim(raw)) = 'benign' THEN 'Benign' WHEN lower(trim(raw)) = 'dos hulk' THEN 'DoS Hulk'
      WHEN lower(raw) LIKE '%web attack%sql%' THEN 'Web Attack ' || chr(65533) || ' Sql Injection'
      ELSE trim(raw) END AS label_multiclass FROM spelled),
    labelled AS (SELECT *, CASE WHEN label_multiclass IN ('NaN', '') THEN NULL
      WHEN lower(label_multiclass) = 'benign' THEN 0 ELSE 1 END AS label_binary FROM named)"""


@query(
    "label_normalisation",
    f"""WITH {SPELLED_SQL} SELECT event_id, label_multiclass AS "Label", raw AS label_multiclass_raw, label_multiclass,
        label_binary::BIGINT AS label_binary FROM labelled""",
)
def label_normalisation(spark, sf_dir):
    return labels.normalize_labels(_spelled(spark, sf_dir), "Label")


@query(
    "label_canonical_forms",
    f"""WITH {SPELLED_SQL} SELECT label_multiclass, count(*) AS n FROM labelled GROUP BY 1""",
)
def label_canonical_forms(spark, sf_dir):
    return (
        _spelled(spark, sf_dir).groupBy(L.canonical_label(F.col("Label")).alias("label_multiclass"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "label_log",
    f"""WITH {SPELLED_SQL}
    SELECT 'stripped surrounding blanks' AS message, count(*) FILTER (WHERE raw <> trim(raw)) AS n_affected FROM labelled
    UNION ALL SELECT 'rewrote to the canonical spelling', count(*) FILTER (WHERE trim(raw) IS DISTINCT FROM label_multiclass) FROM labelled
    UNION ALL SELECT 'benign rows', count(*) FILTER (WHERE label_binary = 0) FROM labelled
    UNION ALL SELECT 'attack rows', count(*) FILTER (WHERE label_binary = 1) FROM labelled
    UNION ALL SELECT 'missing labels', count(*) FILTER (WHERE label_multiclass = 'NaN') FROM labelled
    UNION ALL SELECT 'blank labels left unknown', count(*) FILTER (WHERE label_multiclass = '') FROM labelled
    UNION ALL SELECT 'distinct canonical labels', count(DISTINCT label_multiclass) FROM labelled""",
)
def label_log(spark, sf_dir):
    return labels.label_log(labels.normalize_labels(_spelled(spark, sf_dir), "Label")).select("message", "n_affected")


@query(
    "label_mapping",
    f"""WITH {SPELLED_SQL} SELECT raw AS original_label, label_binary::BIGINT AS mapped_binary_label,
        label_multiclass AS mapped_multiclass_label, count(*) AS sample_count FROM labelled GROUP BY 1, 2, 3""",
)
def label_mapping(spark, sf_dir):
    return labels.label_mapping(labels.normalize_labels(_spelled(spark, sf_dir), "Label"))


@query(
    "custom_benign_labels",
    """SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END::BIGINT AS label_binary,
              count(*) AS n FROM events GROUP BY 1, 2""",
)
def custom_benign_labels(spark, sf_dir):
    named = labels.normalize_labels(table(spark, sf_dir, "events"), "event_type", ["View", " click "])
    return named.groupBy("event_type", "label_binary").agg(F.count(F.lit(1)).alias("n"))


def _policy_sql(policy, condition, value):
    return f"""SELECT '{policy}' AS policy, ({value})::BIGINT AS label_binary, count(*) AS n FROM events {condition} GROUP BY 1, 2"""


_BINARY = "CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END"


@query(
    "background_policy",
    " UNION ALL ".join(
        [
            _policy_sql("exclude", "WHERE event_type <> 'signup'", _BINARY),
            _policy_sql("treat_as_benign", "", f"CASE WHEN event_type = 'signup' THEN 0 ELSE {_BINARY} END"),
            _policy_sql("treat_as_malicious", "", f"CASE WHEN event_type = 'signup' THEN 1 ELSE {_BINARY} END"),
        ]
    ),
)
def background_policy(spark, sf_dir):
    named = labels.normalize_labels(table(spark, sf_dir, "events"), "event_type", ["view", "click"])
    parts = None
    for policy in labels.BACKGROUND_POLICIES:
        part = (
            labels.background_policy(named, "label_multiclass_raw", policy, ["signup"])
            .groupBy(F.lit(policy).alias("policy"), "label_binary").agg(F.count(F.lit(1)).alias("n"))
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query(
    "background_report",
    """SELECT count(*) AS n_total, count(*) FILTER (WHERE event_type = 'signup') AS n_background,
              count(*) FILTER (WHERE event_type <> 'signup') AS n_used, 'exclude' AS policy FROM events""",
)
def background_report(spark, sf_dir):
    return labels.background_report(table(spark, sf_dir, "events"), "event_type", "exclude", ["signup"])


@query(
    "family_labels",
    """SELECT coalesce(CASE WHEN value >= 10 THEN 'detail-' || event_type END, event_type) AS family, count(*) AS n
       FROM events GROUP BY 1""",
)
def family_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn(
        "detailedlabel", F.when(F.col("value") >= 10, F.concat(F.lit("detail-"), F.col("event_type")))
    )
    named = labels.family_label(labels.normalize_labels(events, "event_type"))
    return named.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nan_inf_cleaning",
    rounded(
        f"""WITH {RATES_SQL} SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE NOT isinf(rate)) AS n_rate,
            avg(rate) FILTER (WHERE NOT isinf(rate)) / 1000 AS mean_rate, count(gap) AS n_gap FROM rates GROUP BY 1""",
        "mean_rate",
    ),
)
def nan_inf_cleaning(spark, sf_dir):
    cleaned = clean.handle_nan_inf(_rates(spark, sf_dir))
    return cleaned.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("rate").alias("n_rate"),
        (F.avg("rate") / 1000).alias("mean_rate"), F.count("gap").alias("n_gap"),
    )


@query(
    "nonnegative_validation",
    rounded(
        f"""WITH {RATES_SQL} SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE margin >= 0) AS n_margin,
            avg(margin) FILTER (WHERE margin >= 0) AS mean_margin FROM rates GROUP BY 1""",
        "mean_margin",
    ),
)
def nonnegative_validation(spark, sf_dir):
    cleaned = clean.validate_nonnegative(_rates(spark, sf_dir), ["margin", "absent"])
    return cleaned.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("margin").alias("n_margin"), F.avg("margin").alias("mean_margin")
    )


@query(
    "numeric_coercion",
    """SELECT try_cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE left(o_orderpriority, 1) END AS DOUBLE) AS value,
              count(*) AS n FROM orders GROUP BY 1""",
)
def numeric_coercion(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.left("o_orderpriority", F.lit(1)))
    return table(spark, sf_dir, "orders").groupBy(coerce_number(text).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_medians",
    rounded(
        f"WITH {FLOWS} "
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, median({f}) AS median FROM train" for f in FEATURES),
        "median",
    ),
)
def train_medians(spark, sf_dir):
    return column_medians(train_side(flows(spark, sf_dir)), FEATURES)


@query(
    "column_medians_bracketed",
    rounded(
        f"WITH {FLOWS} "
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, median({f}) AS median FROM train" for f in FEATURES),
        "median",
    ),
)
def train_medians_bracketed(spark, sf_dir):
    """The way of long columns, which the test tables are too short to take by themselves."""
    return column_medians(train_side(flows(spark, sf_dir)), FEATURES, limit=1000)


@query(
    "quartiles_bracketed",
    rounded(
        f"WITH {FLOWS} "
        + " UNION ALL ".join(
            f"""SELECT l_returnflag, '{f}' AS feature, quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.5) AS q2,
                quantile_cont({f}, 0.75) AS q3 FROM flows GROUP BY 1"""
            for f in FEATURES
        ),
        "q1", "q2", "q3",
    ),
)
def quartiles_bracketed(spark, sf_dir):
    """Quartiles of each class by exact brackets."""
    return exact_quantiles(flows(spark, sf_dir), FEATURES, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["l_returnflag"], limit=1000)


@query(
    "median_imputation",
    rounded(
        f"""WITH {RATES_SQL}, m AS (SELECT median(gap) AS g, median(rate) FILTER (WHERE NOT isinf(rate)) AS r FROM rates)
        SELECT l_returnflag, avg(coalesce(gap, g)) AS gap, avg(CASE WHEN isinf(rate) THEN r ELSE rate END) / 1000 AS rate
        FROM rates, m GROUP BY 1""",
        "gap", "rate",
    ),
)
def median_imputation(spark, sf_dir):
    rates = clean.handle_nan_inf(_rates(spark, sf_dir))
    filled = clean.impute(rates, collect_medians(rates, ["gap", "rate"]))
    return filled.groupBy("l_returnflag").agg(F.avg("gap").alias("gap"), (F.avg("rate") / 1000).alias("rate"))


@query(
    "feature_name_keys",
    r"""SELECT DISTINCT name, array_to_string(list_transform(list_filter(
          string_split(regexp_replace(lower(name), '[\s/\\_\-.]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'of', 'the')),
          lambda w: CASE w WHEN 'packets' THEN 'pkts' WHEN 'bytes' THEN 'byts' WHEN 'length' THEN 'len'
                   WHEN 'total' THEN 'tot' WHEN 'destination' THEN 'dst' WHEN 'header' THEN 'hdr'
                   WHEN 'bulk' THEN 'blk' ELSE w END), '') AS key
       FROM (SELECT p_type || ' Total Length of ' || p_name || ' Packets/s' AS name FROM part)""",
)
def feature_name_keys(spark, sf_dir):
    name = F.concat("p_type", F.lit(" Total Length of "), "p_name", F.lit(" Packets/s"))
    names = table(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return names.select("name", feature_key_column(F.col("name")).alias("key"))


@query(
    "feature_mapping",
    """WITH f AS (SELECT DISTINCT 'Total Packets ' || p_size AS feature, 'totpkts' || p_size AS k FROM part),
            e AS (SELECT DISTINCT 'tot_pkts_' || s_nationkey AS external, 'totpkts' || s_nationkey AS k FROM supplier)
       SELECT feature, external, CASE WHEN feature IS NULL THEN 'unmapped_external'
              WHEN external IS NULL THEN 'unmapped_feature' ELSE 'mapped' END AS status FROM f FULL JOIN e USING (k)""",
)
def feature_mapping(spark, sf_dir):
    features = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("position"), F.concat(F.lit("Total Packets "), "p_size").alias("name")
    ).distinct()
    external = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("position"), F.concat(F.lit("tot_pkts_"), "s_nationkey").alias("name")
    ).distinct()
    return mapping.map_feature_tables(features, external)


def _foreign(spark, sf_dir):
    """lineitem under another dataset's names, with text numbers and infinite rates."""
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_quantity") > 45, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("Tot Fwd Pkts"),
        ieee_divide(F.col("l_extendedprice"), F.col("l_tax")).alias("Flow Byts/s"),
    )


FROZEN = ["Total Fwd Packets", "Flow Bytes/s", "Fwd IAT Mean"]
FROZEN_MEDIANS = {"Total Fwd Packets": 7.0, "Flow Bytes/s": 1234.5, "Fwd IAT Mean": 55.25}


@query(
    "mapped_features",
    rounded(
        """SELECT l_returnflag, count(*) AS n, avg(CASE WHEN l_quantity > 45 THEN 7 ELSE l_quantity END) AS packets,
             avg(CASE WHEN l_tax = 0 THEN 1234.5 ELSE l_extendedprice / l_tax END) / 1000 AS rate, avg(55.25) AS iat
           FROM lineitem GROUP BY 1""",
        "packets", "rate", "iat",
    ),
)
def mapped_features(spark, sf_dir):
    foreign = _foreign(spark, sf_dir)
    mapped = mapping.apply_mapping(
        foreign, mapping.map_features(FROZEN, foreign.columns), FROZEN_MEDIANS, keep=["l_returnflag"]
    )
    return mapped.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(FROZEN[0]).alias("packets"), (F.avg(FROZEN[1]) / 1000).alias("rate"), F.avg(FROZEN[2]).alias("iat"),
    )


@query(
    "sanitisation_counts",
    """SELECT count(*) FILTER (WHERE l_tax = 0) AS n_pos_inf_found, 0::BIGINT AS n_neg_inf_found,
         count(*) FILTER (WHERE l_tax = 0) AS n_inf_total_found,
         count(*) FILTER (WHERE l_quantity > 45) AS n_nan_found_before_imputation,
         count(*) FILTER (WHERE l_tax = 0) + count(*) FILTER (WHERE l_quantity > 45) AS n_values_imputed_with_training_medians
       FROM lineitem""",
)
def sanitisation_counts(spark, sf_dir):
    foreign = _foreign(spark, sf_dir)
    return mapping.sanitisation_counts(foreign, mapping.map_features(FROZEN, foreign.columns), FROZEN_MEDIANS)


@query(
    "feature_provenance",
    """SELECT 'Total Fwd Packets' AS feature, 'mapped' AS source, count(*) AS rows FROM lineitem
       UNION ALL SELECT 'Flow Bytes/s', 'mapped', count(*) FROM lineitem
       UNION ALL SELECT 'Fwd IAT Mean', 'training_median_imputed', count(*) FROM lineitem""",
)
def feature_provenance(spark, sf_dir):
    foreign = _foreign(spark, sf_dir)
    tags = mapping.map_features(FROZEN, foreign.columns).provenance()
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(s).alias("source")) for f, s in tags.items()])
    return foreign.select(F.inline(cells)).groupBy("feature", "source").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "connection_features",
    rounded(
        """WITH c AS (SELECT l_returnflag, l_tax * 1000000.0 AS flow_duration,
             CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE (l_extendedprice + l_quantity) / l_tax END AS bytes_rate,
             l_extendedprice / l_linenumber AS fwd_mean FROM lineitem)
           SELECT l_returnflag, avg(flow_duration) / 1000 AS flow_duration, count(*) FILTER (WHERE isinf(bytes_rate)) AS infinite,
             avg(bytes_rate) FILTER (WHERE NOT isinf(bytes_rate)) / 1000 AS bytes_rate, avg(fwd_mean) / 1000 AS fwd_mean,
             7::BIGINT AS features, 4::BIGINT AS skipped FROM c GROUP BY 1""",
        "flow_duration", "bytes_rate", "fwd_mean",
    ),
)
def connection_features(spark, sf_dir):
    logs = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.col("l_tax").alias("duration"), F.col("l_extendedprice").alias("orig_bytes"),
        F.col("l_quantity").alias("resp_bytes"), F.col("l_linenumber").alias("orig_pkts"),
    )
    df, report = mapping.flow_features_from_connections(logs)
    rate = F.col("Flow Bytes/s")
    return df.groupBy("l_returnflag").agg(
        (F.avg("Flow Duration") / 1000).alias("flow_duration"),
        F.count_if(F.abs(rate) == float("inf")).alias("infinite"),
        (F.avg(F.when(F.abs(rate) != float("inf"), rate)) / 1000).alias("bytes_rate"),
        (F.avg("Fwd Packet Length Mean") / 1000).alias("fwd_mean"),
        F.lit(len(report.direct) + len(report.derived)).alias("features"),
        F.lit(len(report.skipped)).alias("skipped"),
    )


@query(
    "shiftable_features",
    """SELECT 'Total Packets ' || p_size AS feature, count(*)::DOUBLE AS importance,
              p_size IN (SELECT s_nationkey FROM supplier) AS testable FROM part GROUP BY p_size""",
)
def shiftable_features(spark, sf_dir):
    importances = table(spark, sf_dir, "part").groupBy(
        F.concat(F.lit("Total Packets "), "p_size").alias("feature")
    ).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    return mapping.shiftable_features(importances, feature_mapping(spark, sf_dir))


@query(
    "finite_guard",
    f"""WITH {RATES_SQL} SELECT 'rate' AS feature, count(*) FILTER (WHERE isinf(rate)) AS n_not_finite FROM rates
        UNION ALL SELECT 'margin', count(*) - count(margin) FROM rates UNION ALL SELECT 'gap', count(*) - count(gap) FROM rates""",
)
def finite_guard(spark, sf_dir):
    return guards.nonfinite_counts(_rates(spark, sf_dir), ["rate", "margin", "gap"])


@query(
    "chosen_features",
    """SELECT 'feature' AS role, 'value' AS name, count(*) AS rows FROM events
       UNION ALL SELECT 'feature', 'user_id', count(*) FROM events
       UNION ALL SELECT 'identifier', 'Src IP', count(*) FROM events
       UNION ALL SELECT 'label', 'attack class', count(*) FROM events
       UNION ALL SELECT 'constant', 'fixed', count(*) FROM events
       UNION ALL SELECT 'duplicate', 'value again', count(*) FROM events""",
)
def chosen_features(spark, sf_dir):
    """Identifiers, second targets and constants are no features, copies leave the table, the rest is in order."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("Label"), "value", "user_id", F.col("event_id").alias("Src IP"), F.col("value").alias("value again"),
        F.lower("event_type").alias("attack class"), F.lit(1.0).alias("fixed"),
    )
    label = names.detect_label_column(events.columns)
    found = choose_features(events, label)
    guards.assert_feature_alignment(found.features, [c for c in events.columns if c in found.features])
    guards.assert_features_present(found.features, chosen=found.table)
    roles = {
        "feature": found.features, "identifier": names.identifier_like(events.columns),
        "label": names.label_like(events.columns, label), "duplicate": [c for c in events.columns if c not in found.table.columns],
    }
    named = {label, *(n for some in roles.values() for n in some)}
    roles["constant"] = [c for c in found.table.columns if c not in named]
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("name")) for r, some in roles.items() for n in some])
    return found.table.groupBy(F.lit(1)).agg(F.count(F.lit(1)).alias("rows")).select(F.inline(pairs), "rows")
