"""Schema inspection, data-quality reports and feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgauge.functions import names
from driftgauge.functions.numeric import is_fractional, is_infinite, is_missing, is_numeric, ratio
from driftgauge.operators.order_stats import exact_quantiles
from driftgauge.session import literal_table

NEAR_CONSTANT_SHARE = 0.999


def _by_column(aggregates: dict[str, dict[str, Column]], df: DataFrame, n_rows: bool = True) -> DataFrame:
    """Run aggregates for many columns in one job and lay them out one row per column."""
    wide = []
    for i, measures in enumerate(aggregates.values()):
        wide += [expr.alias(f"m{i}_{name}") for name, expr in measures.items()]
    one_row = df.agg(F.count(F.lit(1)).alias("n_rows"), *wide)
    rows = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(i).alias("position"),
            *[F.col(f"m{i}_{name}").alias(name) for name in measures],
        )
        for i, (column, measures) in enumerate(aggregates.items())
    ]
    return one_row.select(*(["n_rows"] if n_rows else []), F.inline(F.array(*rows)))


def schema_report(df: DataFrame, header: Sequence[str] | None = None) -> DataFrame:
    """One row: counts, columns, types, repeated and unnamed columns, detected label, notes.

    ``header`` is the header as written in the file; pass it for CSV, where the
    reader has already renamed repeated columns.
    """
    columns = list(header or df.columns)
    repeated, unnamed = names.repeated(columns), names.unnamed_columns(columns)
    label = names.detect_label_column(columns)
    notes = []
    if label is None:
        notes.append("no label column found by name")
    if repeated:
        notes.append(f"repeated column names: {repeated}")
    if unnamed:
        notes.append(f"unnamed columns: {unnamed}")

    def strings(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(columns)).cast("long").alias("n_columns"),
        strings(columns).alias("columns"),
        strings([f.dataType.simpleString() for f in df.schema]).alias("dtypes"),
        F.lit(label).cast("string").alias("detected_label_column"),
        strings(repeated).alias("duplicate_columns"),
        strings(unnamed).alias("unnamed_columns"),
        strings(notes).alias("notes"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Missing and infinite counts of every column; infinities are 0 for non-numeric columns."""
    aggregates = {}
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        infinite = F.count_if(is_infinite(column)) if is_fractional(field.dataType) else F.lit(0).cast("long")
        aggregates[field.name] = {
            "n_missing": F.count_if(is_missing(column, field.dataType)),
            "n_infinite": infinite,
        }
    return _by_column(aggregates, df).withColumn(
        "all_missing", (F.col("n_missing") == F.col("n_rows")) & (F.col("n_rows") > 0)
    )


def schema_drift(spark, reports: Sequence[tuple[str, Sequence[str], int]]) -> DataFrame:
    """Merge per-file schemas ``(file, columns, rows)``: rows summed, differing column lists noted."""
    if not reports:
        raise ValueError("no schemas to merge")
    files = literal_table(
        spark, [(f, list(c), int(n)) for f, c, n in reports], "file string, columns array<string>, rows bigint"
    )
    return merge_schemas(files)


def merge_schemas(files: DataFrame) -> DataFrame:
    """``(file, columns, rows)`` reduced to one row; the first file by name gives the columns."""
    return files.agg(
        F.sum("rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_files"),
        F.min_by("columns", "file").alias("columns"),
        F.count_distinct("columns").alias("n_column_sets"),
    ).withColumn("drift", F.col("n_column_sets") > 1)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def _candidate(column: Column, dtype: T.DataType) -> Column:
    """A number that tells the column's values apart; used to find a majority value."""
    return column.cast("double") if is_numeric(dtype) else F.xxhash64(column).cast("double")


def near_constant(
    df: DataFrame,
    threshold: float = NEAR_CONSTANT_SHARE,
    primary_label: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Columns whose most frequent value (missing counts as one) has a share of at least ``threshold``.

    Identifier-like and label-like columns are skipped. Returns ``(feature, top_share)``.

    A value holding more than half of the present rows is their median, so above
    one half the candidate comes from a quantile sketch and is then counted
    exactly: two scans, no shuffle of values. Lower thresholds count all values.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must lie between 0 and 1, got {threshold!r}")
    chosen = list(columns or df.columns)
    skipped = set(names.identifier_like(chosen)) | set(names.label_like(chosen, primary_label))
    fields = [df.schema[c] for c in chosen if c not in skipped]
    fields = [f for f in fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if threshold <= 0.55 or not fields:
        return _top_shares(df, fields).where(F.col("top_share") >= threshold)

    def value_of(field):
        column = F.col(f"`{field.name}`")
        return F.when(~is_missing(column, field.dataType), column)

    sketch = df.agg(
        *[
            F.percentile_approx(_candidate(value_of(f), f.dataType), 0.5, 1000).alias(f"c{i}")
            for i, f in enumerate(fields)
        ]
    ).first()
    aggregates = {}
    for i, field in enumerate(fields):
        value = value_of(field)
        same = _candidate(value, field.dataType) == F.lit(sketch[i])
        # Equal extremes prove that the candidate stands for a single value.
        one_value = F.min(F.when(same, value)).eqNullSafe(F.max(F.when(same, value)))
        aggregates[field.name] = {
            "hits": F.count_if(same),
            "missing": F.count_if(value.isNull()),
            "one_value": one_value,
        }
    counted = _by_column(aggregates, df)
    unclear = [r["column"] for r in counted.where("NOT one_value").collect()]
    clear = counted.where("one_value").select(
        F.col("column").alias("feature"), ratio(F.greatest("hits", "missing"), F.col("n_rows")).alias("top_share")
    )
    if unclear:
        clear = clear.unionByName(_top_shares(df, [df.schema[c] for c in unclear]))
    return clear.where(F.col("top_share") >= threshold)


def _top_shares(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(f.name).alias("feature"),
            F.when(~is_missing(F.col(f"`{f.name}`"), f.dataType), F.col(f"`{f.name}`"))
            .cast("string").alias("value"),
        )
        for f in fields
    ]
    if not cells:
        return literal_table(df.sparkSession, [], "feature string, top_share double")
    counts = df.select(F.inline(F.array(*cells))).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy("feature").agg(ratio(F.max("rows"), F.sum("rows")).alias("top_share"))


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, duplicate_of)``: later columns equal to an earlier one of the same type in every row.

    Order-free signatures of all columns come from one scan; only columns with
    equal signatures are compared value by value, in a second scan.
    """
    chosen = list(columns or df.columns)
    fields = [df.schema[c] for c in chosen]
    signature_of = []
    for i, field in enumerate(fields):
        code = F.xxhash64(F.col(f"`{field.name}`"))
        signature_of += [
            F.sum(code.bitwiseAND(F.lit(0xFFFFF))).alias(f"s{i}"),
            F.bit_xor(code).alias(f"x{i}"),
        ]
    row = df.agg(*signature_of).first()
    groups: dict[tuple, list[str]] = {}
    for i, field in enumerate(fields):
        key = (row[f"s{i}"], row[f"x{i}"], field.dataType.simpleString())
        groups.setdefault(key, []).append(field.name)
    pairs = [(a, b) for group in groups.values() for j, b in enumerate(group) for a in group[:j]]
    schema = "column string, duplicate_of string"
    if not pairs:
        return literal_table(df.sparkSession, [], schema)
    equal = df.agg(
        *[
            F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    ).first()
    first: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if equal[i]:
            first.setdefault(b, a)
    found = [(b, first[b]) for b in chosen if b in first]
    return literal_table(df.sparkSession, found, schema)


@dataclass(frozen=True)
class FeatureSelection:
    table: DataFrame
    features: list[str]
    log: DataFrame


def select_features(
    df: DataFrame,
    exclude: Sequence[str] = (),
    drop_duplicates: bool = True,
    drop_near_constant: bool = True,
    threshold: float = NEAR_CONSTANT_SHARE,
) -> FeatureSelection:
    """Drop duplicate, then near-constant columns; excluded columns stay but are no features.

    Decided once on the whole table, so the outcome does not depend on how it is split.
    """
    excluded = set(exclude)
    entries: list[tuple[str, str | None, str]] = []
    candidates = [c for c in df.columns if c not in excluded]
    dropped: list[str] = []
    if drop_duplicates:
        for r in duplicate_columns(df, candidates).collect():
            dropped.append(r["column"])
            entries.append(("drop_duplicate", r["column"], f"equal to {r['duplicate_of']}"))
    if drop_near_constant:
        left = [c for c in candidates if c not in dropped]
        share = {r["feature"]: r["top_share"] for r in near_constant(df, threshold, columns=left).collect()} if left else {}
        for c in left:
            if c in share:
                dropped.append(c)
                entries.append(("drop_near_constant", c, f"top share {share[c]:.6f}"))
    for c in exclude:
        if c not in df.columns:
            entries.append(("exclude_absent", c, "not in the table"))
    features = [c for c in candidates if c not in dropped]
    entries.append(("features", None, f"{len(features)} features, {len(dropped)} dropped"))
    log = literal_table(
        df.sparkSession,
        [(i, step, column, message) for i, (step, column, message) in enumerate(entries)],
        "step int, operator string, column string, message string",
    )
    return FeatureSelection(df.drop(*dropped), features, log)


def decision_log(*parts: DataFrame) -> DataFrame:
    """Cleaning decisions ``(step, operator, column, n_affected, message)``, numbered from 1 in the order given;
    a part's own ``step`` orders its rows, else they stay as they are. A log has a row for each decision."""
    merged = None
    for i, part in enumerate(parts):
        own = F.col("step").cast("long") if "step" in part.columns else F.monotonically_increasing_id()
        part = part.withColumns({"step": own, "part": F.lit(i)})
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.orderBy("part", "step"))
    return merged.select("*", place.alias("_place")).drop("step").withColumnRenamed("_place", "step")


def describe(df: DataFrame, column: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """count, mean, std, min, chosen percentiles and max of one column."""
    named = {f"p{round(q * 100)}": q for q in quantiles}
    value = F.col(f"`{column}`").cast("double")
    sums = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).withColumn("feature", F.lit(column))
    return sums.join(exact_quantiles(df, [column], named), "feature").withColumnRenamed("feature", "column")


def inspection_report(df: DataFrame, files: Sequence[str], file_format: str) -> DataFrame:
    """One row: files, format, schema report and the missing/infinite counts of the whole table."""
    schema = schema_report(df).select(F.struct("*").alias("schema"))
    counts = missing_report(df).agg(
        F.array_sort(F.collect_list(F.struct("position", "column", "n_missing", "n_infinite"))).alias("missing")
    )
    return schema.crossJoin(counts).select(
        F.array(*[F.lit(f) for f in files]).cast("array<string>").alias("files"),
        F.lit(file_format).alias("format"),
        "schema",
        "missing",
    )
