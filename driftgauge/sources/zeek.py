"""Connection logs with ``#separator`` and ``#fields`` headers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.session import settle, small_table

LOG_PATTERN = "*.conn-labeled.log"
SKIPPED_FOLDER = "_macros"
MISSING_MARKS = ("-", "(empty)")


@dataclass(frozen=True)
class ConnectionLogs:
    table: DataFrame
    report: DataFrame


def _decoded(separator: Column) -> Column:
    """``\\x09``-style escapes as the character they stand for."""
    code = F.regexp_extract(separator, r"^\\x([0-9a-fA-F]{2})$", 1)
    return (
        F.when(code != "", F.unhex(code).cast("string"))
        .when(separator == "\\t", F.lit("\t"))
        .otherwise(separator)
    )


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """``(value, source_file, block, line)``: a line, the start of the file split it is in, and its place there."""
    try:
        lines = (
            spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
            .select(
                "value",
                F.col("_metadata.file_path").alias("source_file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            )
            .where(~F.array_contains(F.split(F.lower("source_file"), "/"), SKIPPED_FOLDER))
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return lines.withColumn("value", F.regexp_replace("value", "\r$", ""))


def _fields(line: Column, separator: Column) -> Column:
    """The names in a ``#fields`` line."""
    text = F.substring(line, F.lit(8), F.length(line))
    after = F.when(F.startswith(text, separator), F.substring(text, F.length(separator) + 1, F.length(line))).otherwise(F.ltrim(text))
    return F.split(after, _quoted(separator))


def _quoted(separator: Column) -> Column:
    return F.concat(F.lit("\\Q"), separator, F.lit("\\E"))


def _separator_of_line() -> Column:
    """What a ``#separator`` line sets; NULL for other lines."""
    return F.when(F.col("value").startswith("#separator"), _decoded(F.trim(F.expr("substring(value, 11)"))))


def _places(splits: DataFrame) -> DataFrame:
    """One row for each file split: the ``separator`` and ``fields`` that the splits before left (``carried``) and that it
    leaves itself (``left``), all its ``#fields`` lines (``headers``), and whether a header stands below data (``midway``).

    Header lines are ordered inside their split; only one row for each split is ordered inside a file.
    """
    split = ["source_file", "block"]
    inside = Window.partitionBy(*split).orderBy("line")
    events = splits.select(*split, F.inline_outer("events")).withColumn(
        "separator", F.last(_separator_of_line(), ignorenulls=True).over(inside)
    )
    header = F.when(F.col("value").startswith("#fields"), F.struct("value", "separator"))
    here = events.groupBy(*split).agg(
        F.max_by("separator", F.when(F.col("separator").isNotNull(), F.col("line"))).alias("separator"),
        F.max_by(header, F.when(header.isNotNull(), F.col("line"))).alias("header"),
        F.collect_set(header).alias("headers"),
        F.max("line").alias("last_header"),
    )
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parted = here.withColumn("carried_separator", F.coalesce(F.last("separator", ignorenulls=True).over(before), F.lit("\t")))
    named = lambda h: _fields(h["value"], F.coalesce(h["separator"], F.col("carried_separator")))
    named_last = parted.withColumn("fields", F.when(F.col("header").isNotNull(), named(F.col("header"))))
    carried = named_last.withColumn("carried_fields", F.last("fields", ignorenulls=True).over(before))
    return carried.join(splits.select(*split, "first_data"), split).select(
        *split, "first_data",
        F.coalesce(F.col("last_header") > F.col("first_data"), F.lit(False)).alias("midway"),
        F.struct(F.col("carried_separator").alias("separator"), F.col("carried_fields").alias("fields")).alias("carried"),
        F.struct(
            F.coalesce("separator", "carried_separator").alias("separator"), F.coalesce("fields", "carried_fields").alias("fields")
        ).alias("left"),
        F.array_distinct(F.flatten(F.transform("headers", named))).alias("names"),
    )


def read_connection_logs(spark: SparkSession, folder: str, pattern: str = LOG_PATTERN) -> ConnectionLogs | None:
    """All logs below a folder as one table of strings, fields resolved by name.

    A log may change its ``#fields`` and ``#separator`` midway: each line is read by the last ones above it. A first job
    gathers the header lines by file split and says what each split finds and leaves. Lines of a split without headers below
    its data all have one header and stay where they are; those of other splits are ordered inside their split, so that the last
    header passes down. The work grows with the lines, however many headers there are. A line with the wrong number of
    fields, or one that precedes its header, stops the job. Returns None if there is no log.

    Both jobs must cut the files alike: a split that the first job did not see, or one whose data do not start where
    they did, stops the second.
    """
    lines = _lines(spark, folder, pattern)
    if lines is None:
        return None
    is_data = (F.col("value") != "") & ~F.col("value").startswith("#")
    is_header = F.col("value").startswith("#fields") | F.col("value").startswith("#separator")
    splits = settle(
        lines.groupBy("source_file", "block").agg(
            F.collect_list(F.when(is_header, F.struct("line", "value"))).alias("events"),
            F.min(F.when(is_data, F.col("line"))).alias("first_data"),
            F.min(F.when(F.col("value").startswith("#fields"), F.col("line"))).alias("first_fields"),
            F.count_if(is_data).alias("n_rows"),
        ),
        "log-splits",
    )
    places = settle(_places(splits), "log-places")
    place = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("block", c)))
    files = splits.groupBy("source_file").agg(
        F.sum("n_rows").alias("n_rows"), place("first_data").alias("data"), place("first_fields").alias("fields")
    )
    facts = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"),
        F.count_if(F.col("data").isNotNull() & (F.col("fields").isNull() | (F.col("data") < F.col("fields")))).alias("early"),
    ).first()
    if not facts["files"]:
        return None
    if facts["early"]:
        raise ValueError(f"{facts['early']} logs hold data before their #fields line")

    names = sorted(r[0] for r in places.select(F.explode("names")).distinct().collect())
    kinds = {r[0] for r in places.select("midway").distinct().collect()}
    known = lines.where(is_data | is_header).join(small_table(places.drop("names")), ["source_file", "block"], "left")
    misplaced = F.when(is_header, F.col("line") > F.col("first_data")).otherwise(~F.coalesce(F.col("line") >= F.col("first_data"), F.lit(False)))
    moved = F.col("carried").isNull() | (~F.col("midway") & F.coalesce(misplaced, F.lit(False)))
    checked = known.where(
        F.when(moved, F.raise_error(F.lit("file splits changed between two jobs over the logs")).cast("boolean")).otherwise(True)
    )
    parts = []
    if kinds != {True}:
        calm = checked.where(is_data & ~F.coalesce("midway", F.lit(False)))
        parts.append(calm.select("source_file", "value", "left.separator", "left.fields"))
    if True in kinds:
        above = Window.partitionBy("source_file", "block").orderBy("line")
        changing = checked.where(F.coalesce("midway", F.lit(True))).select(
            "source_file", "block", "line", "value", "carried",
            F.coalesce(F.last(_separator_of_line(), ignorenulls=True).over(above), F.col("carried.separator")).alias("separator"),
        )
        own = F.when(F.col("value").startswith("#fields"), _fields(F.col("value"), F.col("separator")))
        fields = F.coalesce(F.last(own, ignorenulls=True).over(above), F.col("carried.fields"))
        parts.append(changing.withColumn("fields", fields).where(is_data).select("source_file", "value", "separator", "fields"))
    placed = reduce(DataFrame.unionByName, parts)
    cut = placed.select("source_file", "fields", F.split("value", _quoted(F.col("separator")), -1).alias("values"))
    refused = F.raise_error(
        F.concat(
            F.lit("malformed line in "), F.col("source_file"), F.lit(": expected "),
            F.size("fields").cast("string"), F.lit(" fields, got "), F.size("values").cast("string"),
        )
    )
    whole = F.size("fields") == F.size("values")
    # as a filter the check can't be pruned with the columns that nobody reads
    parsed = cut.where(F.when(whole, F.lit(True)).otherwise(refused.cast("boolean"))).withColumn(
        "cells", F.map_from_arrays("fields", "values")
    )

    def cell(name: str) -> Column:
        value = F.try_element_at(F.col("cells"), F.lit(name))
        return F.when(~value.isin(*MISSING_MARKS), value).alias(name)

    report = cut.agg(F.count_if(~whole).alias("malformed_rows")).select(
        F.lit(facts["files"]).cast("long").alias("files_parsed"), F.lit(facts["rows"]).cast("long").alias("rows_read"), "malformed_rows"
    )
    return ConnectionLogs(parsed.select("source_file", *[cell(n) for n in names]), report)
