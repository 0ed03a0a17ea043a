"""Mixing sources to target weights by weighted sampling with exponential keys.

Each document draws a uniform number from a hash of its id; minus its logarithm over the
document's quality weight is its key, so that small keys are a weighted sample without
replacement. A source whose target is beyond its size is first taken whole, as often as
that goes; what is left of the target is filled in the order of the keys. The running sum
that decides it is taken in buckets of keys, so no source is sorted in one task. Everything
is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.session import settle


def word_count(text: str = "text") -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    trimmed = F.btrim(F.col(text).cast("string"), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    ).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Between 0.25 and 1 by the share of bytes that are letters, spaces, commas or full stops, or not ASCII."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    noise = F.octet_length(t) - F.octet_length(F.translate(t, "0123456789!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", ""))
    return 1 - 0.75 * noise / F.greatest(F.octet_length(t), F.lit(1))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row for each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a
    target ends at ``most`` times its source's size and the rest is shared out by weight again. In the order
    of size over weight the sources that reach their end come first, so one pass finds the final level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    turn = F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(order) - 1) % len(weights)]
    placed = sizes.withColumn("weight", turn).withColumn("most", most * F.col("source_size"))
    by_need = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        placed.withColumn("whole", share * F.sum("source_size").over(everything))
        .withColumn("ended", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("whole") - F.col("ended")) / F.col("sharing"))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    )
    final = level.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return final.select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7,
    bucket_rows: int = 4000, quality: Column | None = None,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each row of ``docs`` (doc_id, text, source).

    ``taken`` counts words with repeats: whole epochs first, then what is left of the target in the order of
    the keys; the document at the end of it gives a part. Null texts have size 0, null sources are a source of
    their own, repeated rows share a key and follow each other. ``quality`` is a positive weight column; by
    default that of :func:`quality_weight`.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    drawn = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count().alias("size"), (quality if quality is not None else quality_weight()).alias("weight"),
        ).withColumn("key", -F.log(uniform) / F.col("weight")),
        "mixing-keys",
    )
    sizes = drawn.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("weight").alias("mean_weight")
    )
    sizes = settle(sizes, "mixing-sizes")
    # one row for each source; written, so that Spark knows how small it is
    plan = settle(
        targets(sizes.select("source", "source_size"), weights, share, most).alias("t").join(
            sizes.alias("s"), F.expr("t.source <=> s.source")
        ).select(
            "t.source", "t.source_size", "t.target",
            F.when(F.col("t.source_size") > 0, F.floor(F.col("target") / F.col("t.source_size"))).otherwise(0).alias("epochs"),
            F.ceil(F.col("n") / bucket_rows).alias("buckets"), "mean_weight",
        ).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mixing-plan",
    ).withColumnRenamed("source", "of")
    cells = drawn.join(plan, F.expr("source <=> of")).withColumn(
        "bucket", F.floor(F.col("buckets") * (1 - F.exp(-F.col("key") * F.col("mean_weight")))).cast("int")
    )
    totals = settle(cells.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mixing-buckets")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    running = cells.withColumn(
        "inside", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = running.join(offsets, F.expr("source <=> in_source and bucket = in_bucket"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("inside")))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    )
