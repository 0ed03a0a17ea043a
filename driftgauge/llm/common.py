"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.session import settle


#: Rows and bytes of the batches that go to Python workers; a task holds several copies of a batch on its way.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark) -> None:
    """Bounds the session's Arrow batches, so that long texts need no more memory than short ones."""
    for key, value in BATCH.items():
        spark.conf.set(key, str(value))


def read(spark, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def kept_in_worker(key, make: Callable):
    """``make()`` once for each Python worker process.

    Functions travel with their code, so their module's globals are new in each task;
    what is dear to build (a tokenizer, a cache of its results) is kept beside them.
    """
    store = sys.modules.setdefault("driftgauge_worker_store", types.ModuleType("driftgauge_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def ranked_in_groups(nodes: DataFrame, order: list) -> DataFrame:
    """``nodes`` (grp, …) with ``rank`` from 0 in their group by ``order`` and ``size``, the group's nodes.

    Rows are dealt out by ranges of the whole order, so a large group is spread over many tasks; a row's
    place is its number in its task and the number of its group's rows in the tasks before.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        nodes.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order).withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33)),
        "rank-order",
    )
    seen = placed.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    of_group = Window.partitionBy("grp").orderBy("part")
    before = F.sum("here").over(of_group.rowsBetween(Window.unboundedPreceding, -1))
    offsets = settle(
        seen.select(
            "grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("here").over(Window.partitionBy("grp")).alias("size"),
        ),
        "rank-offsets",
    )  # a row for each group in each task that holds some of it
    ranked = placed.join(offsets, ["grp", "part"]).withColumn("rank", F.col("place") + F.col("shift"))
    return ranked.drop("place", "part", "shift")


def in_pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes at most in each; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.fromiter(
            (0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()),
            np.int64, batch.num_rows,
        )
        start = size = 0
        for i, n in enumerate(sizes):
            if size + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on; what a task no longer needs goes back


def table_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
