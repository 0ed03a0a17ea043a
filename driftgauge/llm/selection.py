"""Stages of a corpus pipeline: each takes documents and returns documents, by an operator's decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm import decontaminate, mixing, quality_crf, simhash
from driftgauge.llm.common import text_bytes
from driftgauge.session import settle

#: Ids are sent to all tasks up to this number; more meet the documents in a shuffle, however small Spark takes their files for.
FEW = 1 << 20


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (doc_id). Rows with a null id stay."""
    named = settle(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "dropped-ids")
    return docs.join(_small(named), "doc_id", "left_anti").select(*docs.columns)


def keep_good(docs: DataFrame, model: quality_crf.LineCrf, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose quality is ``least`` or more."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        out, at, size, some = np.empty(len(texts)), 0, 0, []
        for i, t in enumerate(texts):
            some.append(t)
            size += len(t)
            if size > 1 << 20 or i == len(texts) - 1:
                out[at : i + 1] = quality_crf.score_texts(some, model)[0]
                at, size, some = i + 1, 0, []
        return pd.Series(out)

    return docs.where(quality(text_bytes()) >= least)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, once if it is repeated.

    Rows with a null id can't be named and stay. Near-duplicates differ in 2 bits of 64 at most, over 3-word shingles;
    most pairs of a Jaccard similarity of 0.8 to 0.95 on five words differ in more and both stay.
    """
    groups = settle(simhash.near_duplicates(docs).select("doc_id", "component_id"), "near-duplicates")
    kept = without(docs, groups.where("doc_id <> component_id"))
    again = settle(
        groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"),
        "repeated-ids",
    )
    if again.isEmpty():
        return kept
    repeated = kept.join(_small(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return without(kept, again).unionByName(repeated)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that no benchmark item contaminates."""
    report = decontaminate.contaminated(decontaminate.benchmark_matches(docs, benchmark, with_places=False))
    return without(docs, report.where("contaminated").select("doc_id"))


def mixed(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; a document taken in part is there in whole."""
    taken = mixing.mix(docs).where("taken > 0").groupBy("doc_id").agg(F.ceil(F.sum("taken") / F.sum("size")).cast("int").alias("copies"))
    copies = settle(taken.withColumnRenamed("doc_id", "id"), "mixing-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no column can clash
    joined = rows.join(_small(copies), F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
