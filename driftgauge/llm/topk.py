"""Exact inner-product search in buckets of similar vector length.

Candidates are laid out in buckets by descending length. The longest bucket gives every
query a first threshold, its k-th best product there. For another bucket that threshold,
over the query's length and the bucket's longest vector, is the cosine a candidate must
reach: above 1 the bucket is skipped; where it is high, candidates are pruned by their
largest query coordinates, whose products and the lengths of what remains bound the cosine;
where it is low, by their own length. What is left is verified with exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgauge.llm.common import table_of
from driftgauge.session import settle

BLOCK = "block long, dim int, longest double, ids binary, norms binary, vectors binary"
_BLOCK = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64())] + [(c, pa.binary()) for c in ("ids", "norms", "vectors")]
)
#: Integer products below this are exact in double arithmetic.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, q, dim, norm)``: each component x as floor(scale * x). Vectors that are null or hold a null or a
    component that is not finite are left out."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.floor(scale * x))
    kept = vectors.where("embedding is not null and vec_id is not null").where(F.coalesce(whole, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q")).select(
        "vec_id", "q", F.size("q").alias("dim"),
        F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"),
    )


def _blocks(rows: int):
    def run(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal number, held
            ids, norms, q = zip(*held)
            out = table_of(
                _BLOCK, block=[(part << 32) + number], dim=[len(q[0])], longest=[max(norms)], ids=[np.asarray(ids, "<i8").tobytes()],
                norms=[np.asarray(norms, "<f8").tobytes()], vectors=[np.asarray(q, "<i8").tobytes()],
            )
            number, held = number + 1, []
            return out

        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "norm", "q"))):
                if last == row:
                    continue
                last = row
                if held and (len(held) == rows or len(row[2]) != len(held[0][2])):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


def _open(row: dict, tag: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{tag}ids"], "<i8")
    return ids, np.frombuffer(row[f"{tag}norms"], "<f8"), np.frombuffer(row[f"{tag}vectors"], "<i8").reshape(len(ids), -1)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact a @ b.T of integers; ``bound`` is no less than any product's size."""
    if bound < EXACT:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_block(
    q_ids, q_norms, queries, floors, ids, norms, vectors, k: int, focus: int = 8, steep: float = 0.6
) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the best k of one bucket for each query; candidates that can't reach the
    query's floor (a score that k others already have) are pruned before they are multiplied.

    The rows of a bucket are in descending order of length.
    """
    out = []
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    longest = float(norms.max(initial=0.0))
    slack = 1e-9
    for i in range(len(q_ids)):
        q, qn, floor = queries[i], q_norms[i], floors[i]
        keep = slice(None)
        if np.isfinite(floor) and qn > 0 and longest > 0 and floor > 0:
            local = floor / (qn * longest)
            if local > 1 + slack:
                continue
            if local >= steep:  # by coordinates: what the largest ones give, and what the rest can give at most
                at = np.argsort(-np.abs(q))[:focus]
                u = q / qn
                part = unit[:, at]
                rest = np.sqrt(np.maximum(0, 1 - (u[at] ** 2).sum())) * np.sqrt(np.maximum(0, 1 - (part**2).sum(1)))
                keep = np.flatnonzero((part @ u[at] + rest) * norms * qn >= floor * (1 - slack) - slack)
            else:  # by length
                keep = slice(0, int(np.searchsorted(-norms, -(floor / qn) * (1 - slack), side="right")))
        some = ids[keep]
        if not len(some):
            continue
        scores = products(q[None], vectors[keep], qn * longest * 1.01)[0]
        other = some != q_ids[i]
        some, scores = some[other], scores[other]
        out += [(int(q_ids[i]), int(some[j]), int(scores[j])) for j in best(some, scores, k)]
    return out


FOUND = "q_block long, query_id long, vec_id long, score long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("q_block", "query_id", "vec_id", "score")])


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, v = _open(row, "q_"), _open(row)
                known = dict(row.get("q_floors") or [])
                floors = np.asarray([known.get(i, -np.inf) for i in q[0].tolist()], float)
                found = search_block(*q, floors, *v, k)
                if found:
                    a, b, c = zip(*found)
                    yield table_of(_FOUND, q_block=[row["q_block"]] * len(a), query_id=a, vec_id=b, score=c)

    return run


def top_k(
    vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, bucket: int = 2048, query_block: int = 256
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors`` (vec_id, embedding) that satisfies the SQL
    condition ``is_query``, the ``k`` highest inner products with other rows, ties to the smaller vec_id.

    Rows of another dimension are no candidates. Vectors that are null or hold nulls or components that are not
    finite take no part; repeated rows count once and rows with the query's own id are its own. Components beyond
    2**31 after scaling are not meant. Queries and candidates meet in blocks of bounded size: each bucket is in
    one slot, and each block of queries visits all slots.
    """
    spark = vectors.sparkSession
    rows = settle(quantised(vectors, scale), "search-vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def laid_out(df, size, name):
        ordered = df.repartitionByRange(parts, "dim", F.col("norm").desc(), "vec_id").sortWithinPartitions(
            "dim", F.col("norm").desc(), "vec_id"
        )
        return settle(ordered.select("vec_id", "norm", "q").mapInArrow(_blocks(size), BLOCK), name)

    def meet(few, many):
        """Pairs of blocks of the same dimension: those of ``many`` dealt out once, those of ``few`` to all slots."""
        slot = F.pmod(F.xxhash64("q_block" if "q_block" in many.columns else "block"), F.lit(parts))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        there = few.withColumn("slot", every).repartition(parts, "slot")
        here = many.withColumn("slot", slot).repartition(parts, "slot")
        return here.join(there, (here["slot"] == there["slot"]) & (F.col("q_dim") == F.col("dim"))).drop("slot")

    buckets = laid_out(rows, bucket, "search-buckets")
    asked = laid_out(rows.where(is_query), query_block, "search-queries").select(
        F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
        F.col("norms").alias("q_norms"), F.col("vectors").alias("q_vectors"),
    )
    firsts = buckets.groupBy("dim").agg(F.min("block").alias("block"))  # one bucket for each dimension
    first = buckets.join(firsts, ["dim", "block"], "left_semi")
    began = settle(meet(first, asked).mapInArrow(_search(k), FOUND), "search-first")
    floors = _ranked(began, k).where(F.col("rank") == k).groupBy("q_block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", F.col("score").cast("double")))).alias("q_floors")
    )
    rest = buckets.join(firsts, ["dim", "block"], "left_anti")
    others = meet(asked.join(floors, "q_block", "left"), rest).mapInArrow(_search(k), FOUND)
    return _ranked(began.unionByName(others), k).drop("q_block")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "q_block", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
