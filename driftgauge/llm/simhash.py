"""SimHash near-duplicates by deletion variants.

With ``k`` differing bits allowed, a fingerprint is cut into fewer than k+1 segments, so
that one segment of two linked fingerprints differs by at most one bit: for k = 2, two
halves. Each half is indexed under its 32 variants with one bit deleted; two halves that
differ by one bit or none share a variant. Variants are joined on equality and verified on
all 64 bits. A variant that very many fingerprints share is not joined with itself: its
members are opened into variants with two bits deleted over the whole fingerprint, and
members of one such group are linked by construction, so a star of each group keeps every
link's connectivity without listing pairs.

All joins name their way, a shuffle: Spark takes a table's size from its files and the width of its rows, so a few
MB of fingerprints opened into 64 or 2 016 rows each would go to the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import in_pieces, table_of, text_bytes
from driftgauge.llm.components import connected_components
from driftgauge.session import settle

HALF = 32


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The majority bit of the shingles' hashes, bit by bit; repeats count; 0 without words.

    Words are what stands between ASCII white space, A-Z lower-cased; fewer words than a shingle are one.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)) :][:n] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        ones += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 1 << 20):
            found = np.asarray([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield table_of(out, doc_id=batch.column("doc_id"), fp=found.view(np.int64))

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed 64-bit integer. Null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        _fingerprints(shingle, seed), "doc_id long, fp long"
    )


def deletion_variants(prints: DataFrame) -> DataFrame:
    """``(node, fp, half, at, variant)``: each half of ``fp`` with one of its bits deleted."""
    halves = prints.select("node", "fp", F.posexplode(F.array(F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)"))).alias("half", "bits"))
    positions = F.array(*[F.lit(i) for i in range(HALF)])
    return halves.select("node", "fp", "half", "bits", F.explode(positions).alias("at")).select(
        "node", "fp",
        # half, place of the deleted bit and the other bits in one number
        F.expr(
            "shiftleft(cast(half * 32 + at as long), 32) | (bits & ~shiftleft(1L, at))"
        ).alias("variant"),
    )


def _pairs_below(shared: DataFrame, bits: int) -> DataFrame:
    left = shared.select("variant", F.col("node").alias("a"), F.col("fp").alias("fa"))
    right = shared.select("variant", F.col("node").alias("b"), F.col("fp").alias("fb"))
    return left.join(right.hint("merge"), "variant").where(f"a < b and bit_count(fa ^ fb) <= {bits}").select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """Links between ``members``: fingerprints that agree but for two deleted bits are linked to the least."""
    masks = np.asarray([(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64).view(np.int64)
    opened = members.select(
        "node", "fp", F.posexplode(F.array(*[F.lit(int(m)) for m in masks])).alias("place", "mask")
    ).select("node", "place", F.expr("fp & ~mask").alias("rest"))
    groups = opened.groupBy("place", "rest").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    return opened.join(groups.hint("merge"), ["place", "rest"]).where("a < node").select("a", F.col("node").alias("b"))


def links(prints: DataFrame, hot: int = 64) -> DataFrame:
    """``(a, b)``, a < b: links that connect what fingerprints at 2 or fewer differing bits connect.

    ``prints`` (node, fp) has one row for each distinct fingerprint. Variants shared by more than ``hot``
    fingerprints are opened instead of joined.
    """
    variants = deletion_variants(prints)
    size = settle(variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1"), "variant-sizes")
    shared = settle(variants.join(size.hint("merge"), "variant").select("variant", "node", "fp", "n"), "shared-variants")
    found = _pairs_below(shared.where(F.col("n") <= hot), 2)
    many = shared.where(F.col("n") > hot).select("node", "fp").distinct()
    if not many.isEmpty():
        found = found.unionByName(_stars(many))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, hot: int = 64) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of 2 or fewer differing bits. Null texts are
    empty (fingerprint 0). Rows with a null doc_id take part; their component is the smallest id that is
    there, or null if none is.
    """
    prints = settle(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    # a fingerprint is its own node number; components carry the smallest node, mapped to ids below
    edges = settle(links(distinct.select(F.col("fp").alias("node"), "fp"), hot), "fingerprint-links")
    component = connected_components(edges)
    placed = settle(
        distinct.join(component.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        ),
        "placed-fingerprints",
    )
    least = settle(placed.groupBy("component").agg(F.min("least").alias("component_id")), "least-ids")
    by_print = settle(placed.join(least.hint("merge"), "component").select("fp", "component_id"), "fingerprint-components")
    return prints.join(by_print.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is its component's id; rows with a null id that no group names stay."""
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id is null"))
