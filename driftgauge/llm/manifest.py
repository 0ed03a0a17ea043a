"""Merkle manifest of a dataset by nested-struct rollup.

Leaves are ranked inside their group and dealt into blocks of ``fanout ** digits`` neighbours. In a block
the digit columns of the rank are grouped away one after the other, the last digit first: each step puts
the structs of a run into an array inside the struct of their parent, whose digest is that of its children.
All steps of a block happen on one shuffle, since blocks are what rows are dealt out by. The tops of
the blocks are the leaves of the next tier, until every group has one node; the nodes of all groups, in
their order, are rolled up likewise. Then the nested arrays are turned inside out: each level hands its
siblings' digests to its children, and an explode emits one row for each leaf with the whole path.
What a block needs from the tiers above meets it in a union that is grouped by block, one row for each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import ranked_in_groups
from driftgauge.session import settle

LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a path: the digests of a node's siblings to its left and to its right, joined.
STEP = "struct<left: string, right: string>"
#: What every leaf of a group is told besides its path.
KNOWN = "struct<subroot: string, root: string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value for hashing: its UTF-8 byte count, a colon and its text; ``-`` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(lang: Column) -> Column:
    """A language as a string that is never null and orders null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def fold(start: Column, path: Column) -> Column:
    """The digest at the end of a path that begins at ``start``."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, from left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), "")


def _blocks(nodes: DataFrame, payload: list[str], fanout: int, digits: int) -> DataFrame:
    """Blocks of ``nodes`` (grp, rank, size, h, …): ``(grp, block, size, h, kids)``.

    ``size`` is the number of nodes of the group at the blocks' lowest level; a level that has one node left
    is not hashed again.
    """
    span = fanout**digits
    dealt = nodes.select(
        "grp", F.expr(f"rank div {span}").alias("block"), "size",
        *[F.expr(f"cast(rank div {fanout**i} % {fanout} as int)").alias(f"d{i}") for i in range(digits)],
        F.struct("h", *payload).alias("node"),
    ).repartition("grp", "block")
    for i in range(digits):
        rest = [f"d{j}" for j in range(i + 1, digits)]
        run = F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("d"), "node")))
        kids = F.transform("run", lambda k: k["node"])
        joined = F.array_join(F.transform("run", lambda k: k["node"]["h"]), "")
        more = F.col("size") > fanout**i  # whether this level has more than one node in the group
        dealt = dealt.groupBy("grp", "block", "size", *rest).agg(run.alias("run")).select(
            "grp", "block", "size", *rest,
            F.struct(F.when(more, digest(joined)).otherwise(F.element_at("run", 1)["node"]["h"]).alias("h"), kids.alias("kids")).alias("node"),
        )
    return dealt.select("grp", "block", "size", F.col("node.h").alias("h"), F.col("node.kids").alias("kids"))


def _handed_down(below: str, more: Column, fanout: int):
    """From a node (kids, path) to its children (``below``, path): they have its path behind their own siblings."""

    def children(x: Column) -> Column:
        hashes = F.transform(x["kids"], lambda k: k["h"])

        def child(k: Column, i: Column) -> Column:
            step = F.struct(
                F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
                F.array_join(F.slice(hashes, i + 2, F.lit(fanout)), "").alias("right"),
            )
            path = F.when(more, F.concat(F.array(step), x["path"])).otherwise(x["path"])
            return F.struct((k["kids"] if below == "kids" else k).alias(below), path.alias("path"))

        return F.transform(x["kids"], child)

    return children


def _paths(blocks: DataFrame, fanout: int, digits: int) -> DataFrame:
    """One row for each node of the blocks' lowest level, ``(grp, block, position, node, path, known)``, of ``blocks`` with
    ``path``, what is above them, and ``known``."""
    at = F.array(F.struct("kids", "path"))
    for level in reversed(range(digits)):
        more = F.col("size") > F.lit(fanout**level)
        at = F.flatten(F.transform(at, _handed_down("kids" if level else "node", more, fanout)))
    return blocks.select("grp", "block", "known", F.posexplode(at).alias("position", "x")).select(
        "grp", "block", "position", "x.node", "x.path", "known"
    )


def _tree(nodes: DataFrame, payload: list[str], largest: int, fanout: int, digits: int) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of every tier, one node ``(grp, h)`` for each group) of ranked ``nodes``."""
    tiers = []
    while True:
        blocks = settle(_blocks(nodes, payload, fanout, digits), f"manifest-tier-{len(tiers)}")
        tiers.append(blocks)
        largest = math.ceil(largest / fanout**digits)
        if largest <= 1:
            return tiers, blocks.select("grp", "h")
        nodes = blocks.select("grp", F.col("block").alias("rank"), F.ceil(F.col("size") / fanout**digits).alias("size"), "h")
        payload = []


def _emitted(tiers: list[DataFrame], above: DataFrame | None, fanout: int, digits: int) -> DataFrame:
    """One row for each leaf of the lowest tier: ``(grp, node, path, known)``.

    ``above`` (grp, path, known) holds what is above each group's top; without it the top is the root.
    """
    no_path, no_known = F.expr(f"cast(null as array<{STEP}>)"), F.expr(f"cast(null as {KNOWN})")
    paths = None if above is None else above.select("grp", F.lit(0).cast("long").alias("block"), "path", "known")
    for n, blocks in reversed(list(enumerate(tiers))):
        if paths is None:
            known = F.struct(F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
            told = blocks.withColumn("path", F.expr(f"cast(array() as array<{STEP}>)")).withColumn("known", known)
        else:
            kept = blocks.select("grp", "block", "size", "kids", no_path.alias("path"), no_known.alias("known"))
            empty = F.lit(None).cast(blocks.schema["kids"].dataType)
            handed = paths.select("grp", "block", F.lit(None).cast("long").alias("size"), empty.alias("kids"), "path", "known")
            told = kept.unionByName(handed).groupBy("grp", "block").agg(
                *[F.first(c, ignorenulls=True).alias(c) for c in ("size", "kids", "path", "known")]
            )
        out = _paths(told, fanout, digits)
        paths = out.select("grp", (F.col("block") * fanout**digits + F.col("position")).alias("block"), "path", "known")
    return out.select("grp", "node", "path", "known")


def leaves(docs: DataFrame) -> DataFrame:
    """``(grp, doc_id, leaf, changed, row)``: the digest of each row of ``docs`` and, where 7 divides the checksum of its id,
    that of the row with 1 added to n_chars."""
    fields = {c: F.col(c).cast("string" if c in ("source", "lang", "text") else "long") for c in LEAF_FIELDS}
    tampered = F.coalesce(F.crc32(fields["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = {**fields, "n_chars": fields["n_chars"] + 1}
    return docs.select(
        group_key(fields["lang"]).alias("grp"), fields["doc_id"].alias("doc_id"),
        digest(*map(encoded, fields.values())).alias("leaf"),
        F.when(tampered, digest(*map(encoded, more.values()))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


def manifest(docs: DataFrame, fanout: int = 2, digits: int = 8) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path, changed)`` of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``path`` leads from the leaf to the root: for each level that has more than one node, the siblings' digests
    left and right of it, joined; ``fold`` recomputes the root from it and ``siblings`` lists them. ``changed`` is the
    leaf of a tampered row where the row is one to tamper with, else null.

    Leaves ascend by doc_id in their language, null ids last; rows of one id ascend by their leaf. Rows alike in every
    field are leaves of their own. A null language is a group of its own, before the others; other columns take
    no part. An empty table has no rows. A row without an id is not tampered with. A text is hashed whole, where
    it is read; nothing but digests moves. n_chars must stay below 2**63 - 1.
    """
    rows = settle(leaves(docs), "manifest-leaves").withColumnRenamed("leaf", "h")
    ranked = ranked_in_groups(rows, [F.col("doc_id").asc_nulls_last(), "h", "row"])
    largest = ranked.agg(F.max("size")).first()[0] or 0
    tiers, tops = _tree(ranked, ["doc_id", "changed"], largest, fanout, digits)
    groups = ranked_in_groups(settle(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), "manifest-groups"), ["name"])
    upper, _ = _tree(groups, ["name"], groups.count(), fanout, digits)
    above = _emitted(upper, None, fanout, digits).select(
        F.col("node.name").alias("grp"), "path",
        F.struct(F.col("node.h").alias("subroot"), F.col("known.root").alias("root")).alias("known"),
    )
    return _emitted(tiers, settle(above, "manifest-above"), fanout, digits).select(
        "node.doc_id", F.col("node.h").alias("leaf"), "known.subroot", "known.root", "path", "node.changed"
    )
