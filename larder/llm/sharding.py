"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions.

A document descends from region to rack to shard. At each level every child draws
-ln(u) / weight, with u a hash of the document's id and the child, and the smallest draw wins:
a child gets its share by weight, and a change of one weight moves documents only into or out
of that child, so movement stays inside the subtrees whose weights change.

``tree_of(n)``: the first ``BASE`` shards fill regions of two racks of two shards each. Every
further shard opens a region of its own; so one more shard takes documents only into itself.

Defined cases: a missing id hashes like a value of its own; rows of equal id go to one shard.
A missing text has size 1 and the crc32 of no bytes. Columns other than doc_id and text are
passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import written

SHARDS = 8
BASE = 8
LAW = "key"
SLOT_ROWS = 1 << 16  # rows numbered together

Tree = dict[str, dict[str, dict[int, float]]]  # region -> rack -> shard -> weight


def tree_of(shards: int, base: int = BASE) -> Tree:
    tree: Tree = {}
    for shard in range(shards):
        region, rack = (shard // 4, shard // 2 % 2) if shard < base else (f"own{shard}", 0)
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def winner(key: Column, weights: dict[str, float]) -> Column:
    """The name that draws least: one of ``weights``."""
    def draw(name: str, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(name).alias("name"))

    drawn = [draw(name, weight) for name, weight in weights.items() if weight > 0]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["name"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of ``key``."""
    def weight(node) -> float:
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def descend(node: dict, path: str) -> Column:
        # paths name the children, so draws under one parent tell nothing about another's
        chosen = winner(key, {f"{path}/{name}": weight(child) for name, child in node.items()})
        out = None
        for name, child in node.items():
            here = f"{path}/{name}"
            below = descend(child, here) if isinstance(child, dict) else F.lit(int(name))
            out = F.when(chosen == here, below) if out is None else out.when(chosen == here, below)
        return out

    return descend(tree, "").cast("int")


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in its shard) and grown_shard.

    Slots are numbered in stretches of ``SLOT_ROWS`` stored rows, each shifted by the rows of its
    shard in earlier stretches, so no shard's rows meet in one task.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        place(F.col("doc_id"), tree_of(shards)).alias("shard"),
        place(F.col("doc_id"), tree_of(shards + 1)).alias("grown_shard"),
    ), "shards")
    stretch = ["shard", "file", "part"]
    placed = rows.select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"),
        F.floor(F.col("_metadata.row_index") / F.lit(SLOT_ROWS)).alias("part"),
    )
    counts = placed.groupBy(*stretch).agg(F.count("*").alias("n"))  # few rows for each stretch
    before = Window.partitionBy("shard").orderBy("file", "part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*stretch).orderBy("row")) - 1
    return placed.withColumn("own", own).join(shifts, stretch).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("shift") + F.col("own")).cast("long").alias("slot"), "grown_shard",
    )
