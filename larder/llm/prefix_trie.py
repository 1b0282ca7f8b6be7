"""The prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. ``paths`` gives every conversation a row per
depth with the node's key: two 64-bit words, the exclusive or of a hash of each turn's place,
role and text. So a key is a running exclusive or, its parent's key takes the last turn's hash
out again, and a conversation of any length is summed in blocks of ``BLOCK`` turns.

Nodes are counted by one aggregation, combined before the shuffle. Totals over subtrees go from
children to parents: in reverse level order each node takes the messages that lie ready for
it, adds them to its own share and sends its total forward to its parent, through a priority
queue of (level, key) that spills sorted runs when it is full. First within shards: a shard
is a largest subtree whose conversations have at most ``SHARD_ROWS`` turns from its top on, so
it fits a task whatever the data. Then across shard roots: their totals are added up per parent,
and the nodes above are dealt into shards of ``FACTOR`` times as many turns, and so on until
one shard holds the root. Every shard streams, sorted outside memory, a row per node.

``ends_sha256`` hashes a node's ids in order. They are range-partitioned by node and id and
joined to texts there, so that a node where very many conversations end is many tasks' work;
only these texts go through one digest.

``rebuilt`` mixes conversations as the registered query asks; ``trie`` takes any rows of
(conv_id, depth, role, text).

Defined cases: rows without ``conv_id`` take no part. A missing role or text is empty. Rows go
by turn (missing first), rows of equal turn by role, then text; repeated rows are turns of
their own. An empty table gives the root alone, with no conversation and no id. Texts of any
length count by their code points. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import importable, new_folder, written
from larder.sizing import bounded

SHARD_ROWS = 1 << 12
FACTOR = 1 << 12
BLOCK = 1 << 16
KEY = ["k1", "k2"]
PARENT = ["p1", "p2"]
TEXT_BYTES = 1 << 20


# Turns -----------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, g1, g2, chars): each turn's place, content hash and length."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    # A very long conversation is put in order a block of turn numbers at a time.
    inside = F.row_number().over(
        Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    rows = rows.select(
        "conv_id", "block", (inside - 1).cast("long").alias("place"),
        F.xxhash64(F.lit(1), "role", "text").alias("g1"),
        F.xxhash64(F.lit(2), "text", "role").alias("g2"), F.length("text").alias("chars"))
    return shifted(rows, "place", F.count(F.lit(1)), F.sum, F.lit(0)).drop("block")


def shifted(rows: DataFrame, name: str, part: Column, total, nothing: Column) -> DataFrame:
    """``rows`` (conv_id, block, ...) with what the conversation's earlier blocks come to added
    to ``name``. Few conversations have more than one block."""
    sums = rows.groupBy("conv_id", "block").agg(part.alias("_part"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    later = sums.withColumn("_before", total("_part").over(before)).where(
        F.col("_before").isNotNull()).select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "_before")
    joined = rows.join(later, (F.col("conv_id") == F.col("_conv"))
                       & F.col("block").eqNullSafe(F.col("_block")), "left")
    return joined.withColumn(
        name, F.col(name) + F.coalesce("_before", nothing)).drop("_conv", "_block", "_before")


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, ...]:
    """(conv_id, depth from 1, g1, g2, chars), and (conv_id, size) of every conversation.

    Conversation c is the first h turns of c - c % ``group`` and then its own after its first h;
    h is the crc32 of c in decimal modulo ``most``.
    """
    placed = written(turns(conversations), "turns")
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    counted = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = counted.select("conv_id", "n", own.alias("h"), base.alias("base"))
    sizes = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = heads.join(sizes, "base", "left").select(
        "conv_id", "base", "h", F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest"),
        F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    heads = written(heads, "heads", narrow=True)
    first = placed.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "base").join(
        heads.where(F.col("taken") > 0).select("conv_id", "base", "taken"), "base"
    ).where(F.col("place") < F.col("taken")).select(
        "conv_id", (F.col("place") + 1).alias("depth"), "g1", "g2", "chars")
    last = placed.join(heads.select("conv_id", "h", "taken"), "conv_id").where(
        F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"),
        "g1", "g2", "chars")
    return first.union(last), heads.select(
        "conv_id", (F.col("taken") + F.col("rest")).alias("size"))


# Nodes -----------------------------------------------------------------------------


def paths(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent's key, chars, below): a row per turn; ``below`` counts the
    conversation's turns from here on."""
    hashed = rows.select(
        "conv_id", "depth", "chars", F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
        F.xxhash64(F.lit(3), "depth", "g1", "g2").alias("t1"),
        F.xxhash64(F.lit(4), "depth", "g2", "g1").alias("t2"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, 0)
    keyed = hashed
    for key, turn in zip(KEY, ("t1", "t2")):
        keyed = keyed.withColumn(key, F.bit_xor(turn).over(upto))
    sums = hashed.groupBy("conv_id", "block").agg(
        *(F.bit_xor(t).alias(f"_{t}") for t in ("t1", "t2")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    later = sums.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        *(F.bit_xor(f"_{t}").over(before).alias(f"_before_{t}") for t in ("t1", "t2")),
    ).where(F.col("_block") > 0)
    joined = keyed.join(later, (F.col("conv_id") == F.col("_conv"))
                        & (F.col("block") == F.col("_block")), "left").join(sizes, "conv_id")
    whole = {k: F.col(k).bitwiseXOR(F.coalesce(f"_before_{t}", F.lit(0)))
             for k, t in zip(KEY, ("t1", "t2"))}
    return joined.withColumns(whole).select(
        "conv_id", "depth", *KEY,
        *(F.col(k).bitwiseXOR(F.col(t)).alias(p) for k, t, p in zip(KEY, ("t1", "t2"), PARENT)),
        "chars", (F.col("size") - F.col("depth") + 1).alias("below"))


def nodes_of(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per node but the root, and the root: key, parent's key, depth, conv_id, n_convs,
    own (saved at the node itself) and weight (turns of its conversations from here on)."""
    each = rows.groupBy(*KEY).agg(
        *(F.min(p).alias(p) for p in PARENT), F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"), F.sum("below").alias("weight"))
    root = sizes.agg(
        *(F.lit(0).cast("long").alias(c) for c in (*KEY, *PARENT)),
        F.lit(0).cast("long").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.lit(0).alias("chars"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("weight"))
    both = each.withColumn("depth", F.col("depth").cast("long")).unionByName(root)
    own = F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("chars")
    return both.select(*KEY, *PARENT, "depth", "conv_id", "n_convs", own.alias("own"), "weight")


# Time-forward processing -----------------------------------------------------------


class SpillingQueue:
    """A priority queue of tuples, smallest first, that keeps ``limit`` of them in memory.

    A full heap goes, sorted, to a run in the task's scratch file; what is asked for is the
    smallest of the heap and of the heads of the runs.
    """

    def __init__(self, limit: int = 1 << 18, block: int = 1 << 10):
        self.limit, self.block = limit, block
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (tuple, run): the smallest of each run
        self.runs: list[Iterator[tuple]] = []
        self.file = None

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:  # where Spark itself spills; gone when closed
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.file = tempfile.TemporaryFile(dir=folder)
        items, self.heap = sorted(self.heap), []
        self.file.seek(0, os.SEEK_END)
        places = []
        for at in range(0, len(items), self.block):
            places.append(self.file.tell())
            pickle.dump(items[at:at + self.block], self.file)
        run = self._read(places)
        self.runs.append(run)
        heapq.heappush(self.heads, (next(run), len(self.runs) - 1))

    def _read(self, places: list[int]) -> Iterator[tuple]:
        for place in places:
            self.file.seek(place)
            yield from pickle.load(self.file)

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, number = self.heads[0]
            following = next(self.runs[number], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, number))
            return item
        return heapq.heappop(self.heap)

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)


def forwarded(nodes: Iterator[tuple], limit: int = 1 << 18) -> Iterator[tuple]:
    """Totals of the nodes of whole shards.

    ``nodes`` are (shard, -depth, key, parent, own, children, leaves, saved) in that order, the
    last three what has come from other shards. Yields (key, n_children, n_leaves, saved).
    """
    for _, rows in groupby(nodes, key=lambda node: node[0]):
        queue = SpillingQueue(limit)
        for _, level, key, parent, own, children, leaves, saved in rows:
            saved += own
            while len(queue) and queue.first()[:2] == (level, key):
                _, _, more, extra = queue.pop()
                children, leaves, saved = children + 1, leaves + more, saved + extra
            if not children:
                leaves = 1
            queue.push((level + 1, parent, leaves, saved))
            yield key, children, leaves, saved


TOTALS = "k1 long, k2 long, n_children long, n_leaves long, saved_tokens long"


def totals_of(nodes: DataFrame) -> DataFrame:
    """``TOTALS`` of nodes (shard, depth, keys, own, n_children, n_leaves, saved_tokens)."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for shard, s2, level, k1, k2, p1, p2, *rest in zip(*columns):
                yield (shard, s2), level, (k1, k2), (p1, p2), *rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = [field.split()[0] for field in TOTALS.split(", ")]
        for key, *totals in forwarded(rows_of(batches)):
            held.append((*key, *totals))
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*held)], names)
                held = []
        columns = zip(*held) if held else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    order = ["s1", "s2", "level", *KEY]
    return nodes.select(
        "s1", "s2", (-F.col("depth")).alias("level"), *KEY, *PARENT, "own",
        "n_children", "n_leaves", "saved_tokens",
    ).sortWithinPartitions(*order).mapInArrow(run, TOTALS)


def subtree_totals(nodes: DataFrame, rows: DataFrame, shard_rows: int = SHARD_ROWS,
                   factor: int = FACTOR) -> DataFrame:
    """``TOTALS`` of every node: within shards, then across shard roots, round by round."""
    importable(nodes.sparkSession)
    whole = nodes.where(F.col("depth") == 0).agg(F.max("weight")).first()[0]
    weight, low, limit, done = F.col("weight"), -1, shard_rows, None
    while low < whole:
        level = nodes.where((weight > low) & (weight <= limit))
        given = level.select(*KEY, *PARENT, "depth", "conv_id", "own")
        counts = ("n_children", "n_leaves", "saved_tokens")
        if done is None:
            given = given.withColumns({c: F.lit(0).cast("long") for c in counts})
        else:
            here = level.select(*(F.col(k).alias(p) for k, p in zip(KEY, PARENT)))
            sent = nodes.where(weight <= low).join(
                bounded(here, here.count()), PARENT, "left_semi").select(*KEY, *PARENT)
            # Summed before the shuffle: a node may have very many shards right below it.
            sums = done.join(sent, KEY).groupBy(*PARENT).agg(
                F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                F.sum("saved_tokens").alias("saved_tokens"))
            sums = sums.select(*(F.col(p).alias(k) for k, p in zip(KEY, PARENT)), *counts)
            given = given.join(sums, KEY, "left").fillna(0, list(counts))
        if limit >= whole:
            dealt = given.select(
                F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), "*"
            ).repartition(1)
        else:
            above = nodes.where((weight > limit) & (F.col("depth") > 0)).select(*KEY)
            # A conversation's path leaves the nodes above for good: there its shard begins.
            shards = rows.join(bounded(above, above.count()), KEY, "left_anti").groupBy(
                "conv_id").agg(F.min_by(F.struct(*KEY), "depth").alias("shard"))
            dealt = given.join(shards, "conv_id").select(
                *(F.col("shard")[k].alias(s) for k, s in zip(KEY, ("s1", "s2"))), given["*"]
            ).repartition("s1", "s2")
        found = written(totals_of(dealt), "totals")
        done = found if done is None else done.union(found)
        low, limit = limit, limit * factor
    return done


# Where conversations end -----------------------------------------------------------


def joined_ids(ends: DataFrame, limit: int = TEXT_BYTES) -> DataFrame:
    """(k1, k2, part, number, ids): ids in order, joined by commas, a text or more per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        names = ["k1", "k2", "part", "number", "ids"]
        held, held_size = [], 0

        def texts() -> Iterator[tuple]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for (k1, k2), group in groupby(rows, key=lambda row: row[:2]):
                ids, size, number = [], 0, 0
                for _, _, conv_id in group:
                    ids.append(str(conv_id))
                    size += len(ids[-1]) + 1
                    if size >= limit:
                        yield k1, k2, part, number, ",".join(ids)
                        ids, size, number = [], 0, number + 1
                if ids:
                    yield k1, k2, part, number, ",".join(ids)

        for row in texts():
            held.append(row)
            held_size += len(row[-1])
            if len(held) >= 8192 or held_size >= limit:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                held, held_size = [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*held) if held else [[]] * 5, kinds)], names)

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.select(*KEY, "conv_id").repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(
        *KEY, "conv_id").mapInArrow(run, "k1 long, k2 long, part int, number int, ids string")


def digested(texts: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of each node's texts, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64)
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)))
        held = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            k1, k2, digest = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(digest, pa.string())],
                ["k1", "k2", "ends_sha256"])

        for (k1, k2), group in groupby(rows, key=lambda row: row[:2]):
            digest = hashlib.sha256(next(group)[2].encode())
            for row in group:
                digest.update(f",{row[2]}".encode())
            held.append((k1, k2, digest.hexdigest()))
            if len(held) == 8192:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "part", "number").select(
        *KEY, "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, sizes: DataFrame, shard_rows: int = SHARD_ROWS,
         factor: int = FACTOR) -> DataFrame:
    """The nodes of conversations given as (conv_id, depth, g1, g2, chars) and (conv_id, size)."""
    importable(rows.sparkSession)
    walked = written(paths(rows, sizes), "paths")
    nodes = written(nodes_of(walked, sizes), "nodes")
    totals = subtree_totals(nodes, walked, shard_rows, factor)
    nothing = F.lit(0).cast("long")
    ends = walked.where(F.col("below") == 1).select(*KEY, "conv_id").union(
        sizes.where(F.col("size") == 0).select(nothing, nothing, "conv_id"))
    # Read by range while its bounds are sampled: the texts are stored, so both agree.
    texts = written(joined_ids(ends), "ids")
    parents = nodes.select(
        *(F.col(k).alias(p) for k, p in zip(KEY, PARENT)), F.col("conv_id").alias("parent_conv_id"))
    above = nodes.where(F.col("depth") > 0).select(*KEY, *PARENT).join(parents, PARENT)
    return (
        nodes.join(totals, KEY).join(above.select(*KEY, "parent_conv_id"), KEY, "left")
        .join(digested(texts), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce(
                "ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row per node."""
    return trie(*rebuilt(conversations))
