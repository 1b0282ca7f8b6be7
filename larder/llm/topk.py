"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to floor(64 x) per component. Rows are dealt into blocks; the index of a
block holds, per component, one bitmap per bit of (value - smallest value of the component),
and the complements of those bitmaps. A query's score with every row of a block is then a sum
of bitmaps: for each component the slices shifted by the set bits of |q|, complemented where q
is negative, plus a constant of the query. Carry-save adders over whole bitmaps turn them into
the slices of the scores. The k best rows are chosen from the most significant score slice
downward; rows that tie at the boundary are resolved exactly, by smaller id.

Blocks hold ``BLOCK_ROWS`` rows on average. A task builds the slices of one block and streams the
queries past it, ``CHUNK_QUERIES`` at a time, so what moves is the queries to every block; where
there are few blocks a block is built in several lanes, each with a part of the queries. Only the
k best of a chunk and a block leave it.

Defined cases: vectors that are missing, or hold missing or non-finite components, take no
part; neither do rows without an id. A component whose floor(64 x) is beyond 62 bits, or vectors
whose scores could leave 64 bits, raise an error. Shorter vectors are filled with zeros. A row
repeated with equal id and quantised vector counts once; a row is never a neighbour of a query
with its own id. An empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import importable, written

SCALE = 64
BLOCK_ROWS = 1 << 16
CHUNK_QUERIES = 512


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding"):
    """(vec_id, v): the rows that take part, each once."""

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(SCALE)) * x.cast("double"))
        error = F.raise_error(F.lit("a component is too large to be scored")).cast("long")
        return F.when(F.abs(x.cast("double")) < float((1 << 62) // SCALE), scaled).otherwise(error)

    fit = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                   & (F.abs(x.cast("double")) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding))
        .where(F.col("vec_id").isNotNull() & F.col(embedding).isNotNull() & fit)
        .select("vec_id", F.transform(embedding, whole).alias("v"))
        .distinct()
    )


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def build_index(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """rows x width -> bitmaps [width, bits, 2, words] (plain and complement), lows, bits."""
    lows = values.min(0)
    raised = (values - lows).astype(np.uint64)
    bits = max(1, int(raised.max()).bit_length())
    words = -(-len(values) // 64)
    bitmaps = np.zeros((values.shape[1], bits, 2, words), np.uint64)
    for bit in range(bits):
        plain = ((raised >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8).T
        for side in (0, 1):
            packed = np.packbits(plain ^ side, axis=1, bitorder="little")
            bitmaps[:, bit, side].view(np.uint8)[:, :packed.shape[1]] = packed
    return bitmaps, lows, bits


def add_slices(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bitmaps by weight -> slices of their sum, least significant first."""
    slices, weight = [], 0
    while weight < len(columns):
        while len(columns) <= weight + 1 and len(columns[weight]) > 0:
            columns.append([])
        stacks = columns[weight]
        column = np.concatenate(stacks) if stacks else np.zeros((0, words), np.uint64)
        while len(column) > 1:
            third = len(column) // 3
            if third:
                a, b, c = column[:third], column[third:2 * third], column[2 * third:3 * third]
                half = a ^ b
                carry = (a & b) | (half & c)
                half ^= c
                column = np.concatenate([half, column[3 * third:]])
            else:
                carry = column[:1] & column[1:]
                column = column[:1] ^ column[1:]
            columns[weight + 1].append(carry)
        slices.append(column[0] if len(column) else np.zeros(words, np.uint64))
        weight += 1
    return slices


def score_slices(query: np.ndarray, bitmaps: np.ndarray, lows: np.ndarray, bits: int):
    """Slices of the scores of all rows, and the constant to add."""
    size = np.abs(query)
    columns: list[list[np.ndarray]] = []
    negative = (query < 0).astype(np.int64)
    for shift in range(int(size.max(initial=0)).bit_length()):
        set_here = np.flatnonzero((size >> shift) & 1)
        if not len(set_here):
            continue
        while len(columns) < shift + bits:
            columns.append([])
        for bit in range(bits):
            columns[shift + bit].append(bitmaps[set_here, bit, negative[set_here]])
    constant = int((query * lows).sum()) - int((size * negative).sum()) * ((1 << bits) - 1)
    return add_slices(columns, bitmaps.shape[-1]), constant


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(slices: list[np.ndarray], alive: np.ndarray, k: int):
    """Bitmaps of the rows surely in the top k, and of those that tie for the places left."""
    sure, tied = np.zeros_like(alive), alive.copy()
    for bits in reversed(slices):
        more = sure | (tied & bits)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            tied &= bits
        else:
            sure = more
            tied &= ~bits
            if n == k:
                return sure, np.zeros_like(alive)
    return sure, tied


def read_scores(slices: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for weight, bits in enumerate(slices):
        out += ((bits[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(
            np.int64) << weight
    return out


def search_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray,
                 index: tuple[np.ndarray, np.ndarray, int], k: int) -> Iterator[tuple]:
    """(query, vec_id, score) of the k best rows of a block; ``ids`` ascend."""
    bitmaps, lows, bits = index
    everyone = np.zeros(bitmaps.shape[-1], np.uint64)
    packed = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    everyone.view(np.uint8)[:len(packed)] = packed
    for query, own in zip(queries, query_ids):
        alive = everyone
        first, last = np.searchsorted(ids, [own, own + 1])
        if last > first:
            alive = everyone.copy()
            for row in range(first, last):
                alive[row >> 6] &= ~np.uint64(1 << (row & 63))
        slices, constant = score_slices(query, bitmaps, lows, bits)
        sure, tied = select_top(slices, alive, k)
        rows = positions(sure)
        rows = np.concatenate([rows, positions(tied)[:k - len(rows)]])
        yield ids[rows], read_scores(slices, rows) + constant


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    importable(spark)
    rows = written(quantised(vectors), "quantised")
    asked = F.col("vec_id") % every == 0
    size = F.aggregate(
        "v", F.lit(0).cast("long"), lambda most, x: F.greatest(most, F.abs(x)))
    count, n_queries, width, largest = rows.agg(
        F.count("*"), F.count(F.when(asked, 1)), F.max(F.size("v")), F.max(size)).first()
    width, largest = width or 0, largest or 0
    if width * largest * largest >= 1 << 62:
        raise OverflowError("scores of these vectors could leave 64 bits")
    kind = np.int32 if largest < 1 << 31 else np.int64
    blocks = max(1, math.ceil(count / BLOCK_ROWS))
    chunks = max(1, math.ceil(n_queries / CHUNK_QUERIES))
    lanes = min(chunks, max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        return pd.DataFrame({
            "place": [group["place"].iloc[0]], "ids": [group["vec_id"].to_numpy().tobytes()],
            "cells": [matrix(group["v"], width).astype(kind).tobytes()],
        })

    def packed(part: DataFrame, seed: int, n: int) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(n)).cast("int")
        return part.withColumn("place", place).groupBy("place").applyInPandas(
            pack, "place int, ids binary, cells binary"
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ids = None
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, own, cells = (batch.column(i)[row].as_py() for i in (2, 3, 4))
                query_ids = np.frombuffer(own, np.int64)
                queries = np.frombuffer(cells, kind).astype(np.int64).reshape(len(query_ids), width)
                if chunk < 0:  # the rows of a block come first
                    ids, index = query_ids, build_index(queries) if width else None
                elif index is not None:
                    found = list(search_block(queries, query_ids, ids, index, k))
                    sizes = [len(near) for near, _ in found]
                    numbers = (chunk << 32) + np.arange(len(sizes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (
                            np.repeat(query_ids, sizes), np.repeat(numbers, sizes),
                            np.concatenate([near for near, _ in found]),
                            np.concatenate([scores for _, scores in found]))],
                        ["query_id", "key", "vec_id", "score"])

    def every_one(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = packed(rows, 1, blocks).select(
        F.col("place").alias("block"), every_one(lanes).alias("lane"), F.lit(-1).alias("chunk"),
        "ids", "cells")
    queries = written(packed(rows.where(asked), 2, chunks), "queries").select(
        every_one(blocks).alias("block"), (F.col("place") % lanes).alias("lane"),
        F.col("place").alias("chunk"), "ids", "cells")
    found = (
        index.union(queries).repartition("block", "lane")
        .sortWithinPartitions("block", "lane", "chunk")
        .mapInArrow(search, "query_id long, key long, vec_id long, score long")
    )
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
