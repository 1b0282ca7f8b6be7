"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: h = (h << 1) + G[byte] in 16 bits, so it depends on
the last 16 bytes alone. A chunk ends where the top ``MASK_BITS`` bits are zero and at least
``SMALLEST`` bytes have gone by, or at ``LARGEST`` bytes; an insertion moves only the chunks
around it. A chunk whose digest occurs earlier, by (doc_id, place in the text), is a copy of the
earliest chunk with that digest, in the same document or another.

Copies that follow each other here and there are one anchor. It is compared with its source byte
by byte and extended to both sides as far as the bytes agree, ``REACH`` at most: the ends of a
passage lie inside chunks that differ, or are cut out of step. Extended anchors of at least
``SPAN_BYTES`` are repeats; what is shorter is left alone, as short phrases recur by chance.
Repeats that overlap or touch are one span.

Digests that ``HOT`` chunks share or more are broadcast to the chunks if they are counted few, so
that no passage, however common, is one task's work.

Defined cases: missing or empty texts have no chunks. Rows of equal id and text are one
document, rows of one id with different texts are documents each, in the order of a hash of the
text; rows without an id come before all others, and are not reported. Very long texts are hashed
a stretch at a time. An empty table gives no rows. Other columns are passed over, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import importable, written
from larder.sizing import bounded

MASK_BITS = 5
SMALLEST = 16
LARGEST = 256
SPAN_BYTES = 160
REACH = 256
HOT = 10_000
SEED = 9
GEAR = np.random.default_rng(SEED).integers(0, 1 << 16, 256, np.uint16)
WINDOW = 16
STRETCH = 1 << 22
NO_ID = -(1 << 63)


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Places just after the bytes where the gear hash allows a cut."""
    found = []
    for at in range(0, len(data), STRETCH):  # long texts a stretch at a time
        before = min(at, WINDOW - 1)
        hashes = GEAR[data[at - before:at + STRETCH]]
        width = 1
        while width < WINDOW:
            shifted = hashes[:-width] << np.uint16(width)
            hashes[width:] += shifted
            width *= 2
        mask = np.uint16(((1 << MASK_BITS) - 1) << (WINDOW - MASK_BITS))
        found.append(np.flatnonzero((hashes[before:] & mask) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    ends, last, size = [], 0, len(data)
    for place in cut_candidates(np.frombuffer(data, np.uint8)).tolist():
        while place - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if place - last >= SMALLEST:
            ends.append(place)
            last = place
    while size - last > LARGEST:
        last += LARGEST
        ends.append(last)
    if size > last:
        ends.append(size)
    return ends


def identified(documents: DataFrame) -> DataFrame:
    """(doc_id, k, text): a document is told by its id and a hash of its text."""
    return documents.where(F.length("text") > 0).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.hash("text").alias("k"), "text")


def chunked(documents: DataFrame) -> DataFrame:
    """A row per chunk of ``identified`` documents: doc_id, k, begin, size, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                sizes, begins, lengths, digests = [], [], [], []
                for text in texts:
                    ends = cuts(text)
                    starts = [0, *ends[:-1]]
                    sizes.append(len(ends))
                    begins += starts
                    lengths += [e - b for b, e in zip(starts, ends)]
                    digests += [xxhash.xxh3_64_intdigest(text[b:e]) for b, e in zip(starts, ends)]
                owner = pa.array(np.repeat(np.arange(len(texts)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner),
                     pa.array(begins, pa.int64()), pa.array(lengths, pa.int32()),
                     pa.array(np.array(digests, np.uint64).view(np.int64))],
                    ["doc_id", "k", "begin", "size", "digest"],
                )

    return documents.mapInArrow(run, "doc_id long, k int, begin long, size int, digest long")


def copies(chunks: DataFrame) -> DataFrame:
    """The chunks that occurred earlier, with the place where they first did (``first``)."""
    place = F.struct("doc_id", "k", "begin")
    # Summed before the shuffle, so a passage in a third of all rows is one row a task.
    shared = written(chunks.groupBy("digest").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shared")
    hot = shared.where(F.col("n") >= HOT).drop("n")
    rows = hot.count()
    rest = chunks.join(bounded(hot.select("digest"), rows), "digest", "left_anti") if rows else chunks
    found = rest.join(shared.where(F.col("n") < HOT).drop("n"), "digest")
    if rows:
        found = found.unionByName(chunks.join(bounded(hot, rows), "digest"))
    return found.where(place > F.col("first")).select(
        "doc_id", "k", "begin", (F.col("begin") + F.col("size")).alias("end"),
        F.col("first.doc_id").alias("first_id"), F.col("first.k").alias("first_k"),
        F.col("first.begin").alias("first_begin")).distinct()


def anchors(found: DataFrame) -> DataFrame:
    """Copies joined where one follows the other in the document and in the source."""
    order = Window.partitionBy("doc_id", "k").orderBy("begin")
    shift = F.struct("first_id", "first_k", F.col("begin") - F.col("first_begin"))
    follows = (F.lag("end").over(order) == F.col("begin")) & (F.lag(shift).over(order) == shift)
    numbered = found.withColumn("new", ~F.coalesce(follows, F.lit(False))).withColumn(
        "run", F.sum(F.col("new").cast("int")).over(order))
    return numbered.groupBy("doc_id", "k", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.min("first_id").alias("first_id"), F.min("first_k").alias("first_k"),
        F.min("first_begin").alias("first_begin"), F.count(F.lit(1)).alias("chunks")).drop("run")


def shared_start(a: bytes, b: bytes) -> int:
    """Bytes that ``a`` and ``b`` have in common from their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def extended(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Anchors compared with their source and extended: doc_id, k, begin, end, first_id, chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            names = ("doc_id", "k", "begin", "end", "first_id", "first_begin", "chunks")
            columns = (batch.column(name).to_pylist() for name in (*names, "here", "there"))
            for doc, k, begin, end, first, source, n, here, there in zip(*columns):
                left, source_left, size = min(begin, REACH), min(source, REACH), end - begin
                if here[left:left + size] != there[source_left:source_left + size]:
                    continue  # another text with the same digest
                before = shared_start(here[:left][::-1], there[:source_left][::-1])
                after = shared_start(here[left + size:], there[source_left + size:])
                rows.append((doc, k, begin - before, end + after, first, n))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                ["doc_id", "k", "begin", "end", "first_id", "chunks"])

    def around(begin: str) -> Column:
        """The bytes of the span and up to ``REACH`` on either side, where it begins at ``begin``."""
        start = F.greatest(F.col(begin) - REACH, F.lit(0))
        return F.substr(F.col("text").cast("binary"), (start + 1).cast("int"),
                        (F.col(begin) - start + F.col("end") - F.col("begin") + REACH).cast("int"))

    texts = identified(documents)
    ends = found.select("doc_id", "k").union(found.select("first_id", "first_k")).distinct()
    texts = written(texts.join(ends, ["doc_id", "k"], "left_semi").dropDuplicates(["doc_id", "k"]),
                    "texts")
    here = found.join(texts, ["doc_id", "k"]).withColumn("here", around("begin")).drop("text")
    sources = texts.withColumnsRenamed({"doc_id": "first_id", "k": "first_k"})
    both = here.join(sources, ["first_id", "first_k"]).withColumn(
        "there", around("first_begin")).drop("text")
    return both.mapInArrow(run, "doc_id long, k int, begin long, end long, first_id long, chunks long")


def repeats(documents: DataFrame, least: int = SPAN_BYTES) -> DataFrame:
    """A row per repeated span: doc_id, begin, end (bytes, end exclusive), chunks, and the
    document that holds the source of its first anchor (first_doc_id)."""
    importable(documents.sparkSession)
    chunks = written(chunked(identified(documents)), "chunks")
    found = written(anchors(copies(chunks)), "anchors")
    spans = extended(found, documents).where(F.col("end") - F.col("begin") >= least)
    order = Window.partitionBy("doc_id", "k").orderBy("begin", "end", "first_id")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.where(F.col("doc_id") != NO_ID).withColumn(
        "new", F.coalesce(earlier, F.lit(-1)) < F.col("begin")
    ).withColumn("span", F.sum(F.col("new").cast("int")).over(order))
    first = F.min_by("first_id", F.struct("begin", "end", "first_id"))
    return joined.groupBy("doc_id", "k", "span").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("chunks").alias("chunks"),
        F.nullif(first, F.lit(NO_ID)).alias("first_doc_id"),
    ).select("doc_id", "begin", "end", "chunks", "first_doc_id")
