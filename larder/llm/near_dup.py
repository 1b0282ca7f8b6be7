"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of ``WORDS`` words, each labelled with how often it occurred before
in the text. Each of ``SKETCHES`` hash functions picks the ``PICKED`` labelled k-mers with the
smallest hash and keeps them in text order; equal picks put two texts into one bucket. Texts of
at most ``SHORT`` words, of whose runs one edit spoils most, have ``SHORT_SKETCHES`` more over
their single words.

Pairs are verified by aligning the words within the band that the threshold allows:
similarity is 1 minus edit distance over the longer length, ``SIMILARITY`` or more is near. Word
counts by slot (a bag) rule most pairs out before their texts are fetched; the bound is exact.

Buckets are settled in two steps. First each text is compared with the one text of its bucket
that comes first in a fixed random order of all texts, which links the bulk of a group with few
pairs. Then in every bucket that still holds several classes all texts of different
classes are compared, in cells of two blocks of about ``BLOCK`` texts of like length, so that a
bucket of any size is many tasks' work; blocks whose lengths differ too much for near texts and those
of its largest class don't meet, and only pairs that pass the bag leave a cell. So any two near texts that share a bucket end in one class. What can be
lost is a near pair that shares none; the README has the measured shares.

Equal texts are one node throughout. Classes are the connected components of the links.

Words are lower-cased and split at white space. Shorter texts than a k-mer are one k-mer.

Defined cases: a missing text is in a class of its own id; empty or blank texts are linked to
equal texts only. Repeated rows fall into one class. Missing ids are ignored for the class id,
which is missing where no row of the class has an id. An empty table gives no rows. Very long
texts are sketched a stretch at a time, and aligned with memory in proportion to their words.
Other columns keep their values, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import importable, unused, written

WORDS = 3
SKETCHES = 64
PICKED = 2
SHORT = 25
SHORT_SKETCHES = 16
SIMILARITY = 0.8
BLOCK = 512
MET_AT_ONCE = 1 << 18
BAG = 1024
FOLDED = 256  # slots of the bag that every pair of a cell is held against first
BAGS_AT_ONCE = 1 << 12
SEED = 8
REMEMBERED_WORDS = 200_000
LONG = 1 << 15  # words; longer texts are aligned with sparse masks

_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(1, 1 << 32, SKETCHES, np.uint32) | np.uint32(1)
TERMS = _draw.integers(0, 1 << 32, SKETCHES, np.uint32)
LABEL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def labelled_kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers of word hashes, each with its count of earlier occurrences."""
    size = max(1, len(words) - k + 1)
    kmers = np.zeros(size, np.uint64)
    for i in range(min(k, len(words))):
        kmers = kmers * LABEL + words[i:i + size]
    kmers = mixed(kmers)
    ranked = np.sort(kmers)
    if (ranked[1:] != ranked[:-1]).all():
        return kmers
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.ones(size, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    earlier = np.empty(size, np.uint64)
    earlier[order] = np.arange(size) - first
    return np.where(earlier > 0, mixed(kmers + earlier * LABEL), kmers)


def sketch(kmers: np.ndarray, sketches: int = SKETCHES, kind: int = 0) -> np.ndarray:
    """One bucket key per hash function; ``kind`` keeps keys of different k-mers apart."""
    keys = (np.arange(1, sketches + 1, dtype=np.uint64) + np.uint64(kind << 32)) * LABEL
    rows = np.arange(sketches)
    factors, terms = FACTORS[:sketches, None], TERMS[:sketches, None]
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    low = np.full((sketches, PICKED), len(kmers))
    best = np.full((sketches, PICKED), 1 << 32, np.int64)
    step = 1 << 10  # what the hashes of so many take stays in a core's cache
    for at in range(0, len(short), step):
        hashes = short[None, at:at + step] * factors
        hashes += terms
        hashes ^= hashes >> np.uint32(15)
        hashes *= np.uint32(0x2C1B3C6D)
        for _ in range(min(PICKED, hashes.shape[1])):
            place = hashes.argmin(1)
            value = hashes[rows, place].astype(np.int64)
            hashes[rows, place] = np.iinfo(np.uint32).max
            worst = best.argmax(1)
            better = np.flatnonzero(value < best[rows, worst])
            best[better, worst[better]] = value[better]
            low[better, worst[better]] = at + place[better]
    low.sort(1)
    for i in range(PICKED):
        there = low[:, i] < len(kmers)
        picked = kmers[np.where(there, low[:, i], 0)]
        keys = mixed(keys * LABEL + np.where(there, picked, np.uint64(0)))
    return keys


def keys_of(words: np.ndarray) -> np.ndarray:
    """All bucket keys of a text, given its word hashes."""
    keys = sketch(labelled_kmers(words))
    if len(words) > SHORT:
        return keys
    return np.concatenate([keys, sketch(labelled_kmers(words, 1), SHORT_SKETCHES, 1)])


class Masks:
    """Where a word stands in a list: bit i is set if it is at place ``low`` + i.

    A list of up to ``LONG`` words has one integer per word; a longer one keeps places, and
    makes the bits of a band when it is asked.
    """

    def __init__(self, words: list, width: int):
        self.width, self.all = width, (1 << width) - 1
        self.bits: dict = {}
        self.places: dict | None = None
        if len(words) <= LONG:
            for i, word in enumerate(words):
                self.bits[word] = self.bits.get(word, 0) | 1 << i
        else:
            found: dict = {}
            for i, word in enumerate(words):
                found.setdefault(word, []).append(i)
            self.places = {word: np.array(at) for word, at in found.items()}

    def __call__(self, word: object, low: int) -> int:
        if self.places is None:
            bits = self.bits.get(word, 0)
            return (bits >> low if low >= 0 else bits << -low) & self.all
        places = self.places.get(word)
        if places is None:
            return 0
        first, last = np.searchsorted(places, [low, low + self.width])
        inside = places[first:last] - low
        if len(inside) < 8:
            return sum(1 << i for i in inside.tolist())
        dense = np.zeros(self.width, np.uint8)
        dense[inside] = 1
        return int.from_bytes(np.packbits(dense, bitorder="little").tobytes(), "little")


def distance(a: list, b: list, limit: int) -> int | None:
    """Edit distance if at most ``limit``. Common ends are left out."""
    if len(a) < len(b):
        a, b = b, a
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    shift = len(a) - len(b)
    while end > start and a[end + shift - 1] == b[end - 1]:
        end -= 1
    a, b = a[start:end + shift], b[start:end]
    if len(a) - len(b) > limit:
        return None
    if not b:
        return len(a)
    if len(a) > limit:
        return _banded(a, b, limit)
    found = _banded(a, b, len(a) - 1)
    return len(a) if found is None else found


def _banded(a: list, b: list, limit: int) -> int | None:
    """Edit distance if at most ``limit``, which is below the length of ``a``, the longer.

    One column of the band around the diagonal, 2 * limit + 1 cells, is two integers: the
    cells one above and one below their upper neighbour. A step moves the band down by one
    word of the shorter list.
    """
    if len(a) - len(b) > limit:
        return None
    width = 2 * limit + 1
    masks = Masks(a, width)
    mask, top = (1 << width) - 1, 1 << (width - 1)
    rises, falls, cost = mask & ~((1 << limit) - 1), 0, limit
    inside = len(a) - limit  # steps until the band's end leaves the longer list
    hopeless = limit + len(b) - inside
    for i, word in enumerate(b):
        same = masks(word, i - limit)
        free = ((((same & rises) + rises) ^ rises) | same | falls) & mask
        right = falls | (~(free | rises) & mask)
        left = free & rises
        if i < inside:
            cost += not free & top
            if cost > hopeless:
                return None
        else:
            end = top >> (i - inside + 1)
            cost += bool(right & end) - bool(left & end)
        free >>= 1
        rises = left | (~(free | right) & mask)
        falls = free & right
    return cost if cost <= limit else None


def limits_of(longest: np.ndarray) -> np.ndarray:
    """Most edits of two near texts, by the words of the longer one."""
    return np.floor((1 - SIMILARITY) * longest + 1e-9).astype(np.int64)


def limit_of(longest: int) -> int:
    return int((1 - SIMILARITY) * longest + 1e-9)


def similar(a: str, b: str) -> float | None:
    """Similarity of two texts if they are near."""
    left, right = a.lower().split(), b.lower().split()
    longest = max(len(left), len(right))
    if not longest:
        return None
    limit = limit_of(longest)
    if abs(len(left) - len(right)) > limit:
        return None
    if longest - sum((Counter(left) & Counter(right)).values()) > limit:
        return None
    found = distance(left, right, limit)
    return None if found is None else 1 - found / longest


class WordHashes(dict):
    """Words -> 64-bit hashes, remembered."""

    def __missing__(self, word: str) -> int:
        digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
        self[word] = code = int.from_bytes(digest, "little")
        return code

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def bag_of(words: np.ndarray) -> bytes:
    """How often words of each of ``BAG`` slots are in a text, at most 255 times, and its words."""
    counts = np.bincount((words % np.uint64(BAG)).astype(np.int64), minlength=BAG)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + len(words).to_bytes(4, "little")


def sketched(documents: DataFrame) -> DataFrame:
    """doc_id, node (a digest of the text), bucket keys, bag and words of every document with a
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                nodes, keys, bags, sizes = [], [], [], []
                for text in batch.column(1).to_pylist():
                    words = known.of(text.lower().split())
                    nodes.append(hashlib.md5(text.encode()).digest())
                    keys.append(keys_of(words).view(np.int64) if len(words) else [])
                    bags.append(bag_of(words))
                    sizes.append(len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(nodes, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(bags, pa.binary()),
                     pa.array(sizes, pa.int32())],
                    ["doc_id", "node", "keys", "bag", "words"],
                )

    return documents.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).mapInArrow(run, "doc_id long, node binary, keys array<bigint>, bag binary, words int")


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """Each text of a bucket with the bucket's first text in a random order of all texts:
    (a, b), a < b, each once, where their lengths allow it."""
    placed = F.struct(F.xxhash64("node", F.lit(SEED)).alias("place"), "node", "words")
    leaders = buckets.groupBy("bucket").agg(F.min(placed).alias("first"))
    first, words = F.col("first.node"), F.col("first.words")
    longest = F.greatest("words", words)
    like = longest - F.least("words", words) <= F.lit(1 - SIMILARITY) * longest + 1e-9
    return (
        buckets.join(leaders, "bucket").where((F.col("node") != first) & like)
        .select(F.least("node", first).alias("a"), F.greatest("node", first).alias("b"))
        .distinct()
    )


def bags_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts by slot and words, a row per text."""
    table = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BAG + 4)
    return table[:, :BAG], table[:, BAG:].copy().view("<u4")[:, 0].astype(np.int64)


def apart(x: np.ndarray, y: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Slot counts of two lists of texts -> whether they differ in more words than allowed."""
    more = x.astype(np.int16) - y
    over = np.maximum(more, 0).sum(1, dtype=np.int32)
    under = over - more.sum(1, dtype=np.int32)
    return np.maximum(over, under) > limits


def matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bags differ in no more words than the threshold allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BAGS_AT_ONCE):
                batch = whole.slice(at, BAGS_AT_ONCE)
                (x, m), (y, n) = (bags_of(batch.column(c)) for c in (2, 3))
                far = apart(x, y, limits_of(np.maximum(m, n)))
                yield batch.select([0, 1]).filter(pa.array(~far))

    left, right = (nodes.select(F.col("node").alias(c), F.col("bag").alias(f"bag_{c}"))
                   for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(
        run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                similar(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                for i in range(batch.num_rows)
            ]
            kept = pa.array([x is not None for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())],
                ["a", "b", "similarity"],
            ).filter(kept)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        run, "a binary, b binary, similarity double"
    )


def linking(pairs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The near ones of ``pairs``, whose bags match."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(documents, ends.join(nodes.select("node", "first_id"), "node"))
    return written(verified(pairs, texts), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b).

    Each step merges every node into its smallest neighbour and keeps only the links between
    different merged nodes. Nodes are digests, so their order is random and the links shrink
    by a factor each step, on long chains too.
    """
    edges, roots = links.select("a", "b").distinct(), None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            edges.select("b", "a"))
        merged = written(
            both.groupBy("node").agg(F.least("node", F.min("near")).alias("into")), "merged",
            narrow=True,
        )
        roots = merged.toDF("node", "root") if roots is None else follow(roots, merged)
        edges = written(
            edges.join(merged.toDF("a", "c"), "a").join(merged.toDF("b", "d"), "b")
            .where(F.col("c") != F.col("d"))
            .select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(),
            "edges", narrow=True,
        )
        if edges.isEmpty():
            return roots


def follow(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """``roots`` with those named in ``merged`` (node, into) replaced."""
    return written(
        roots.join(merged.toDF("root", "into"), "root", "left").select(
            "node", F.coalesce("into", "root").alias("root")), "roots", narrow=True,
    )


def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of earlier links, given as ``roots``, and of ``links``."""
    if roots is None:
        return written(components(links), "roots", narrow=True)
    a, b = (roots.toDF(c, f"root_{c}") for c in "ab")
    between = links.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    merged = written(components(between).toDF("node", "into"), "merged", narrow=True)
    new = merged.join(roots, "node", "left_anti").toDF("node", "root")
    return written(follow(roots, merged).union(new), "roots", narrow=True)


def crowded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (node, first_id, bag), and (node, words, bucket) of buckets of several."""
    nodes = written(
        rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"),
                                 F.first("bag").alias("bag"), F.first("words").alias("words")),
        "nodes",
    )
    every = nodes.select("node", "words", F.explode("keys").alias("bucket"))
    short = F.xxhash64("node")
    several = every.groupBy("bucket").agg(F.min(short).alias("low"), F.max(short).alias("high"))
    several = several.where(F.col("low") != F.col("high")).select("bucket")
    buckets = written(every.join(several, "bucket", "left_semi"), "buckets")
    return nodes.select("node", "first_id", "bag"), buckets


def texts_of(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), each once. Copies go their own ways by their ids before they are dropped."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = documents.where(F.col("text").isNotNull()).select(
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"),
        F.col("doc_id").cast("long").alias("doc_id"), "text",
    ).withColumn("key", key)
    wanted = nodes.select("node", F.col("first_id").alias("doc_id")).withColumn("key", key)
    found = rows.join(wanted.select("node", "key"), ["node", "key"], "left_semi")
    return written(found.dropDuplicates(["node"]).select("node", "text"), "texts")


def unresolved(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, bucket, root) of the buckets whose texts are in more than one class."""
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    short = F.xxhash64("root")
    several = placed.groupBy("bucket").agg(F.min(short).alias("low"), F.max(short).alias("high"))
    several = several.where(F.col("low") != F.col("high")).select("bucket")
    return placed.join(several, "bucket", "left_semi")


def cells(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (bucket, node, root, and words if lengths are to tell) that have to
    meet: (bucket, i, j, side, node, root), ``side`` being the row's block and i <= j the two blocks
    of its cell.

    The blocks of a large bucket are cut by length, and only those meet whose lengths near texts can
    have. Those of its largest class have odd numbers and don't meet each other; the first that an
    even block meets comes into that block's own cell. A length of more than a block's texts is dealt
    over several blocks.
    """
    if "words" not in members.columns:
        members = members.withColumn("words", F.lit(0))
    classes = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = F.max_by("n", F.struct("n", "root"))
    sizes = classes.groupBy("bucket").agg(
        F.sum("n").alias("n"), most.alias("top"),
        F.max_by("root", F.struct("n", "root")).alias("top_root"),
    ).where(F.col("n") > F.col("top")).select(
        "bucket", (F.col("n") > BLOCK).alias("large"), "top_root")
    placed = members.join(sizes, "bucket").withColumn(
        "top", (F.col("root") == F.col("top_root")).cast("int"))
    small = placed.where(~F.col("large")).select(
        "bucket", *(F.lit(0).alias(c) for c in ("i", "j", "side")), "node", "root")

    large = placed.where("large").select("bucket", "top", "words", "node", "root")
    shorter = Window.partitionBy("bucket", "top").orderBy("words").rowsBetween(
        Window.unboundedPreceding, -1)
    lengths = large.groupBy("bucket", "top", "words").agg(F.count("*").alias("n")).select(
        "bucket", "top", "words",
        F.floor(F.coalesce(F.sum("n").over(shorter), F.lit(0)) / BLOCK).alias("first"),
        F.ceil(F.col("n") / BLOCK).alias("parts"))
    blocks = lengths.select(
        "bucket", "top", "words",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("block"),
    ).groupBy("bucket", "top", (2 * F.col("block") + F.col("top")).cast("int").alias("side")).agg(
        F.min("words").alias("shortest"), F.max("words").alias("longest"))
    one, two = (blocks.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in blocks.columns[1:]))
                for x in "ij")
    least = F.greatest("shortest_i", "shortest_j")  # of the longer one of two texts
    reach = least - F.least("longest_i", "longest_j") <= F.lit(1 - SIMILARITY) * least + 1e-9
    near = one.join(two, "bucket").where(reach & (F.col("top_i") == 0))
    within = near.where((F.col("top_j") == 0) & (F.col("side_i") <= F.col("side_j"))).select(
        "bucket", F.col("side_i").alias("i"), F.col("side_j").alias("j"),
        F.explode(F.array_distinct(F.array("side_i", "side_j"))).alias("side"))
    own = F.col("side_j") == F.min("side_j").over(Window.partitionBy("bucket", "side_i"))
    across = near.where(F.col("top_j") == 1).withColumn("own", own).select(
        "bucket", *(F.when(F.col("own"), F.col("side_i")).otherwise(name("side_i", "side_j")).alias(c)
                    for c, name in (("i", F.least), ("j", F.greatest))),
        F.explode(F.when(F.col("own"), F.array("side_j")).otherwise(
            F.array("side_i", "side_j"))).alias("side"))
    meeting = within.unionByName(across)
    place = F.pmod(F.xxhash64("node", F.lit(SEED)), "parts")
    dealt = large.join(lengths, ["bucket", "top", "words"]).select(
        "bucket", (2 * (F.col("first") + place) + F.col("top")).cast("int").alias("side"),
        "node", "root")
    return small.unionByName(dealt.join(meeting, ["bucket", "side"]))


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows ordered by their first three columns -> these and the rows of each cell."""
    cell, parts = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
        starts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        cuts = [0, *starts.tolist(), len(keys)] if len(keys) else [0]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(keys[start].tolist())
            if parts and key != cell:
                yield cell, pa.Table.from_batches(parts).combine_chunks()
                parts = []
            cell = key
            parts.append(batch.slice(start, end - start))
    if parts:
        yield cell, pa.Table.from_batches(parts).combine_chunks()


def met(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a < b, of different classes that share a bucket and whose bags match, each once:
    in the smallest bucket that both are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), rows in whole_cells(batches):
            side, root = (rows.column(c).to_numpy() for c in ("side", "root"))
            if root.min() == root.max():
                continue
            node = rows.column("node").to_pylist()
            shared = [frozenset(own) for own in rows.column("own").to_pylist()]
            a, b = [], []
            for x, y in _met_in_cell(side, root, rows.column("bag"), i == j):
                for u, v in zip(x.tolist(), y.tolist()):
                    if min(shared[u] & shared[v]) == bucket:
                        a.append(min(node[u], node[v]))
                        b.append(max(node[u], node[v]))
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    # A text has a bucket per sketch at most.
    own = members.groupBy("node").agg(F.collect_list("bucket").alias("own"))
    dealt = cells(members).join(nodes.select("node", "bag").join(own, "node"), "node")
    # A task holds one cell at a time.
    ordered = dealt.select(
        "bucket", "i", "j", "side", F.xxhash64("root").alias("root"), "node", "bag", "own",
    ).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return ordered.mapInArrow(run, "a binary, b binary")


def _met_in_cell(side: np.ndarray, root: np.ndarray, bags: pa.Array, within: bool
                 ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    table, words = bags_of(bags)
    folded = table.reshape(len(table), -1, FOLDED).sum(1, dtype=np.int16)
    order = np.argsort(words, kind="stable")  # near texts are of like length
    limits = limits_of(words)
    n = len(order)
    # The longest text that may be near a text of so many words.
    reach = np.searchsorted((words - limits)[order], words[order], "right")
    at = 0
    while at < n:
        end = at + 1
        room = MET_AT_ONCE - max(0, int(reach[at]) - at)
        while end < n and room > 0:
            room -= max(0, int(reach[end]) - end)
            end += 1
        partners = np.maximum(reach[at:end] - np.arange(at, end) - 1, 0)
        x = np.repeat(np.arange(at, end), partners)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(partners) - partners, partners)
        x, y, at = order[x], order[y], end  # y is the longer
        fits = root[x] != root[y]
        if not within:
            fits &= side[x] != side[y]
        x, y = x[fits], y[fits]
        for part in range(0, len(x), BAGS_AT_ONCE):
            u, v = x[part:part + BAGS_AT_ONCE], y[part:part + BAGS_AT_ONCE]
            near = ~apart(folded[u], folded[v], limits[v])
            u, v = u[near], v[near]
            near = ~apart(table[u], table[v], limits[v])
            if near.any():
                yield u[near], v[near]


def linked(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every document with a text, and (node, class_id) of every text."""
    importable(documents.sparkSession)
    rows = written(sketched(documents), "sketches")
    nodes, buckets = crowded(rows)
    pairs = written(leader_pairs(buckets), "pairs", narrow=True)
    links = linking(written(matching(pairs, nodes), "pairs"), documents, nodes)
    roots = written(components(links), "roots", narrow=True)
    members = written(unresolved(buckets, roots), "members", narrow=True)
    if not members.isEmpty():
        links = linking(written(met(members, nodes), "pairs"), documents, nodes)
        roots = extended(roots, links)
    named = nodes.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("class_node"), "first_id"
    )
    first = named.groupBy("class_node").agg(F.min("first_id").alias("class_id"))
    named = written(named.join(first, "class_node").select("node", "class_id"), "classes")
    return rows.select("doc_id", "node"), named


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest id of the class) of every document."""
    rows, named = linked(documents)
    alone = documents.where(F.col("text").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id")
    )
    return rows.join(named, "node").select("doc_id", "class_id").union(alone)


def without_copies(documents: DataFrame) -> DataFrame:
    """The documents' columns: one row of each class, that with the smallest id; documents
    without a text all stay. Of rows equal in id and text one stays."""
    _, named = linked(documents)
    own_node, own_class = unused(documents, "node"), unused(documents, "class")
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    kept = named.where(F.col("class_id").isNotNull()).toDF(own_node, own_class)
    same = documents.where(F.col("text").isNotNull()).join(
        kept, (F.col("doc_id") == F.col(own_class)) & (node == F.col(own_node)), "left_semi"
    ).dropDuplicates(["doc_id"])
    rest = named.where(F.col("class_id").isNull()).select(F.col("node").alias(own_node))
    nameless = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNull()).join(
        rest, node == F.col(own_node), "left_semi"
    ).dropDuplicates(["text"])
    return same.unionByName(nameless).unionByName(documents.where(F.col("text").isNull()))
