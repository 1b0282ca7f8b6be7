"""Ranked lexical search over per-term geometric blocks.

A document's vector has, for each of its terms, the integer impact of the term's count and the
document's length; a query's score is the sum of term weight times impact. The index is made of
shards of about ``SHARD_POSTINGS`` postings. In a shard every posting list is clustered: its
documents go to the nearest of a few documents of the list by a random projection of their
vectors, and each cluster is cut into blocks of at most 2 * ``BLOCK``. A block stores the
coordinatewise maximum of its documents' vectors, on the coordinates that queries with this
term can ask. The blocks of a list are looked at only if the list's summary bound can matter:
all terms of a query that are left, at their highest impacts, reach the threshold. A block is
skipped only if its own bound, weights times summary, is below the threshold, the query's
``k``-th best score so far; else its documents are scored in full. So the result is exact.

Every shard starts from a threshold that one document of ``SAMPLED``, by hash, gives: its k-th
best score is never above the whole corpus's. Lists that no query needs at this threshold get no
blocks, and a shard returns only documents that reach it.

Queries come in groups of about ``GROUP_TERMS`` terms, which every task holds; a larger query set
takes more passes over the documents, not more memory.

Terms are runs of ``[0-9a-z]`` and characters above U+007F after lower-casing A-Z. The weight of a
term is floor(1000 ln((2N + 2) / (2 df + 1))) and an impact 10^9 tf div (1000 tf + 20 m),
m = 100 - ``SLOPE`` + ``SLOPE`` n N div L.

Defined cases: missing or wordless texts have no terms, and as queries no results. Queries of
equal id and text count once; queries of equal id and different texts, or without an id, are
ranked each on its own. Rows without ``doc_id`` are documents, last among equal scores; repeated
rows are documents each. Texts of any length are taken whole; an empty table, or one without a
word, gives no rows. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import importable, written

TOP = 50
SLOPE = 50
SHARD_POSTINGS = 1 << 19
BLOCK = 64
CENTRES = 256
DIMENSIONS = 16
SAMPLED = 32
GROUP_TERMS = 1 << 15
GATHERED = 1 << 21  # postings looked at in one numpy step
SEED = 13
NO_ID = np.iinfo(np.int64).max

_SMALL = bytes(range(97, 123)) + bytes(range(48, 58)) + bytes(range(128, 256))
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _SMALL else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


# Documents as vectors --------------------------------------------------------------


def vectors(documents: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), the numbers of the known terms in it and their counts."""
    spark = documents.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, found, counts, ends = [], [], [], [0]
                for text in batch.column(1).to_pylist():
                    words = terms_of(text)
                    ids = np.array([number[w] for w in words if w in number], np.int32)
                    each, times = np.unique(ids, return_counts=True)
                    sizes.append(len(words))
                    found.append(each)
                    counts.append(times.astype(np.int64))
                    ends.append(ends[-1] + len(each))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts)))],
                    ["doc_id", "n", "terms", "counts"])

    return documents.where(F.length("text") > 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")
    ).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


@dataclass
class Corpus:
    """What the whole corpus says about the queries' terms."""

    documents: int
    length: int
    frequency: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        n = self.documents
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1)))
                         for df in self.frequency], np.int64)

    def impacts(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of terms that occur ``counts`` times in documents of ``sizes`` terms."""
        longest = int(sizes.max(initial=0))
        if SLOPE * longest * self.documents < 1 << 63:
            m = 100 - SLOPE + SLOPE * sizes * self.documents // max(self.length, 1)
        else:  # past 64 bits on the way
            m = np.array([100 - SLOPE + SLOPE * int(n) * self.documents // self.length
                          for n in sizes], np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def corpus_of(rows: DataFrame, known: int) -> Corpus:
    documents, length = rows.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(known, np.int64)
    found = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).toArrow()  # a row per term of the queries at most
    frequency[found["term"].to_numpy()] = found["df"].to_numpy()
    return Corpus(documents, length, frequency)


# The index -------------------------------------------------------------------------


@dataclass
class Shard:
    """Vectors and blocked posting lists of some documents, all in flat arrays."""

    ids: np.ndarray           # of the documents
    starts: np.ndarray        # a document's postings are starts[d] to starts[d + 1]
    terms: np.ndarray
    impacts: np.ndarray
    highest: np.ndarray       # of every term, its highest impact here
    lists: np.ndarray         # terms with blocks
    list_starts: np.ndarray   # a list's blocks
    block_starts: np.ndarray  # a block's documents, in ``members``
    members: np.ndarray
    summary_starts: np.ndarray
    summary_terms: np.ndarray
    summary_highest: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {f.name: getattr(self, f.name).tobytes() for f in fields(self)}

    @staticmethod
    def unpacked(row: dict[str, bytes]) -> Shard:
        return Shard(**{name: np.frombuffer(row[name], KINDS[name]) for name in KINDS})


KINDS = {
    "ids": np.int64, "starts": np.int64, "terms": np.int32, "impacts": np.int32,
    "highest": np.int32, "lists": np.int32, "list_starts": np.int64, "block_starts": np.int64,
    "members": np.int32, "summary_starts": np.int64, "summary_terms": np.int32,
    "summary_highest": np.int32,
}
SHARDS = ", ".join(f"{name} binary" for name in KINDS)


def spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of ``rows``, and where each row's begin among them."""
    sizes = starts[rows + 1] - starts[rows]
    begins = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts[rows] - begins, sizes), begins


def projected(starts: np.ndarray, terms: np.ndarray, values: np.ndarray, known: int) -> np.ndarray:
    """A short unit vector per document, near for documents of near vectors."""
    signs = np.random.default_rng(SEED).choice(
        np.array([-1, 1], np.float32), (known, DIMENSIONS))
    out = np.zeros((len(starts) - 1, DIMENSIONS), np.float32)
    at = 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + GATHERED // 8, "right")) - 1)
        part = slice(starts[at], starts[end])
        out[at:end] = np.add.reduceat(
            signs[terms[part]] * values[part, None], starts[at:end] - starts[at])
        at = end
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def clustered(documents: np.ndarray, near: np.ndarray, term: int) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in blocks: its documents in a new order, and where blocks begin."""
    n = len(documents)
    if n <= BLOCK:
        return documents, np.zeros(1, np.int64)
    centres = min(CENTRES, -(-n // BLOCK))
    chosen = np.random.default_rng([SEED, term]).choice(n, centres, replace=False)
    middle = near[documents[chosen]].T
    step = max(1, GATHERED // centres)
    nearest = np.concatenate([
        (near[documents[at:at + step]] @ middle).argmax(1) for at in range(0, n, step)])
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=centres)
    sizes = sizes[sizes > 0]
    pieces = -(-sizes // (2 * BLOCK))  # a large cluster is cut evenly
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begins, pieces) + inside * np.repeat(sizes, pieces) // np.repeat(
        pieces, pieces)
    return documents[order], starts.astype(np.int64)


def summaries(
    shard_starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, members: np.ndarray,
    starts: np.ndarray, asked: np.ndarray, place: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, highest impacts) per block of a list, on the coordinates ``asked``.

    ``place`` is scratch: a number per known term, -1 throughout.
    """
    place[asked] = np.arange(len(asked))
    ends = np.append(starts[1:], len(members))
    at = 0
    while at < len(starts):
        room = max(1, GATHERED // max(1, len(asked)))
        end = min(len(starts), at + room)
        while end > at + 1 and ends[end - 1] - starts[at] > max(1, GATHERED // 64):
            end = at + (end - at) // 2
        rows = members[starts[at]:ends[end - 1]]
        postings, _ = spread(shard_starts, rows)
        block = np.repeat(np.arange(end - at), (ends - starts)[at:end])
        block = np.repeat(block, shard_starts[rows + 1] - shard_starts[rows])
        column = place[terms[postings]]
        kept = column >= 0
        table = np.zeros((end - at) * len(asked), np.int32)
        np.maximum.at(table, block[kept] * len(asked) + column[kept], impacts[postings[kept]])
        for row in table.reshape(end - at, -1):
            there = np.flatnonzero(row)
            yield asked[there], row[there]
        at = end
    place[asked] = -1


def build(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, terms: np.ndarray,
          counts: np.ndarray, corpus: Corpus, asked: dict[int, np.ndarray]) -> Shard:
    """The shard of some documents. ``asked`` has, for each term that gets blocks, the terms of
    the queries that need them."""
    known = len(corpus.frequency)
    impacts = corpus.impacts(counts, np.repeat(sizes, np.diff(starts)))
    near = projected(starts, terms, (impacts * corpus.weights[terms]).astype(np.float32), known)
    highest = np.zeros(known, np.int32)
    np.maximum.at(highest, terms, impacts.astype(np.int32))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
    order = np.argsort(terms, kind="stable")
    bounds = np.searchsorted(terms[order], np.arange(known + 1))
    lists, list_starts, block_starts, members = [], [0], [], []
    summary_starts, summary_terms, summary_highest = [0], [], []
    filled, place = 0, np.full(known, -1, np.int64)
    impacts = impacts.astype(np.int32)
    for term, coordinates in sorted(asked.items()):
        documents = owner[order[bounds[term]:bounds[term + 1]]]
        if not len(documents):
            continue
        documents, begins = clustered(documents, near, term)
        lists.append(term)
        list_starts.append(list_starts[-1] + len(begins))
        block_starts.append(begins + filled)
        members.append(documents)
        filled += len(documents)
        for there, top in summaries(starts, terms, impacts, documents, begins, coordinates, place):
            summary_terms.append(there)
            summary_highest.append(top)
            summary_starts.append(summary_starts[-1] + len(there))

    def flat(parts: list, name: str) -> np.ndarray:
        return np.concatenate(parts).astype(KINDS[name]) if parts else np.zeros(0, KINDS[name])

    return Shard(
        ids, starts, terms, impacts, highest, np.array(lists, np.int32),
        np.array(list_starts, np.int64),
        np.append(flat(block_starts, "block_starts"), filled).astype(np.int64),
        flat(members, "members"), np.array(summary_starts, np.int64),
        flat(summary_terms, "summary_terms"), flat(summary_highest, "summary_highest"))


def loaded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents (ids, sizes, starts, terms, counts) of about ``limit`` postings at a time."""
    held: list[tuple] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        ids, sizes, lengths, terms, counts = (np.concatenate(x) for x in zip(*held))
        return ids, sizes, np.concatenate([[0], np.cumsum(lengths)]), terms, counts

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            terms, counts = batch.column(2), batch.column(3)
            held.append((
                batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()).astype(np.int64),
                terms.flatten().to_numpy(), counts.flatten().to_numpy()))
            size += len(held[-1][3])
            if size >= limit:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def index(rows: DataFrame, corpus: Corpus, asked: dict[int, np.ndarray],
          limit: int = SHARD_POSTINGS) -> DataFrame:
    """``SHARDS`` of the documents of ``vectors`` that hold a known term."""
    shared = rows.sparkSession.sparkContext.broadcast((corpus, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in loaded(batches, limit):
            yield pa.RecordBatch.from_pylist([build(*part, *shared.value).packed()])

    return rows.where(F.size("terms") > 0).mapInArrow(run, SHARDS)


# Search ----------------------------------------------------------------------------


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores and then smaller ids first."""
    return np.lexsort((ids, -scores))[:k]


def scores_of(starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray,
              rows: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(rows), np.int64), 0
    step = max(1, len(rows) * GATHERED // max(1, int((starts[rows + 1] - starts[rows]).sum())))
    while at < len(rows):
        places, begins = spread(starts, rows[at:at + step])
        out[at:at + step] = np.add.reduceat(
            weights[terms[places]] * impacts[places].astype(np.int64), begins)
        at += step
    return out


def searched(shard: Shard, query: np.ndarray, weights: np.ndarray, least: int, k: int,
             ) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the shard's k best documents for a query that reach ``least``.

    ``weights`` is zero but for the query's terms.
    """
    seen = np.zeros(len(shard.ids), bool)
    reach = weights[query] * shard.highest[query]
    order = np.argsort(-reach, kind="stable")
    left = np.cumsum(reach[order][::-1])[::-1]  # what this term and those after it can give
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold = max(least, 1)
    for term, most in zip(query[order], left):
        if most < threshold:
            break  # no document without an earlier term can reach it
        place = int(np.searchsorted(shard.lists, term))
        if place == len(shard.lists) or shard.lists[place] != term:
            continue
        first, last = shard.list_starts[place:place + 2]
        begin, end = shard.summary_starts[first], shard.summary_starts[last]
        given = weights[shard.summary_terms[begin:end]] * shard.summary_highest[begin:end]
        bounds = np.add.reduceat(given, shard.summary_starts[first:last] - begin)
        blocks = np.argsort(-bounds, kind="stable")
        at, step = 0, 1
        while at < len(blocks) and bounds[blocks[at]] >= threshold:
            chosen = blocks[at:at + step]
            chosen = chosen[bounds[chosen] >= threshold] + first
            places, _ = spread(shard.block_starts, chosen)
            rows = shard.members[places]
            rows = rows[~seen[rows]]
            seen[rows] = True
            if len(rows):
                new = scores_of(shard.starts, shard.terms, shard.impacts, weights, rows)
                kept = new >= threshold
                scores = np.concatenate([scores, new[kept]])
                ids = np.concatenate([ids, shard.ids[rows[kept]]])
                if len(scores) > k:
                    top = best_of(scores, ids, k)
                    scores, ids = scores[top], ids[top]
                if len(scores) == k:
                    threshold = max(threshold, int(scores.min()))
            at, step = at + step, 2 * step
    return scores, ids


FOUND = "query int, doc_id long, score long"


def _found(query: list, ids: list, scores: list) -> pa.RecordBatch:
    sizes = [len(x) for x in ids]
    flat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, scores)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(query, np.int32), sizes)), pa.array(flat[0]),
         pa.array(flat[1])], ["query", "doc_id", "score"])


def search(shards: DataFrame, queries: list[np.ndarray], weights: np.ndarray,
           least: np.ndarray, k: int) -> DataFrame:
    """``FOUND``: each shard's best documents for each query."""
    shared = shards.sparkSession.sparkContext.broadcast((queries, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, least = shared.value
        own = np.zeros(len(weights), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard.unpacked(batch.slice(row, 1).to_pylist()[0])
                scores, ids = [], []
                for query, bound in zip(queries, least):
                    own[query] = weights[query]
                    score, near = searched(shard, query, own, int(bound), k)
                    own[query] = 0
                    scores.append(score)
                    ids.append(near)
                yield _found(list(range(len(queries))), ids, scores)

    return shards.mapInArrow(run, FOUND)


def sampled_best(rows: DataFrame, queries: list[np.ndarray], corpus: Corpus, k: int) -> np.ndarray:
    """For each query the k-th best score in a sample of the documents, 0 if there are fewer."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus = shared.value
        weights, own = corpus.weights, np.zeros(len(corpus.frequency), np.int64)
        for ids, sizes, starts, terms, counts in loaded(batches, SHARD_POSTINGS):
            impacts = corpus.impacts(counts, np.repeat(sizes, np.diff(starts)))
            best, near = [], []
            for query in queries:
                own[query] = weights[query]
                scores = scores_of(starts, terms, impacts, own, np.arange(len(ids)))
                own[query] = 0
                top = best_of(scores, ids, k)
                best.append(scores[top])
                near.append(ids[top])
            yield _found(list(range(len(queries))), near, best)

    part = F.pmod(F.xxhash64("doc_id", "n", F.lit(SEED)), F.lit(SAMPLED)) == 0
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    found = rows.where(part & (F.size("terms") > 0)).mapInArrow(run, FOUND).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", "score")
    least = np.zeros(len(queries), np.int64)
    for query, score in found.collect():  # a row per query of the group
        least[query] = score
    return least


def needed(queries: list[np.ndarray], corpus: Corpus, least: np.ndarray) -> dict[int, np.ndarray]:
    """The terms that need blocks, each with all terms of the queries that need them.

    A query's lightest terms need none as long as all of them together, at the highest impact
    there is, stay below its threshold.
    """
    weights, asked = corpus.weights, {}
    for query, bound in zip(queries, least):
        order = np.argsort(weights[query], kind="stable")
        together = np.cumsum(weights[query][order]) * 1_000_000
        for term in query[order[together >= max(bound, 1)]].tolist():
            asked.setdefault(term, []).append(query)
    return {term: np.unique(np.concatenate(lists)) for term, lists in asked.items()}


def _grouped(queries: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) of the queries in groups of about ``GROUP_TERMS`` terms."""
    own = written(queries.select("item_id", F.col("text").cast("binary").alias("text"))
                  .where(F.length("text") > 0).dropDuplicates(), "queries")
    # A term has a character at least, and one between it and the next.
    total = own.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0.0))).first()[0]
    groups = max(1, math.ceil(total / (4 * GROUP_TERMS)))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for group in range(groups):
        yield [(row[0], bytes(row[1])) for row in own.where(place == group).collect()]


def ranked(documents: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query (item_id, text)."""
    spark = documents.sparkSession
    importable(spark)
    kind = queries.schema["item_id"].dataType
    out = None
    for group in _grouped(queries):
        known: dict[bytes, int] = {}
        asked = [np.unique(np.array([known.setdefault(w, len(known)) for w in terms_of(text)],
                                    np.int32)) for _, text in group]
        rows = written(vectors(documents, known), "vectors")
        corpus = corpus_of(rows, len(known))
        least = sampled_best(rows, asked, corpus, k)
        shards = written(index(rows, corpus, needed(asked, corpus, least)), "shards")
        found = search(shards, asked, corpus.weights, least, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        names = spark.createDataFrame(
            [(i, item) for i, (item, _) in enumerate(group)],
            f"query int, item_id {kind.simpleString()}")
        part = found.withColumn("rank", F.row_number().over(best)).where(
            F.col("rank") <= k).join(F.broadcast(names), "query").select(
            "item_id", "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score")
        out = part if out is None else out.union(part)
    return out
