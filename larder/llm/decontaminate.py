"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items form one automaton. A document's words are streamed through
it, tracking the longest match that ends at each word. Where the match reaches ``WINDOW``
words, or ends with a whole shorter item, the matched words are hit. ``remove_spans`` cuts the
hit words out of a text and drops texts of which more than ``COVERAGE`` is hit.

Words are runs of ``[0-9a-z]`` and characters above U+007F after lower-casing A-Z.

Items enter automata of about ``AUTOMATON_WORDS`` words, dealt by hash. Each is broadcast and
applied in a pass of its own, whose result is stored before the next, so a larger benchmark means
more passes over the words, not more memory, and the driver holds one group of items at a time.

Defined cases: missing, empty or wordless texts have no words, no hits and, as items, no
windows. An item without an id makes hits but is not listed. Repeated items are listed once.
Missing or repeated document ids are kept row by row. Empty tables give no rows, or no hits. Texts
of any length are streamed whole. Extra columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.llm.common import importable, written

WINDOW = 10
COVERAGE = 0.5
AUTOMATON_WORDS = 100_000
RESULTS = ("n_words", "n_hit", "hit_words", "hit_items")

_SMALL = bytes(range(97, 123)) + bytes(range(48, 58)) + bytes(range(128, 256))
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or b in _SMALL else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; words are small integers."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = []
        for item, words in items:
            if words:
                ids = [self.number.setdefault(w, len(self.number)) for w in words]
                coded.append((item, ids))
                last = 0
                for word in ids:
                    last = self._extend(last, word)
        self.items: dict[int, set[str]] = {}  # state of a window -> items that hold it
        self.whole: dict[int, list[tuple[int, str | None]]] = {}  # state -> short items
        self._mark(coded)

    def _add(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that ends the words of ``state`` and ``word``."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._add(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._add(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def _shortest(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what ``state`` matched."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        short: dict[int, set[tuple[int, str | None]]] = {}
        for item, ids in coded:
            state = 0
            for i, word in enumerate(ids):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    held = self.items.setdefault(self._shortest(state, self.window), set())
                    if item is not None:
                        held.add(item)
            if len(ids) < self.window:
                short.setdefault(self._shortest(state, len(ids)), set()).add((len(ids), item))
        if short:
            for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                found = self.whole.get(self.link[state], []) + list(short.get(state, ()))
                if found:
                    self.whole[state] = found

    def match(self, words: list[bytes], hit: np.ndarray) -> set[str]:
        """Mark hit words; the ids of the items with a window among the words."""
        following, link, length = self.next, self.link, self.length
        window, whole, found = self.window, self.whole, set()
        state = size = 0
        for i, word in enumerate(map(self.number.get, words)):
            if word is None:
                state = size = 0
                continue
            target = following[state].get(word)
            if target is None:
                while state and target is None:
                    state = link[state]
                    target = following[state].get(word)
                if target is None:
                    size = 0
                    continue
                size = length[state]
            state = target
            size += 1
            if size >= window:
                hit[i + 1 - window:i + 1] = True  # what is before was marked by earlier words
                found |= self.items[self._shortest(state, window)]
            if whole and state in whole:
                for n, item in whole[state]:
                    if n <= size:
                        hit[i + 1 - n:i + 1] = True
                        if item is not None:
                            found.add(item)
        return found


def _automata(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in groups of about ``limit`` words, dealt by hash."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    # A word has a byte at least, and one between it and the next.
    most = items.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0.0))).first()[0]
    groups = max(1, math.ceil(most / (4 * limit)))
    if groups > 1:
        items = written(items.dropDuplicates(), "items")
    else:
        items = items.dropDuplicates()
    for group in range(groups):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == group)
        yield [(row.item, words_of(bytes(row.text) if row.text is not None else None))
               for row in part.collect()]


def matches(
    documents: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_WORDS,
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    finished: StructType | None = None,
) -> DataFrame:
    """The documents' columns, ``n_words``, ``n_hit``, ``hit_words`` (a bit per word) and
    ``hit_items`` (ids, sorted). ``finish`` turns these batches into ones of ``finished`` in
    the last pass, so that no further Python worker is needed."""
    spark = documents.sparkSession
    importable(spark)
    plain = documents.drop(*RESULTS)
    column = plain.columns.index("text")
    n = len(plain.columns)
    out = plain.select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.lit(b"").alias("hit_words"), F.array().cast("array<string>").alias("hit_items"),
    )
    schema = out.schema

    def passed(shared, after):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for batch in batches:
                texts = batch.column(column).cast(pa.binary()).to_pylist()
                before, known = (batch.column(n + i).to_pylist() for i in (2, 3))
                sizes, counts, hits, items = [], [], [], []
                for text, old, have in zip(texts, before, known):
                    words = words_of(text)
                    hit = np.zeros(len(words), bool)
                    found = automaton.match(words, hit)
                    packed = np.packbits(hit)
                    if old:
                        packed |= np.frombuffer(old, np.uint8)
                    sizes.append(len(words))
                    counts.append(int(np.bitwise_count(packed).sum()))
                    hits.append(packed.tobytes())
                    items.append(sorted(found.union(have)))
                done = pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], pa.array(sizes, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(hits, pa.binary()),
                     pa.array(items, pa.list_(pa.string()))],
                    batch.schema.names,
                )
                yield after(done) if after else done
        return run

    groups = _automata(benchmark, limit)
    group = next(groups)
    for following in groups:
        shared = spark.sparkContext.broadcast(group)
        out = written(out.mapInArrow(passed(shared, None), schema), "matches")
        shared.destroy()
        group = following
    last = spark.sparkContext.broadcast(group)
    return out.mapInArrow(passed(last, finish), finished if finish else schema)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: its words, the hit ones, and the items found in it."""
    return matches(documents.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_hits(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and what separates them from the next word."""
    pieces, at = [], 0
    cut = None
    for word, gone in zip(re.finditer(rb"\S+", text.translate(WORD_BYTES)), hit):
        if gone and cut is None:
            cut = word.start()
        elif not gone and cut is not None:
            pieces.append(text[at:cut])
            at, cut = word.start(), None
    pieces.append(text[at:cut] if cut is not None else text[at:])
    return b"".join(pieces)


def remove_spans(
    documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE
) -> DataFrame:
    """The documents' columns: hit spans cut out of ``text``, ``n_chars`` (where there is one)
    set to its new length, texts hit in more than ``coverage`` of their words dropped. Texts without hits stay as they are."""
    plain = documents.drop(*RESULTS)
    names = plain.columns
    column = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, hit = (batch.column(len(names) + i).to_numpy() for i in (0, 1))
        batch = batch.filter(pa.array(hit <= coverage * size))
        texts, hits = batch.column(column).to_pylist(), batch.column(len(names) + 2).to_pylist()
        counts = batch.column(chars).to_pylist() if chars is not None else None
        for i, (text, hit) in enumerate(zip(texts, hits)):
            if any(hit):
                marks = np.unpackbits(np.frombuffer(hit, np.uint8))
                texts[i] = without_hits(text.encode(), marks).decode()
                if counts:
                    counts[i] = len(texts[i])
        columns = list(batch.columns[:len(names)])
        columns[column] = pa.array(texts, pa.string())
        if counts:
            columns[chars] = pa.array(counts, batch.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return matches(documents, benchmark, finish=cut, finished=plain.schema)
