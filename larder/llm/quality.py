"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text becomes a sparse vector x: its words hashed into ``WORD_SLOTS`` slots (square roots of
their counts, scaled to length one), one slot for the bin of each structure statistic, and one
for the bin of the recorded length. Its score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so all pairwise interactions cost one pass over the non-zero slots.

The machine is fitted on at most ``TRAINING_ROWS`` labelled rows, those with the smallest hash
of their id; every document is scored. Neither labels, lang, source nor doc_id enter a score.

Defined cases: a missing text scores like an empty one, which has structure bins but no words;
a missing length has a bin of its own; label rows with a missing label or id are not learned
from, repeated label rows count as often as they occur; with no label rows every score is 0.5.
Other columns of the documents are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import id_remainder, importable

WORD_SLOTS = 1 << 15
BINS = 16
TRAINING_ROWS = 12_000
FACTORS = 8
EPOCHS = 12
KEPT = 0.7
REMEMBERED_WORDS = 200_000  # slots of words a worker remembers; above it, it starts anew

STATISTICS = (
    "length", "words", "word_length", "distinct", "repeats", "upper", "symbols", "digits",
    "marks", "lines", "line_words", "recorded",
)
SLOTS = WORD_SLOTS + BINS * len(STATISTICS)
FEATURES = "slots binary, amounts binary"


def _bin(share: float) -> int:
    """0 for nothing, then finer towards 0 and 1 alike is not needed: even steps."""
    return min(BINS - 1, math.ceil(share * (BINS - 1)))


def _log_bin(n: float) -> int:
    return min(BINS - 1, int(math.log2(n + 1)))


class Featuriser:
    """Text and recorded length -> slots and amounts."""

    def __init__(self):
        self.slot_of: dict[str, int] = {}

    def words(self, counts: Counter) -> dict[int, float]:
        if len(self.slot_of) > REMEMBERED_WORDS:
            self.slot_of.clear()
        out: dict[int, float] = {}
        for word, n in counts.items():
            slot = self.slot_of.get(word)
            if slot is None:
                slot = self.slot_of[word] = crc32(word.encode()) % WORD_SLOTS
            out[slot] = out.get(slot, 0.0) + math.sqrt(n)
        return out

    def __call__(self, text: str | None, recorded: int | None):
        text = text or ""
        words = text.split()
        counts = Counter(words)
        length, n = len(text), max(1, len(words))
        lines = text.count("\n") + 1
        letters = sum(map(len, words)) or 1
        ascii_only = text.encode("ascii", "ignore")
        symbols = len(ascii_only) - len(ascii_only.translate(None, b"!#$%&*|<>{}[]@^~=_\\/"))
        digits = len(ascii_only) - len(ascii_only.translate(None, b"0123456789"))
        marks = len(ascii_only) - len(ascii_only.translate(None, b".,;:?'\"-"))
        upper = len(ascii_only) - len(ascii_only.translate(None, bytes(range(65, 91))))
        repeats = sum(map(str.__eq__, words, words[1:]))
        bins = (
            _log_bin(length), _log_bin(len(words)), min(BINS - 1, letters // n),
            _bin(len(counts) / n), _bin(min(1.0, 2 * repeats / n)), _bin(upper / letters),
            _bin(min(1.0, 4 * symbols / letters)), _bin(min(1.0, 4 * digits / letters)),
            _bin(min(1.0, 4 * marks / letters)), _log_bin(lines), _log_bin(n / lines),
            BINS - 1 if recorded is None else min(BINS - 2, _log_bin(max(0, recorded))),
        )
        found = self.words(counts)
        slots = np.fromiter(found, np.int32, len(found))
        amounts = np.fromiter(found.values(), np.float32, len(found))
        if len(found):
            amounts /= np.sqrt((amounts * amounts).sum())
        places = WORD_SLOTS + BINS * np.arange(len(bins), dtype=np.int32)
        fixed = np.full(len(bins), 1 / math.sqrt(len(bins)), np.float32)
        return (
            np.concatenate([slots, places + np.array(bins, np.int32)]),
            np.concatenate([amounts, fixed]),
        )


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # SLOTS
    factors: np.ndarray  # SLOTS x FACTORS

    def raw(self, slots: np.ndarray, amounts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of the rows that begin at ``starts``."""
        linear = np.add.reduceat(self.weights[slots] * amounts, starts)
        weighted = self.factors[slots] * amounts[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted * weighted, starts, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over small batches, a little weight decay."""
    draw = np.random.default_rng(seed)
    positive = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(
        float(np.log(positive / (1 - positive))), np.zeros(SLOTS, np.float32),
        draw.normal(0, 0.05, (SLOTS, FACTORS)).astype(np.float32),
    )
    if not len(labels):
        machine.factors[:] = 0
        return machine
    seen_w = np.full(SLOTS, 1e-3, np.float32)
    seen_v = np.full((SLOTS, FACTORS), 1e-3, np.float32)
    seen_b, rate, decay = 1e-3, 0.1, 1e-5
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at:at + 128]
            sizes = np.array([len(rows[i][0]) for i in batch])
            slots = np.concatenate([rows[i][0] for i in batch])
            amounts = np.concatenate([rows[i][1] for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(batch)), sizes)
            weighted = machine.factors[slots] * amounts[:, None]
            sums = np.add.reduceat(weighted, starts, axis=0)
            error = (sigmoid(machine.raw(slots, amounts, starts)) - labels[batch]) / len(batch)
            step = error[owner] * amounts
            used, place = np.unique(slots, return_inverse=True)
            slope_w = np.bincount(place, step, len(used)).astype(np.float32)
            slope_w += decay * machine.weights[used]
            each = step[:, None] * (sums[owner] - weighted)
            slope_v = np.stack(
                [np.bincount(place, each[:, f], len(used)) for f in range(FACTORS)], 1
            ).astype(np.float32) + decay * machine.factors[used]
            seen_w[used] += slope_w**2
            seen_v[used] += slope_v**2
            machine.weights[used] -= rate * slope_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * slope_v / np.sqrt(seen_v[used])
            seen_b += float(error.sum()) ** 2
            machine.bias -= rate * float(error.sum()) / math.sqrt(seen_b)
    return machine


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Featuriser()
    for batch in batches:
        found = [make(*x) for x in zip(*(batch.column(c).to_pylist() for c in (1, 2)))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.tobytes() for s, _ in found], pa.binary()),
             pa.array([a.tobytes() for _, a in found], pa.binary())],
            ["label", "slots", "amounts"],
        )


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Machine:
    """Fit on at most ``rows`` of ``labels`` (doc_id, label), smallest hash of the id first."""
    importable(documents.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
        .dropna().orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    )
    texts = documents.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    found = (
        texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most ``rows``
        .select("label", "text", "n_chars")
        .mapInArrow(_featurised, f"label int, {FEATURES}").toArrow()
    )
    examples = sorted(zip(*(found.column(c).to_pylist() for c in ("slots", "amounts", "label"))))
    return fit(
        [(np.frombuffer(s, np.int32), np.frombuffer(a, np.float32)) for s, a, _ in examples],
        np.array([y for *_, y in examples], np.float32),
    )


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every document."""
    spark = documents.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(machine)  # SLOTS x (FACTORS + 1) floats, fixed

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featuriser()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [make(*x) for x in zip(*(batch.column(c).to_pylist() for c in (1, 2)))]
                sizes = np.array([len(s) for s, _ in found])
                raw = shared.value.raw(
                    np.concatenate([s for s, _ in found]), np.concatenate([a for _, a in found]),
                    np.concatenate([[0], np.cumsum(sizes)[:-1]]),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sigmoid(raw.astype(np.float64)))],
                    ["doc_id", "score"],
                )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.col("n_chars").cast("long").alias("n_chars"),
    ).mapInArrow(scored, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Learn from labels outside the held-out quarter and score every document."""
    learned = labels.select("doc_id", F.col("quality").alias("label")).where(
        id_remainder(F.col("doc_id"), 4) != 2
    )
    return score(documents, train(documents, learned, rows)).select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= KEPT).cast("int").alias("predicted"),
    )
