"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1 of ``DIMENSIONS`` components. A trigram
binds its three letters: the first permuted (rolled) twice, the second once, multiplied with
the third. A text bundles (adds) the vectors of all its trigrams, and a language the unit
vectors of its training texts. A document gets the language with the largest cosine; ties go to the smaller name.

Letters are lower-cased; every run of other characters counts as one space, and a text starts
and ends with one. Letters share ``LETTER_SLOTS`` vectors by code point.

Learned from ``TRAINING_ROWS`` texts per language, those with the smallest hash of their id
(rows of equal id come together). Every whole text is scored.

Defined cases: a text that is missing or has no letter gets ``und`` with score 0; so does
every text when there is nothing to learn from. Rows without a language, a text or a letter
are not learned from. Ids may be missing or repeated: each row is predicted on its own. An empty
table gives no rows. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from larder.llm.common import id_remainder, importable

DIMENSIONS = 1024
LETTER_SLOTS = 255
TRAINING_ROWS = 1_500
SLOT_BITS = 12
UNDETERMINED = "und"
SEED = 20
RESULTS = (StructField("lang_pred", StringType()), StructField("score", DoubleType()))
CHUNK_ROWS, CHUNK_CHARACTERS = 256, 1_000_000
BOUND_AT_ONCE = 2048  # trigram vectors in memory
COUNTED = 1 << 23  # counts of trigrams by text in memory


@cache
def letter_vectors() -> np.ndarray:
    """One row per slot; slot 0 is the space."""
    bits = np.random.default_rng(SEED).integers(0, 2, (LETTER_SLOTS + 1, DIMENSIONS), np.int8)
    return 2 * bits - 1


def _slot(code: int) -> int:
    character = chr(code)
    if not character.isalpha():
        return 0
    return 1 + ord(character.lower()[0]) % LETTER_SLOTS


@cache
def _basic_slots() -> np.ndarray:
    return np.array([_slot(code) for code in range(1 << 16)], np.uint8)


def slots_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(codes) and codes.max() >= 1 << 16:
        far = codes >= 1 << 16
        slots = _basic_slots()[np.where(far, 0, codes)]
        slots[far] = [_slot(int(code)) for code in codes[far]]
        return slots
    return _basic_slots()[codes]


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    letters = letter_vectors()
    first, second, third = keys >> 16, (keys >> 8) & 255, keys & 255
    bound = np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]
    return bound.astype(np.float32)


def bundles(texts: list[str | None]) -> np.ndarray:
    """One vector per text, zero where there is no letter."""
    each = [slots_of(f" {text} ") if text else np.zeros(1, np.uint8) for text in texts]
    sizes = np.array([len(x) for x in each])
    slots, owner = np.concatenate(each), np.repeat(np.arange(len(each)), sizes)
    kept = np.ones(len(slots), bool)
    kept[1:] = (slots[1:] != 0) | (slots[:-1] != 0) | (owner[1:] != owner[:-1])
    slots, owner = slots[kept], owner[kept]
    inside = owner[2:] == owner[:-2]
    # The letters of these texts are numbered, so that tables by trigram are no larger than they need.
    letters = np.flatnonzero(np.bincount(slots))
    n = len(letters)
    number = np.zeros(LETTER_SLOTS + 1, np.int32)
    number[letters] = np.arange(n)
    slots = number[slots]
    keys = ((slots[:-2] * n + slots[1:-1]) * n + slots[2:])[inside]
    owner = owner[:-2][inside]
    if not len(keys):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    seen = np.zeros(n ** 3, bool)
    seen[keys] = True
    used = np.flatnonzero(seen)
    if len(texts) > 1 and len(texts) * len(used) > COUNTED:  # many different trigrams
        half = len(texts) // 2
        return np.concatenate([bundles(texts[:half]), bundles(texts[half:])])
    place = np.empty(n ** 3, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    counts = np.bincount(owner * len(used) + place[keys], minlength=len(texts) * len(used))
    counts = counts.reshape(len(texts), -1)
    spelt = letters[used // n ** 2] << 16 | letters[used // n % n] << 8 | letters[used % n]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(used), BOUND_AT_ONCE):
        part = slice(at, at + BOUND_AT_ONCE)
        out += counts[:, part].astype(np.float32) @ trigram_vectors(spelt[part])
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """Row offset and texts, a bounded number of rows and characters (or one row) at a time."""
    texts = batch.column(column).to_pylist()
    at = 0
    while at < len(texts):
        end, room = at + 1, CHUNK_CHARACTERS - len(texts[at] or "")
        while end < len(texts) and end - at < CHUNK_ROWS and len(texts[end] or "") <= room:
            room -= len(texts[end] or "")
            end += 1
        yield at, texts[at:end]
        at = end


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for at, texts in chunks(batch, 1):
            vectors = unit(bundles(texts)).astype(np.float64)
            own = langs[at:at + len(texts)]
            for lang in set(own):
                totals[lang] = totals.get(lang, 0) + vectors[own == lang].sum(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.string()),
         pa.array([np.rint(v * 1e6).astype(np.int64) for v in totals.values()],
                  pa.list_(pa.int64()))],
        ["lang", "vector"],
    )


def prototypes(documents: DataFrame, rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of the languages of ``documents`` (lang, text, doc_id)."""
    importable(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", "doc_id"
    )
    order = F.xxhash64("doc_id")
    # Rows are counted by the hash's leading bits, so that only rows near the limit are ranked,
    # not a whole language in one task. A row per language, like the prototypes themselves.
    slot = F.shiftright(order, 64 - SLOT_BITS)
    ahead = Window.partitionBy("lang").orderBy("_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    reach = (
        known.groupBy("lang", slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        .where(F.col("_ahead") < rows)
        .groupBy(F.col("lang").alias("_lang")).agg(F.max("_slot").alias("_reach"))
    )
    few = Window.partitionBy("lang").orderBy("_order")
    last = (
        known.select("lang", order.alias("_order"), slot.alias("_slot"))
        .join(F.broadcast(reach), (F.col("lang") == F.col("_lang")) & (F.col("_slot") <= F.col("_reach")))
        .withColumn("_rank", F.row_number().over(few)).where(F.col("_rank") <= rows)
        .groupBy("_lang").agg(F.max("_order").alias("_last"))
    )
    chosen = known.join(
        F.broadcast(last), (F.col("lang") == F.col("_lang")) & (order <= F.col("_last"))
    ).select("lang", "text")
    sums = (
        chosen.mapInArrow(_summed, "lang string, vector array<bigint>")
        .select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
        .select("lang", "v.v").collect()  # a row per language
    )
    found = sorted((row.lang, row.v) for row in sums)
    vectors = np.array([v for _, v in found], np.float32).reshape(-1, DIMENSIONS)
    lettered = np.abs(vectors).sum(1) > 0
    return [lang for (lang, _), k in zip(found, lettered) if k], unit(vectors[lettered])


def predict(documents: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """The documents' columns and ``lang_pred`` and ``score``; ``text`` must be among them.

    Columns of those two names are replaced.
    """
    importable(documents.sparkSession)
    plain = documents.drop("lang_pred", "score")
    column = plain.columns.index("text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in chunks(batch, column):
                found = bundles(texts)
                empty = ~found.any(1)
                if not names:
                    empty[:] = True
                cosines = unit(found) @ vectors.T if names else np.zeros((len(texts), 1))
                best = cosines.argmax(1)
                top = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1)
                langs += [UNDETERMINED if e else names[b] for e, b in zip(empty, best)]
                scores += list(np.where(empty, 0.0, top))
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                arrays, [*batch.schema.names, "lang_pred", "score"]
            )

    schema = StructType([*plain.schema, *RESULTS])
    return plain.mapInArrow(predicted, schema)


def learnable(documents: DataFrame) -> DataFrame:
    """The rows outside the held-out third."""
    return documents.where(id_remainder(F.col("doc_id"), 3) != 1)


def identify(documents: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    names, vectors = prototypes(learnable(documents), rows)
    return predict(documents.select("doc_id", "text"), names, vectors).select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score",
    )
