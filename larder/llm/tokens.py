"""Token ids in files of fixed-width packed bits.

A file is a Parquet part of packs. A pack holds whole documents in order: the width in bits
(the least that the vocabulary needs), the number of ids, each document's id and first
position, and the ids themselves. Ids are packed in groups of 64: a group takes ``width``
64-bit words, so group g starts at word g * width and any id is found by arithmetic alone;
numpy packs and unpacks all groups at once.

Documents are range-partitioned and sorted by id. Each ends with the id ``END``. The first
position of a document in the whole corpus is its place in its pack, plus the packs before it.

A text is encoded in pieces: before each single space that stands between other characters,
and inside a piece new to the worker, between a letter and a mark or a line end. The
vocabulary's own splitting always starts a new token there, so the ids equal those of the
whole text; a worker remembers pieces from task to task, in two generations of ``REMEMBERED``.

Defined cases: a missing text is an empty one, a single ``END``. Rows of equal or missing ids
are all kept, missing ids first, equal ids in the order of their texts' hashes and texts. Special
tokens spelt out in a text are ordinary text. An empty table gives no rows. A text is one value
and in one pack, however long. Other columns are passed over.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import importable, new_folder

VOCABULARY = "byte_bpe_50k.json"
END = 0
PACK_IDS = 1 << 18
REMEMBERED = 500_000
# A single space between characters that are not white space.
BETWEEN = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
# Inside a piece: a letter before a mark or line end, and around a line end alone.
LETTER = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"
INSIDE = re.compile(
    rf"(?<={LETTER})(?=[.,;:!?|\n])|(?<=[.,;:!?|])(?=\n{LETTER})|(?<=\S\n)(?={LETTER})"
)
PACKS = (
    "part int, pack int, low long, high long, width int, n_ids long, doc_ids binary, no_ids binary, starts binary, "
    "words binary"
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bits_needed(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids below 2**width -> 64-bit words, ``width`` of them for each 64 ids."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[:len(ids)] = ids
    padded = padded.reshape(groups, 64)
    words = np.zeros((groups, width + 1), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[:, word] |= padded[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= padded[:, i] >> np.uint64(64 - shift)
    return words[:, :width].reshape(-1)


def unpack_ids(words: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive), reading only their groups."""
    low, high = first // 64, -(-last // 64)
    groups = words.reshape(-1, width)[low:high]
    out = np.empty((len(groups), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = groups[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (groups[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(-1)[first - 64 * low:last - 64 * low].astype(np.uint32)


# Byte-level vocabularies spell printable bytes as themselves, the others from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
SPELLING = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


class Remembered(dict):
    """Keys -> what ``find`` gives for them, in two generations: what is used of the old one is
    young again, so frequent keys stay and rare ones go."""

    def __init__(self, find):
        self.find = find
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        self[key] = found
        return found

    def age(self, most: int) -> None:
        """Once more than ``most`` keys are young, they are the old ones."""
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Texts -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known = Remembered(self._after_space)
        self.parts = Remembered(self._part)
        self.width = bits_needed(self.tokenizer.get_vocab_size())

    def __call__(self, text: str) -> bytes:
        for remembered in (self.known, self.parts):
            remembered.age(REMEMBERED)
        first, *rest = text.split(" ") if self._plain(text) else BETWEEN.split(text)
        return self._piece(first) + b"".join(map(self.known.__getitem__, rest))

    def _after_space(self, piece: str) -> bytes:
        """The ids of a space and ``piece``."""
        if piece.isascii():
            if piece.isalpha():
                return self._letters(SPELLING[32] + piece)
            if piece[-1:] in (".", ",") and piece[:-1].isalpha():
                return self.known[piece[:-1]] + self.parts[piece[-1]]
        first, *rest = INSIDE.split(" " + piece)
        if not rest:
            return self._part(first)
        return self.known[first[1:]] + b"".join([self.parts[part] for part in rest])

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.parts[part] for part in INSIDE.split(piece)])

    def _part(self, part: str) -> bytes:
        word = part[1:] if part[:1] == " " else part
        if word.isalpha() and (word.isascii() or max(word) <= "\u024f"):
            return self._letters(part.encode().decode("latin-1").translate(SPELLING))
        return self._packed(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _letters(self, spelt: str) -> bytes:
        """Letters after at most one space, in the vocabulary's spelling: the splitting leaves
        them whole."""
        return self._packed([token.id for token in self.model.tokenize(spelt)])

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bool:
        """Every space stands between other characters."""
        return (
            text.replace("\n", "").isprintable() and "  " not in text and " \n" not in text
            and "\n " not in text and text[:1] != " " and text[-1:] != " "
        )


@cache
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker: texts of later tasks use pieces met by earlier ones."""
    return Encoder(path)


def write_packs(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode ``documents`` (doc_id, text) and write them to ``folder``."""
    spark = documents.sparkSession
    importable(spark)
    path = path or vocabulary_path()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = encoder_of(path)
        ids: list[int | None] = []
        pieces: list[bytes] = []
        size = 0

        def pack():
            width = encoder.width
            lengths = np.array([len(p) // 4 for p in pieces], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            words = pack_ids(np.frombuffer(b"".join(pieces), "<u4"), width)
            known = [i for i in ids if i is not None]
            row = (part, number, min(known, default=None), max(known, default=None), width,
                   int(starts[-1]),
                   np.array([i or 0 for i in ids], "<i8").tobytes(),
                   np.array([i is None for i in ids], np.uint8).tobytes(),
                   starts.astype("<i8").tobytes(), words.astype("<u8").tobytes())
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                     *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types)],
                [field.split()[0] for field in PACKS.split(", ")],
            )

        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = encoder(text.as_py() or "")
                ids.append(doc_id)
                pieces.append(coded + end)
                size += len(coded) // 4 + 1
                if size >= PACK_IDS:
                    yield pack()
                    ids, pieces, size, number = [], [], 0, number + 1
        if ids:
            yield pack()

    (
        # Rows of one id, or of none, may be very many: the text's hash deals them out too.
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
        .mapInArrow(encode, PACKS).write.parquet(folder)
    )


def read_packs(spark, folder: str) -> DataFrame:
    """A row per document: doc_id, start, n_tokens and the crc32 of its ids, from the files."""
    importable(spark)
    packs = spark.read.schema(PACKS).parquet(folder)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    sums = packs.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    parts = sums.select(  # a row per file
        F.col("part").alias("_part"),
        F.coalesce(F.sum("all_ids").over(earlier), F.lit(0)).alias("_before"),
    )
    starts = packs.select(
        F.col("part").alias("_part"), F.col("pack").alias("_pack"),
        F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_inside"),
    ).join(parts, "_part").select(
        "_part", "_pack", (F.col("_before") + F.col("_inside")).alias("first")
    )
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, pack, _, _, width, _, doc_ids, no_ids, starts, words = (
                    column[row].as_py() for column in batch.columns
                )
                places = np.frombuffer(starts, "<i8")
                ids = unpack_ids(np.frombuffer(words, "<u8"), width, 0, int(places[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                n = len(places) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, pack, np.int32)),
                     pa.array(np.frombuffer(doc_ids, "<i8"),
                              mask=np.frombuffer(no_ids, np.uint8).astype(bool)),
                     pa.array(places[:-1]), pa.array(np.diff(places)),
                     pa.array([zlib.crc32(raw[4 * a:4 * b])
                               for a, b in zip(places[:-1], places[1:])], pa.int64())],
                    ["part", "pack", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    rows = packs.mapInArrow(
        decode, "part int, pack int, doc_id long, place long, n_tokens long, ids_crc32 long"
    )
    return rows.join(
        starts, (rows.part == starts._part) & (rows.pack == starts._pack)
    ).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def ids_of(spark, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document of this id, by random access: the packs that may hold it are
    found by their lowest and highest id, and only its own groups are unpacked."""
    found = []
    wanted = spark.read.schema(PACKS).parquet(folder).where(
        (F.col("low") <= doc_id) & (F.col("high") >= doc_id)
    )
    for row in wanted.orderBy("part", "pack").select("width", "doc_ids", "no_ids", "starts", "words").toLocalIterator():
        ids = np.frombuffer(row.doc_ids, "<i8")
        places = np.frombuffer(row.starts, "<i8")
        known = np.frombuffer(row.no_ids, np.uint8) == 0
        for i in np.flatnonzero((ids == doc_id) & known):
            words = np.frombuffer(row.words, "<u8")
            found.append(unpack_ids(words, row.width, int(places[i]), int(places[i + 1])))
    return found


def binary_output(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents to a new folder and read them back."""
    folder = new_folder(documents.sparkSession, "packs")
    write_packs(documents, folder, path)
    return read_packs(documents.sparkSession, folder)
