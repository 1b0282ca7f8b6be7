"""Chat formatting: conversations rendered by a compiled template, with the loss mask.

``templates`` parses a template into a syntax tree, folds its constants and generates closures.
A conversation's turns, in order, are streamed through them. What comes out is stored in
segments of about ``SEGMENT`` code points (whole pieces of the template's output), each with
the spans a model would have written: begin and end in code points of the segment. A segment
is all of most conversations.

``TEMPLATE`` marks the turns and escapes control strings: ``<`` any number of backslashes and
``|`` gets one backslash more, so no text or role holds ``<|``, and taking one backslash away
gives the text back. ``turns_of`` reads turns back from the formatted text alone.

Rows go by turn (a missing turn first), rows of equal turn by role, then text. A conversation
is streamed by one task, as a digest of its turns has to be taken in order; the task holds a
segment and the longest turn, so a conversation of any number of turns passes.

Defined cases: a missing role or text is empty. Rows without ``conv_id`` are one conversation
of no id. Repeated rows are turns of their own. An empty table gives no rows. Very long texts
are one piece, and so one segment. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import importable, new_folder
from larder.llm.templates import CLOSE, OPEN, compiled, unescape

TEMPLATE = """\
{%- for turn in messages -%}
<|im_start|>{{ turn.role | escape }}<|im_sep|>
{%- if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}
{%- else %}{{ turn.text | escape }}{% endif -%}
<|im_end|>{{ '\\n' }}
{%- endfor -%}
"""
START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SEGMENT = 1 << 20
ROWS = 512  # segments in a batch, at most SEGMENT code points together or one segment
FORMATTED = "conv_id long, part int, text string, spans array<struct<begin:int,end:int>>"
SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()),
    ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
])


def segments(pieces: Iterator, limit: int = SEGMENT) -> Iterator[tuple[str, list[dict]]]:
    """The rendered pieces joined to texts of about ``limit`` code points, with their spans."""
    texts: list[str] = []
    spans: list[dict] = []
    size, begun = 0, None
    for piece in pieces:
        if piece is OPEN:
            begun = size
        elif piece is CLOSE:
            spans.append({"begin": begun, "end": size})
            begun = None
        else:
            texts.append(piece)
            size += len(piece)
        if size >= limit:
            if begun is not None:
                spans.append({"begin": begun, "end": size})
                begun = 0
            yield "".join(texts), spans
            texts, spans, size = [], [], 0
    if texts or spans:
        yield "".join(texts), spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 256).columns))


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text): every conversation's rows in one task, in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part (from 0), text and spans: the segments of every conversation."""
    importable(conversations.sparkSession)
    compiled(template)  # an error in it shows at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        held, size = [], 0
        for conv_id, rows in groupby(_rows(batches), key=lambda row: row[0]):
            messages = ({"role": role, "text": text} for _, role, text in rows)
            for part, (text, spans) in enumerate(segments(render(messages=messages))):
                held.append({"conv_id": conv_id, "part": part, "text": text, "spans": spans})
                size += len(text)
                if size >= SEGMENT or len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, SEGMENTS)
                    held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, SEGMENTS)

    return in_order(conversations).mapInArrow(run, FORMATTED)


class Reader:
    """Turns and digests of one conversation from its segments, in order."""

    def __init__(self):
        self.rest = ""  # what is not yet a whole turn
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for span in spans:
            found = unescape(text[span["begin"]:span["end"]])
            self.loss_chars += len(found)
            self.loss.update(found.encode())
        *turns, self.rest = (self.rest + text).split(END + "\n")
        for turn in turns:
            role, _, said = turn.removeprefix(START).partition(BETWEEN)
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(said)}\n".encode())


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation that ``TEMPLATE`` has formatted."""
    parts = (turn.removeprefix(START).partition(BETWEEN) for turn in text.split(END + "\n")[:-1])
    return [(unescape(role), unescape(said)) for role, _, said in parts]


def digests(segments_read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every
    conversation, from its formatted segments alone."""
    importable(segments_read.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                 "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held: list[tuple] = []
        for conv_id, rows in groupby(_rows(batches), key=lambda row: row[0]):
            reader = Reader()
            for _, _, text, spans in rows:
                reader.add(text, spans)
            held.append((conv_id, reader.turns, reader.all.hexdigest(), reader.loss_chars,
                         reader.loss.hexdigest(), reader.chars))
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                held = []
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*held) if held else [[]] * 6, kinds)], names)

    ordered = segments_read.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
             "loss_sha256 string, formatted_chars long")


def write_chats(conversations: DataFrame, folder: str, template: str = TEMPLATE) -> None:
    formatted(conversations, template).write.parquet(folder)


def read_chats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FORMATTED).parquet(folder)


def report(conversations: DataFrame) -> DataFrame:
    """Format the conversations to a new folder and read the files back."""
    folder = new_folder(conversations.sparkSession, "chats")
    write_chats(conversations, folder)
    return digests(read_chats(conversations.sparkSession, folder))
