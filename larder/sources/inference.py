"""Names and types of a CSV file that declares none."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed: names that may not stand as they are.
RESERVED = ("if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE",
            "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_character_", "in")
# Fixed: what reads as a logical value.
LOGICAL = ("T", "TRUE", "true", "True", "F", "FALSE", "false", "False")
WHOLE = r"^[+-]?\d+$"
NUMBER = r"^(NA|[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan)))$"


def repaired_names(header: Sequence[str | None]) -> list[str]:
    """Column names made valid: other characters than letters, digits, dots and underscores are
    dots, a name that starts with none of a letter or a dot without a digit gets an X before it,
    reserved words a dot after them, and repeated names a number."""
    names: list[str] = []
    for name in header:
        name = re.sub(r"[^\w.]", ".", name or "")
        if not re.match(r"[^\W\d_]|\.(?!\d)", name):
            name = "X" + name
        names.append(f"{name}." if name in RESERVED else name)
    taken, seen = set(names), set()
    for i, name in enumerate(names):
        number = 0
        while names[i] in seen or number and names[i] in taken:
            number += 1
            names[i] = f"{name}.{number}"
        seen.add(names[i])
    return names


KINDS = ("boolean", "int", "double")  # narrowest first; a bit each, from the lowest
# First letters of words that read as numbers (see NUMBER); others start with a sign, point or digit.
_NUMBER_LETTERS = [ord(c) for c in "NnIi"]


def _fits(text: Column) -> Column:
    """The narrower types that a text is of, as bits in the order of ``KINDS``.

    Patterns are tried on what may start a number only, and what is whole is a number too. Its size
    is read off its digits: a cast that fails makes an exception first, which costs far more.
    """
    plain = F.trim(text)
    start = F.ascii(plain)
    digits = F.rtrim(F.ltrim(plain, F.lit("+-0")), F.lit("\r\n"))
    small = digits.rlike(r"^\d{0,10}\z") & ((F.length(digits) < 10) | (digits < str(1 << 31)))
    return (
        F.when(text.isin(*LOGICAL), 1)
        .when(~(start.between(ord("+"), ord("9")) | start.isin(_NUMBER_LETTERS)), 0)
        .when(plain.rlike(WHOLE), F.when(small, 6).otherwise(4))
        .when(plain.rlike(NUMBER), 4)
        .otherwise(0)
    )


def inferred(raw: DataFrame, na: str) -> T.StructType:
    """The types of columns of text: logical, integer, double or text, the narrowest that all
    their values have.

    The missing token fits every type, blank fields every type but text; a column of nothing else
    is logical. Each column is one conjunction of bits, so one pass that merges partial results types
    any file, whatever row decides. A field is a row of its own there: what is generated for one
    column is small enough for the JVM to compile, for all of a wide file it is not.
    """
    fields = F.array(*(F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in raw.columns))
    texts = raw.select(F.posexplode(fields).alias("place", "text"))
    known = texts.where((F.col("text") != na) & (F.trim("text") != ""))
    found = known.groupBy("place").agg(F.bit_and(_fits(F.col("text"))).alias("fits")).collect()
    fits = {row["place"]: row["fits"] for row in found}  # a row a column
    types = []
    for i, name in enumerate(raw.columns):
        bits = fits.get(i, 7)
        kind = next((k for bit, k in enumerate(KINDS) if bits >> bit & 1), "string")
        types.append(T.StructField(name, T._parse_datatype_string(kind)))
    return T.StructType(types)
