"""Mixing sources to target weights.

Sources in code point order, the missing one last, weigh 1, 2, 3, 1, ... and share the words of
the whole corpus by weight. No target may exceed ``LIMIT`` times its source; what is above is
shared again by weight among the others until none is above. In the end all sources below their limit have the same words per weight,
so target = min(LIMIT * size, level * weight); the level follows from the sources in the order
in which they fill up.

A source's rate is target over size. Each document is emitted floor(rate) times, and once more
if a draw from the hash of its id and text is below the fraction.

Defined cases: a missing text has no words; a source without words has target 0 and rate 0.
Documents without an id are drawn by their texts; rows of equal id and text draw alike, as nothing
tells them apart. Texts of any length are counted whole. An empty table gives no rows. ``mix``
keeps every column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import unused, written

LIMIT = 3
WEIGHTS = 3
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that id and text decide."""
    digest = F.md5(F.concat(
        F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(sized: DataFrame) -> DataFrame:
    """source, source_size, target and rate of each source of ``sized`` (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", (number % WEIGHTS + 1).cast("long")).withColumn(
        "full", F.lit(LIMIT) * F.col("source_size")
    )
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    level = (  # if all sources that fill up earlier are full
        F.sum("source_size").over(total) - F.coalesce(F.sum("full").over(before), F.lit(0))
    ) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumn("level", level)
    reached = F.when(F.col("full") / F.col("weight") >= F.col("level"), F.col("level"))
    target = F.least(
        F.col("full").cast("double"), F.col("weight") * F.max(reached).over(total)
    )
    return levels.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(
            F.col("target") / F.col("source_size"), F.lit(float(LIMIT))
        )).otherwise(0.0).alias("rate"),
    )


def copies(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (drawn < rate - whole).cast("int")).cast("long")


def with_rates(documents: DataFrame, shares: DataFrame) -> DataFrame:
    """``documents`` with the other columns of ``shares``, one row per source."""
    source = unused(documents, "own_source")
    named = shares.withColumnRenamed("source", source)
    return documents.join(named, F.col("source").eqNullSafe(F.col(source))).drop(source)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, size, its source's size and target, and the words the mix takes of it."""
    sized = written(documents.select(
        "doc_id", "source", words(F.col("text")).alias("size"),
        draw(F.col("doc_id"), F.col("text")).alias("drawn")), "sizes")
    return with_rates(sized, rates(sized)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * copies(F.col("rate"), F.col("drawn"))).alias("taken"),
    )


def mix(documents: DataFrame) -> DataFrame:
    """The documents' columns, each document as often as the mix takes it."""
    shares = rates(documents.select("source", words(F.col("text")).alias("size")))
    rate, copy = unused(documents, "own_rate"), unused(documents, "own_copy")
    times = copies(F.col(rate), draw(F.col("doc_id"), F.col("text"))).cast("int")
    return with_rates(documents, shares.select("source", F.col("rate").alias(rate))).select(
        *documents.columns, F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy)
