"""Bag unions, and unions that are really several labels on one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import IMPORT_BLOCKS, TOP_FOODS


def union_all(*tables: DataFrame, fill: bool = False) -> DataFrame:
    """All rows of all tables, matched by column name; ``fill`` allows absent columns."""
    def stack(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b, allowMissingColumns=fill)

    return reduce(stack, tables)


def import_block(label: str = "import") -> Column:
    """Place of the label's block in the clean table."""
    return F.array_position(F.array(*map(F.lit, IMPORT_BLOCKS)), F.col(label))


def import_label_union(df: DataFrame) -> DataFrame:
    """One row per import label of the food's name.

    A name containing "import" is Import, any other Not Import; a name containing
    "local" is Local as well, so its row appears twice.
    """
    name = F.col("food_name")
    imported = F.when(name.contains("import"), F.lit("Import"))
    labels = F.array(
        F.coalesce(imported, F.when(name.isNotNull(), F.lit("Not Import"))),
        F.when(name.contains("local"), F.lit("Local")),
    )
    # Dropping the gaps after the explode keeps all of it in generated code.
    labelled = df.withColumn("import", F.explode(labels))
    return labelled.filter(F.col("import").isNotNull())


def neither_union(df: DataFrame, as_written: bool = False) -> DataFrame:
    """Rows whose food name says neither import nor local.

    ``as_written`` stacks the rows that are not local on those that are not imported: a
    row with one of the two words then appears once and a row with none twice.
    """
    name = F.col("food_name")
    imported, local = name.contains("import"), name.contains("local")
    if not as_written:
        return df.filter(~imported & ~local)
    copies = (~imported).cast("int") + (~local).cast("int")
    repeated = df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.drop("_copy")


def top_foods_union(df: DataFrame, groups: Sequence[str] = TOP_FOODS) -> DataFrame:
    """The rows of the listed food groups, from one scan."""
    return df.filter(F.col("food_group").isin(list(groups)))
