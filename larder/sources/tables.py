"""Saved tables: one Parquet dataset each, published all at once.

A call of ``save_tables`` writes its tables to a new folder under ``root/versions`` and, when all
of them are whole, adds one small file of pointers (table, folder, version) to ``root/published``.
A reader follows the newest pointer of each table, so it sees all tables of a call or none, and a
job that dies half-way leaves the former ones as they were. Older versions stay readable until
whoever owns the folder removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.sizing import bounded

PARTITION = "food_group"


POINTERS = "name string, folder string, version long"


def write_table(table: DataFrame, path: str) -> None:
    """Write one table, split by food group where it has one.

    Rows of one food group go to few files; adaptive execution cuts a group that is too
    large for one task.
    """
    if PARTITION in table.columns:
        writer = table.hint("rebalance", PARTITION).write.partitionBy(PARTITION)
    else:
        writer = table.write
    writer.mode("overwrite").parquet(path)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """The newest published folder of every table under ``root``: name, folder, version."""
    # Creates an empty list where there is none, and changes nothing elsewhere.
    spark.createDataFrame([], POINTERS).write.mode("append").parquet(f"{root}/published")
    listed = spark.read.schema(POINTERS).parquet(f"{root}/published")
    newest = F.max_by(F.struct("folder", "version"), F.struct("version", "folder")).alias("_newest")
    return listed.groupBy("name").agg(newest).select("name", "_newest.*")


def save_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write every table, then publish all of them at once as the newest versions.

    Of two calls at a time the one with the later version wins, or, of equal versions, the one
    with the greater folder name: for all the tables both have.
    """
    spark = next(iter(tables.values())).sparkSession
    version = 1 + (pointers(spark, root).agg(F.max("version")).first()[0] or 0)
    folder = f"versions/{version}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        write_table(table, f"{root}/{folder}/{name}")
    listed = spark.createDataFrame([(name, folder, version) for name in tables], POINTERS)
    listed.coalesce(1).write.mode("append").parquet(f"{root}/published")


def load_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The newest published version of the named tables."""
    names = list(names)
    newest = pointers(spark, root).where(F.col("name").isin(names)).collect()  # a row a name
    folders = {row["name"]: row["folder"] for row in newest}
    absent = [name for name in names if name not in folders]
    if absent:
        raise FileNotFoundError(f"not published under {root}: {', '.join(absent)}")
    return {name: spark.read.parquet(f"{root}/{folders[name]}/{name}") for name in names}


def save_in_order(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write ``df`` so that its files, by number, and the rows in each follow ``order``."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def load_with_ordinals(spark: SparkSession, path: str, name: str = "ordinal") -> DataFrame:
    """A table of ``save_in_order`` with every row's place in it, from 1 and without gaps.

    A row's place is its place in its file, which the file itself tells, plus the rows of the
    files before: rows are neither sorted nor moved.
    """
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    table = spark.read.parquet(path)
    rows = table.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = rows.groupBy(F.col("_file").alias("_number")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_number", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(bounded(files, len(table.inputFiles())), F.col("_file") == F.col("_number"))
    return placed.select(
        *table.columns, (F.col("_before") + F.col("_row") + 1).alias(name))
