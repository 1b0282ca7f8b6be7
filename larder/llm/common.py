"""Helpers the training-data operators share."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import shared_folder

# A worker serves the tasks of many stages. Glibc's own limits grow with the blocks it frees, so that
# a worker would keep up to 64 MB of them, and Arrow's own allocator more; like this it gives them back.
RELEASING = {
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed, and release what they free.

    They inherit the driver's environment, not its ``sys.path``. On a cluster without a
    shared path the package is deployed as usual (``--py-files``).
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    for name, value in RELEASING.items():
        environment.setdefault(name, value)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder not used before, where all executors can read and write."""
    return f"{shared_folder(spark)}/larder-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from the
    loss of an executor.

    ``narrow`` tables hold ids alone. They go to an eighth as many files as shuffles have
    partitions (at least one a core), so that repeated steps don't leave masses of tiny files.
    """
    spark = df.sparkSession
    if narrow:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, partitions // 8))
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; missing for a missing id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor
