"""The Spark session the library is written for."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession

# Runtime re-planning is what splits a hot country on the plain-join path and what
# sizes shuffles; the broadcast threshold is Spark's own check on a table's size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # HotSpot never compiles a method above 8000 bytes; such a stage runs operator by
    # operator instead, whose methods are small.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "larder", **settings: str) -> SparkSession:
    """A session with the library's settings; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    chosen = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="larder-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, for tables written between steps.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, only a
    local master, whose driver and executors are one process, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder(spark.sparkContext.applicationId)
