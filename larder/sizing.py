"""When a table may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A row of a dimension or per-key table is a few names and numbers, under 200 bytes, so
# this many rows stay under 50 MB in every executor.
BROADCAST_ROWS = 250_000


def bounded(table: DataFrame, rows: int | None) -> DataFrame:
    """Mark ``table`` for broadcast if it is known to have few enough rows.

    ``rows`` is an upper bound the caller has counted, such as the rows of the country
    table for a table with one row per country. Without it, or above the limit, the
    table joins by shuffle, where adaptive execution splits the hot keys.
    """
    if rows is None or rows > BROADCAST_ROWS:
        return table
    return F.broadcast(table)
