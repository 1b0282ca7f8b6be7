"""Aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(values: Column, decimals: int | None = None) -> Column:
    """Mean of the values present.

    ``decimals`` names a column with that many decimal places (a price in cents): its
    sum is then exact, so the mean does not depend on the order rows arrive in.
    """
    if decimals is None:
        return F.avg(values)
    total = F.sum(values.cast(f"decimal(18,{decimals})")).cast("double")
    return F.try_divide(total, F.count(values))


def strict_mean(values: Column, decimals: int | None = None) -> Column:
    """Mean that is missing as soon as one value is missing."""
    return F.when(F.count(values) == F.count(F.lit(1)), mean(values, decimals))


def first_row(columns: Sequence[str], order: Sequence[str]) -> Column:
    """The named columns of the row that comes first in ``order``.

    ``order`` must tell all rows apart, otherwise Spark may pick any of the ties.
    """
    return F.min_by(F.struct(*columns), F.struct(*order))
