"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import MIN_GROUP_ROWS
from larder.sizing import bounded


def filter_exclude(df: DataFrame, name: str, values: Iterable[str]) -> DataFrame:
    """Drop rows with one of ``values``, and rows where the column is missing."""
    return df.filter(~F.col(name).isin(list(values)))


def filter_range(df: DataFrame, name: str, after: Any, before: Any) -> DataFrame:
    """Keep rows strictly between the two ends."""
    return df.filter((F.col(name) > after) & (F.col(name) < before))


def filter_equals(df: DataFrame, **wanted: Any) -> DataFrame:
    """Keep rows where every named column has its value."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == value)
    return df


def filter_label(df: DataFrame, name: str, label: str, keep: bool = True) -> DataFrame:
    """Keep, or with ``keep=False`` drop, the rows of one label."""
    return df.filter(F.col(name) == label if keep else F.col(name) != label)


def filter_contains(df: DataFrame, name: str, part: str, keep: bool = True) -> DataFrame:
    """Keep or drop rows whose text contains ``part``; case matters.

    A missing text contains nothing, so dropping keeps it.
    """
    found = F.coalesce(F.col(name).contains(part), F.lit(False))
    return df.filter(found if keep else ~found)


def complete_cases(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value or NaN in any (or any named) column.

    Plain null tests, unlike a count of missing columns, reach the scan and turn the
    left joins below into inner joins.
    """
    known = F.lit(True)
    for name, kind in df.dtypes:
        if names is None or name in names:
            known &= F.col(name).isNotNull()
            if kind in ("double", "float"):
                known &= ~F.isnan(name)
    return df.filter(known)


def filter_both_null(df: DataFrame, one: str, other: str) -> DataFrame:
    return df.filter(F.col(one).isNull() & F.col(other).isNull())


def filter_nonzero(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name) != 0)


def min_group_size(
    df: DataFrame,
    keys: Sequence[str],
    rows: int = MIN_GROUP_ROWS,
    key_rows: int | None = None,
) -> DataFrame:
    """Keep the groups with at least ``rows`` rows.

    Counts are combined before they move and joined back, so no group gathers in a task.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = sizes.filter(F.col("_rows") >= rows).drop("_rows")
    return df.join(bounded(large, key_rows), list(keys), "left_semi")


def drop_outlier_rows(
    df: DataFrame, outliers: DataFrame, on: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Drop the rows named by ``outliers``, a list of at most ``rows`` keys.

    A listed key with a missing part names the rows where that part is missing.
    """
    marks = {name: f"_listed_{name}" for name in on}
    listed = bounded(outliers.select(*on).withColumnsRenamed(marks), rows)
    same = [F.col(name).eqNullSafe(F.col(mark)) for name, mark in marks.items()]
    return df.join(listed, same, "left_anti")


def drop_ordinals(df: DataFrame, ordinals: Iterable[int], name: str = "ordinal") -> DataFrame:
    """Drop the rows with these ordinals (from 1); ordinals past the end name no row."""
    return df.filter(~F.col(name).isin(list(ordinals)))


def drop_outliers_by_spread(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    spreads: float,
    key_rows: int | None = None,
) -> DataFrame:
    """Drop rows further than ``spreads`` standard deviations from their group's mean.

    Rows without a value, and groups too small for a deviation, are kept.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(name).alias("_mean"), F.stddev_samp(name).alias("_spread")
    )
    far: Column = F.abs(F.col(name) - F.col("_mean")) > spreads * F.col("_spread")
    joined = df.join(bounded(stats, key_rows), list(keys), "left")
    kept = joined.filter(~F.coalesce(far, F.lit(False)))
    return kept.select(*df.columns)
