"""Counts, spread and cost per country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import NATIONAL_AVERAGE, RICE_GRAMS_PER_DAY
from larder.functions.aggregates import first_row, strict_mean
from larder.operators.filters import (
    complete_cases, filter_both_null, filter_label, filter_nonzero,
)


def distinct_pairs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names).distinct()


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def sorted_domain(df: DataFrame, name: str) -> DataFrame:
    """The distinct values in order, missing left out."""
    return df.filter(F.col(name).isNotNull()).select(name).distinct().orderBy(name)


def count_distinct(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_distinct(F.col(name)).alias("n"))


# Up to 2 ** SKETCH_BITS values are counted exactly; beyond, the relative standard error is
# 2 ** (-SKETCH_BITS / 2), under one percent. A sketch takes at most 16 bytes per value it holds.
SKETCH_BITS = 14


def distinct_sketches(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """A mergeable sketch of the distinct values of ``name`` per ``keys``, as ``sketch``.

    To be stored beside the table: later months add their own rows, and any choice of rows can
    be joined by ``count_distinct_of`` without reading the table again.
    """
    # Sketches pass over empty texts; a leading sign makes them values like any other.
    values = F.concat(F.lit("="), F.col(name).cast("string"))
    return df.groupBy(*keys).agg(F.theta_sketch_agg(values, SKETCH_BITS).alias("sketch"))


def count_distinct_of(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values per ``keys``, or in all, from stored ``distinct_sketches``."""
    joined = F.theta_union_agg("sketch", SKETCH_BITS)
    return sketches.groupBy(*keys).agg(F.theta_sketch_estimate(joined).alias("n"))


def strict_mean_by(df: DataFrame, keys: Sequence[str], name: str,
                   decimals: int | None = None) -> DataFrame:
    """Mean per group, missing if one value of the group is."""
    return df.groupBy(*keys).agg(strict_mean(F.col(name), decimals).alias(name))


def first_row_carry(
    df: DataFrame, keys: Sequence[str], carried: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The carried columns of each group's first row."""
    firsts = df.groupBy(*keys).agg(first_row(list(carried), order).alias("_first"))
    return firsts.select(*keys, "_first.*")


def frequency(df: DataFrame, name: str = "country", domain: DataFrame | None = None) -> DataFrame:
    """Rows per value as ``Var1``, ``Freq``; values only in ``domain`` count zero."""
    present = df.filter(F.col(name).isNotNull())
    counted = present.groupBy(F.col(name).alias("Var1")).agg(F.count(F.lit(1)).alias("Freq"))
    if domain is None:
        return counted
    listed = domain.select("Var1").join(counted, "Var1", "left")
    return listed.select("Var1", F.coalesce("Freq", F.lit(0)).alias("Freq"))


def countries_not_national(df: DataFrame) -> DataFrame:
    """Rows per country from markets other than the national average."""
    return frequency(filter_label(df, "market", NATIONAL_AVERAGE, keep=False))


def countries_without_national(df: DataFrame) -> DataFrame:
    """Countries with no published national average."""
    published = F.bool_or(F.col("market") == NATIONAL_AVERAGE)
    flags = df.groupBy("country").agg(F.coalesce(published, F.lit(False)).alias("_any"))
    return flags.filter(~F.col("_any")).select("country")


def countries_without_stdev(df: DataFrame) -> DataFrame:
    """Rows per country with neither spread nor inflation."""
    return frequency(filter_both_null(df, "stdv", "monthly_inflation"))


def inflation_stats(df: DataFrame, keys: Sequence[str] = ("country",)) -> DataFrame:
    """Mean and sample standard deviation of monthly inflation, missing rows skipped."""
    change = F.nanvl(F.col("monthly_inflation"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(
        F.avg(change).alias("avg_infla"), F.stddev_samp(change).alias("stdev")
    )


def report_order(stats: DataFrame) -> DataFrame:
    """Highest mean inflation first, missing last."""
    mean = F.nanvl(F.col("avg_infla"), F.lit(None).cast("double"))
    return stats.orderBy(mean.desc_nulls_last(), "country")


def cost_to_survive(
    df: DataFrame,
    grams_per_day: float = RICE_GRAMS_PER_DAY,
    keys: Sequence[str] = ("country", "year"),
) -> DataFrame:
    """Yearly cost of the daily rice: strict mean per country and year, times 365."""
    daily = df.withColumn("price_to_survive", grams_per_day * F.col("price_per_one_unit"))
    means = strict_mean_by(daily, keys, "price_to_survive")
    known = complete_cases(filter_nonzero(means, "price_to_survive"))
    return known.withColumn("price_to_survive", F.col("price_to_survive") * 365)
