"""Averages by date over the world, regions, countries, sellers and import labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.fixed_values import (
    IMPORT_LABELS, NATIONAL_AVERAGE, SELLER_TYPES, WORLD_REGIONS,
)
from larder.functions.aggregates import first_row, mean, strict_mean
from larder.operators.filters import filter_label

AVERAGED = ("price_per_one_unit", "unified_price", "ppp_factor", "price")


def average_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    drop: Sequence[str] = (),
    strict: bool = True,
    decimals: Mapping[str, int] | None = None,
    also: Mapping[str, object] | None = None,
) -> DataFrame:
    """Means of the price columns per ``keys``.

    The columns in ``drop`` go away; all others carry the value of the group's first row
    in ``order``. ``strict`` makes a mean missing if one input is. ``decimals`` gives the
    decimal places of columns that have a fixed number. Everything is combined before
    the shuffle, so the size of a group does not matter. ``also`` adds aggregates.
    """
    decimals, also = decimals or {}, also or {}
    averaged = [c for c in AVERAGED if c in df.columns and c not in drop]
    gone = {*keys, *averaged, *drop}
    carried = [c for c in df.columns if c not in gone]
    combine = strict_mean if strict else mean
    aggregates = [combine(F.col(c), decimals.get(c)).alias(c) for c in averaged]
    if carried:
        aggregates.append(first_row(carried, order).alias("_first"))
    aggregates += [column.alias(name) for name, column in also.items()]
    grouped = df.groupBy(*keys).agg(*aggregates)
    out = [c for c in df.columns if c not in drop]
    columns = [F.col("_first")[c].alias(c) if c in carried else F.col(c) for c in out]
    return grouped.select(*columns, *also)


def world_average(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("date",),
                  **options) -> DataFrame:
    """Means over all countries by date."""
    unused = ("country", "city", "country_income_group", "country_code", "seller_type",
              "market", "region")
    averaged = average_by(df, keys, order, unused, **options)
    return averaged.withColumn("country", F.lit("World"))


def region_average_all(
    df: DataFrame,
    order: Sequence[str],
    regions: Sequence[str] = WORLD_REGIONS,
    keys: Sequence[str] = ("region", "date"),
    **options,
) -> DataFrame:
    """Means by region and date over the listed regions; others are left out."""
    unused = ("country", "city", "country_income_group", "country_code", "seller_type",
              "market")
    listed = df.filter(F.col("region").isin(list(regions)))
    return average_by(listed, keys, order, unused, **options)


def region_average(df: DataFrame, order: Sequence[str], region: str, **options) -> DataFrame:
    """Means by date within one region."""
    return region_average_all(df, order, [region], **options)


def seller_type_average(
    df: DataFrame, order: Sequence[str], sellers: Sequence[str] = SELLER_TYPES, **options
) -> DataFrame:
    """Means by seller type and date over the listed types."""
    unused = ("country", "city", "country_income_group", "country_code", "market",
              "region")
    listed = df.filter(F.col("seller_type").isin(list(sellers)))
    return average_by(listed, ["seller_type", "date"], order, unused, **options)


def import_type_grouping(
    df: DataFrame,
    order: Sequence[str],
    labels: Sequence[str] = IMPORT_LABELS,
    keys: Sequence[str] = ("import", "date"),
    **options,
) -> DataFrame:
    """Means by import label and date."""
    unused = ("city", "country_income_group", "country_code", "seller_type", "market",
              "region")
    listed = df.filter(F.col("import").isin(list(labels)))
    return average_by(listed, keys, order, unused, **options)


def import_type_average(df: DataFrame, order: Sequence[str], label: str, **options) -> DataFrame:
    """Means by date within one import label."""
    return import_type_grouping(df, order, [label], **options)


def national_average(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("country", "date"),
    also: Mapping[str, object] | None = None,
    **options,
) -> DataFrame:
    """Means by country and date, as rows of a market called National Average.

    Where the input has monthly inflation, ``stdv`` is its sample standard deviation
    over all dates of the country. It comes from the count, mean and variance of each
    date, so the input is read once.
    """
    also = dict(also or {})
    spread = "monthly_inflation" in df.columns
    if spread:
        change = F.col("monthly_inflation")
        also |= {"_n": F.count(change), "_mean": F.avg(change), "_var": F.var_pop(change)}
    averaged = average_by(df, keys, order, also=also, **options)
    renamed = averaged.withColumns(
        {"city": F.lit(""), "market": F.lit(NATIONAL_AVERAGE)}
    )
    if not spread:
        return renamed
    whole = Window.partitionBy(*[k for k in keys if k != "date"])
    n = F.sum("_n").over(whole)
    centre = F.try_divide(F.sum(F.col("_n") * F.col("_mean")).over(whole), n)
    centred = renamed.withColumns({"_total": n, "_centre": centre})
    offset = F.col("_mean") - F.col("_centre")
    squares = F.sum(F.col("_n") * (F.col("_var") + offset * offset)).over(whole)
    stdv = F.when(F.col("_total") > 1, F.sqrt(squares / (F.col("_total") - 1)))
    return centred.withColumn("stdv", stdv).drop("_n", "_mean", "_var", "_total", "_centre")


def join_published_else_computed(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("country", "date"),
    without: Sequence[str] = (),
    **options,
) -> DataFrame:
    """National rows: published ones, and computed averages for the other countries.

    A country counts as published if any of its rows is. Whether one is comes out of
    the same aggregation as the averages. ``without`` names countries whose computed
    averages are left out.
    """
    published = F.col("market") == NATIONAL_AVERAGE
    flag = {"_published": F.coalesce(F.bool_or(published), F.lit(False))}
    averaged = national_average(df, order, keys, also=flag, **options)
    whole = Window.partitionBy(*[k for k in keys if k != "date"])
    computed = (
        averaged.withColumn("_any", F.bool_or("_published").over(whole))
        .filter(~F.col("_any"))
        .drop("_any", "_published")
    )
    if without:
        computed = computed.filter(~F.col("country").isin(list(without)))
    given = filter_label(df, "market", NATIONAL_AVERAGE)
    return given.unionByName(computed, allowMissingColumns=True)
