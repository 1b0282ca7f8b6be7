"""Dimension joins and their preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sizing import bounded


def join_region(food: DataFrame, region: DataFrame, rows: int | None = None) -> DataFrame:
    """Add country code, income group and region; unknown countries keep their rows."""
    return food.join(bounded(region, rows), "country", "left")


def join_food_group(food: DataFrame, groups: DataFrame, rows: int | None = None) -> DataFrame:
    """Add the food group listed for the food's name."""
    return food.join(bounded(groups, rows), "food_name", "left")


def unpivot_years(wide: DataFrame, ids: Sequence[str], prefix: str = "X") -> DataFrame:
    """One column per year -> one row per year: ids, ``year``, ``ppp_factor``."""
    years = [
        c for c in wide.columns if c.startswith(prefix) and c[len(prefix):].isdigit()
    ]
    long = wide.unpivot(list(ids), years, "_year", "ppp_factor")
    year = F.substring("_year", len(prefix) + 1, 4).cast("int")
    return long.select(*ids, year.alias("year"), "ppp_factor")


def join_ppp(
    food: DataFrame,
    wide: DataFrame,
    rows: int | None = None,
    on: str = "country",
    order: Sequence[str] = ("country", "country_code"),
) -> DataFrame:
    """Add the country's ``ppp_factor`` of the row's year, missing where none is known.

    A country listed twice gives its first row in ``order``: the lookup never adds
    rows. ``rows`` bounds the rows of ``wide``. As the lookup is one row per country and
    year by construction, Spark drops the join where the factor is not used.
    """
    long = unpivot_years(wide, list(dict.fromkeys([on, *order])))
    factor = F.min_by("ppp_factor", F.struct(*order)).alias("ppp_factor")
    known = long.groupBy(on, "year").agg(factor)
    year_rows = None if rows is None else rows * len(wide.columns)
    return food.join(bounded(known, year_rows), [on, "year"], "left")


def join_full_frequency(
    frequency: DataFrame, domain: DataFrame, as_written: bool = False
) -> DataFrame:
    """Row counts against the full list of names, missing where there are no rows.

    ``as_written`` also matches on the count, which a listed name never has, so a
    counted name appears once with its count and once without.
    """
    if as_written:
        empty = domain.select("Var1", F.lit(None).cast("long").alias("Freq"))
        return frequency.unionByName(empty)
    return frequency.join(domain.select("Var1"), "Var1", "full_outer")


def join_grid(df: DataFrame, values: DataFrame, key: str, years: range) -> DataFrame:
    """Every ``key`` of ``df`` with every year, filled from ``values`` where known."""
    calendar = F.array(*(F.lit(y) for y in years))
    grid = df.select(key).distinct().select(key, F.explode(calendar).alias("year"))
    return grid.join(values, [key, "year"], "left")
