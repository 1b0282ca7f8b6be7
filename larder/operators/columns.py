"""Projection, renaming and derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import CLEAN_FOOD, GROUPED_FOOD_NAMES
from larder.functions import scalars as S


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by name; names that are absent are ignored."""
    return df.drop(*names)


def drop_column_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Drop the columns at positions ``first`` to ``last``, counted from 1."""
    kept = [c for i, c in enumerate(df.columns, 1) if not first <= i <= last]
    return df.select(*(F.col(f"`{c}`") for c in kept))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename old -> new; old names that are absent are ignored."""
    return df.withColumnsRenamed(dict(names))


def select_reorder(df: DataFrame, names: Iterable[str] = CLEAN_FOOD) -> DataFrame:
    return df.select(*names)


def add_constant(df: DataFrame, name: str, value: Any) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def pad_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", S.pad_month(F.col("month")))


def month_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", S.month_date(F.col("year"), F.col("month")))


def trim_country(df: DataFrame) -> DataFrame:
    """Names that differ only in outer spaces are one country."""
    return df.withColumn("country", F.trim("country"))


def recode_currency(df: DataFrame) -> DataFrame:
    return df.withColumn("currency", S.recode_currency(F.col("currency")))


def normalize_unit(df: DataFrame) -> DataFrame:
    return df.withColumn("unit", S.normalize_unit(F.col("unit")))


def split_unit(df: DataFrame) -> DataFrame:
    """``unit`` "1000 G" becomes ``unit`` "1000" and ``unit_type`` "G"."""
    unit = F.col("unit")
    return df.withColumns({"unit": S.unit_amount(unit), "unit_type": S.unit_type(unit)})


def to_number(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, S.to_number(F.col(name)))


def unified_price(df: DataFrame) -> DataFrame:
    """Price in purchasing-power terms."""
    return df.withColumn("unified_price", S.divide(F.col("price"), F.col("ppp_factor")))


def price_per_one_unit(df: DataFrame) -> DataFrame:
    """Purchasing-power price of one gram, litre or piece."""
    price = S.divide(F.col("unified_price"), F.col("unit"))
    return df.withColumn("price_per_one_unit", price)


def unify_food_group(
    df: DataFrame, groups: Mapping[str, Iterable[str]] = GROUPED_FOOD_NAMES
) -> DataFrame:
    """Set ``food_group`` from the food's name; unlisted foods are their own group."""
    return df.withColumn("food_group", S.group_of_name(F.col("food_name"), groups))


def contains_label(df: DataFrame) -> DataFrame:
    """Set ``import`` to one label per row: Import, Local or Not Listed."""
    return df.withColumn("import", S.import_label(F.col("food_name")))
