"""Raw files to clean tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import fixed_values as V
from larder.operators import columns as C
from larder.operators import filters, joins, unions


def clean_currency(codes: DataFrame) -> DataFrame:
    """Distinct (Currency, AlphabeticCode) pairs of codes in use."""
    named = C.drop_columns(codes, *V.CURRENCY_UNUSED)
    used = filters.filter_exclude(named, "AlphabeticCode", V.EXCLUDED_CURRENCY_CODES)
    return used.select("Currency", "AlphabeticCode").distinct()


def clean_ppp(
    raw: DataFrame, first: int = 3, last: int = 44, unused: Sequence[str] = ("X2016",)
) -> DataFrame:
    """Conversion factors by country, one column per year used."""
    kept = C.drop_columns(C.drop_column_range(raw, first, last), *unused)
    return C.rename_columns(kept, V.RAW_PPP_NAMES)


def observations(
    raw: DataFrame, after: int = V.YEARS_AFTER, before: int = V.YEARS_BEFORE
) -> DataFrame:
    """Raw price rows of the years used, with clean names, month and date."""
    kept = C.drop_columns(raw, *V.RAW_FOOD_UNUSED)
    named = C.rename_columns(kept, V.RAW_FOOD_NAMES)
    return C.month_date(C.pad_month(filters.filter_range(named, "year", after, before)))


def clean_food(
    rows: DataFrame,
    region: DataFrame,
    groups: DataFrame,
    ppp: DataFrame,
    keep: Sequence[str] = (),
    complete: Sequence[str] | None = None,
    food_groups: Mapping[str, Iterable[str]] = V.GROUPED_FOOD_NAMES,
    region_rows: int | None = None,
    group_rows: int | None = None,
    ppp_rows: int | None = None,
    with_source_group: bool = False,
) -> DataFrame:
    """The clean price table from ``observations`` and the three dimension tables.

    Rows of foods that are not food, and rows with a missing field, are dropped before
    prices are converted; a missing conversion factor keeps its row. ``keep`` names
    further columns to carry, such as a row identity; ``complete`` the columns that may
    have gaps (default: all but those of ``keep``). The ``*_rows`` arguments are
    counted sizes of the dimensions; without them Spark's own size check decides.
    ``with_source_group`` keeps the joined group as ``source_food_group``.
    """
    names = C.rename_columns(C.drop_columns(region, "ppp_country_name"), V.RAW_REGION_NAMES)
    names, ppp = C.trim_country(names), C.trim_country(ppp)
    food = joins.join_region(C.recode_currency(C.trim_country(rows)), names, region_rows)
    food = joins.join_food_group(food, groups, group_rows)
    food = filters.filter_exclude(food, "food_group", V.EXCLUDED_FOOD_GROUPS)
    if complete is None:
        complete = [c for c in food.columns if c not in keep]
    food = filters.complete_cases(food, complete)
    food = food.withColumn("source_food_group", F.col("food_group"))
    food = C.unified_price(joins.join_ppp(food, ppp, ppp_rows))
    food = C.to_number(C.split_unit(C.normalize_unit(food)), "unit")
    food = unions.import_label_union(C.price_per_one_unit(food))
    extra = ["source_food_group"] if with_source_group else []
    return C.select_reorder(
        C.unify_food_group(food, food_groups), [*V.CLEAN_FOOD, *extra, *keep]
    )
