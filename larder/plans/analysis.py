"""Clean table to analysis tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import fixed_values as V
from larder.operators import averages, filters, statistics, unions, windows

RICE = "Rice"


def group_analysis(
    clean: DataFrame,
    order: Sequence[str],
    groups: Sequence[str] = V.TOP_FOODS,
    regions: Sequence[str] = V.WORLD_REGIONS,
    without: Sequence[str] = V.COUNTRIES_WITHOUT_PPP,
    key_rows: int | None = None,
    **options,
) -> dict[str, DataFrame]:
    """All tables of the listed food groups, every group in the same pass.

    ``series`` feeds the other tables: persist or save it before running several.
    Spread and averages are taken from the market rows, before national rows replace
    them.
    """
    chosen = unions.top_foods_union(clean, groups)
    series = windows.food_group_by(chosen, order, key_rows=key_rows)
    return {"series": series, **tables_of(series, order, regions, without, **options)}


def tables_of(
    series: DataFrame,
    order: Sequence[str],
    regions: Sequence[str] = V.WORLD_REGIONS,
    without: Sequence[str] = V.COUNTRIES_WITHOUT_PPP,
    outliers: DataFrame | None = None,
    **options,
) -> dict[str, DataFrame]:
    """The tables computed from the series with monthly inflation.

    ``outliers`` names rows by its columns: they count for the spread, and are left out of
    every average.
    """
    stats = statistics.inflation_stats(series, ["food_group", "country"])
    if outliers is not None:
        series = filters.drop_outlier_rows(series, outliers, outliers.columns)
    national = averages.join_published_else_computed(
        series, order, ["food_group", "country", "date"], without, **options
    )
    return {
        "stats": stats,
        "world": averages.world_average(series, order, ["food_group", "date"], **options),
        "region": averages.region_average_all(
            series, order, regions, ["food_group", "region", "date"], **options
        ),
        "import": averages.import_type_grouping(
            series, order, keys=["food_group", "import", "date"], **options
        ),
        "national": national,
        "cost_to_survive": statistics.cost_to_survive(
            filters.filter_equals(national, food_group=RICE), keys=["food_group", "country", "year"]
        ),
    }


def import_comparison(
    rows: DataFrame,
    order: Sequence[str],
    countries: Sequence[str] | None = V.IMPORT_COMPARISON_COUNTRIES,
    as_written: bool = False,
    **options,
) -> DataFrame:
    """National averages of imported, local and other food of a few countries.

    A name with both words counts under both. ``as_written`` counts into Not Listed
    every row that lacks one of the words, twice if it lacks both. All labels are one
    aggregation. ``countries=None`` takes every country.
    """
    chosen = rows if countries is None else rows.filter(F.col("country").isin(list(countries)))
    name = F.col("food_name")
    imported, local = name.contains("import"), name.contains("local")
    labels = [F.when(local, F.lit("Local")), F.when(imported, F.lit("Import"))]
    neither = F.lit("Not Listed")
    if as_written:
        labels += [F.when(~local, neither), F.when(~imported, neither)]
    else:
        labels.append(F.when(~local & ~imported, neither))
    labelled = chosen.withColumn("import", F.explode(F.array(*labels)))
    labelled = labelled.filter(F.col("import").isNotNull())
    return averages.national_average(labelled, order, ["country", "import", "date"], **options)


def inflation_report(series: DataFrame) -> DataFrame:
    """Countries by mean inflation, highest first, with the spread."""
    return statistics.report_order(statistics.inflation_stats(series))
