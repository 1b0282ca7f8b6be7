"""From input files to saved tables to the report, as three separate jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from larder import fixed_values as V
from larder.operators.statistics import report_order
from larder.operators.unions import import_block
from larder.plans import analysis, cleaning
from larder.sources import schemas
from larder.sources.csv import read_csv, write_csv
from larder.sources.tables import load_tables, save_tables

# File names of the inputs under one folder.
FILES = {
    "currency": "currency_codes.csv",
    "ppp": "ppp.csv",
    "food": "food_prices.csv",
    "region": "country_region.csv",
    "groups": "food_groups.csv",
}

# The published rows have no identity of their own: the columns that tell them apart,
# the label's block first, then date.
ROW_ORDER = (
    "import_block", "date", "market", "food_name", "seller_type", "unit", "currency", "city",
    "price",
)


def clean_inputs(spark: SparkSession, source: str, root: str) -> DataFrame:
    """Read the raw files, write the clean tables under ``root``; returns the food table.

    The clean tables are also written as CSV, the form they are published in.
    """
    codes = read_csv(spark, f"{source}/{FILES['currency']}", schemas.CURRENCY_CODES)
    write_csv(cleaning.clean_currency(codes), f"{root}/csv/currency_codes")
    wide = read_csv(spark, f"{source}/{FILES['ppp']}", schemas.ppp_wide(), na="")
    write_csv(cleaning.clean_ppp(wide), f"{root}/csv/ppp")

    years = ", ".join(f"X{y} double" for y in range(V.YEARS_AFTER + 1, V.YEARS_BEFORE))
    ppp = read_csv(
        spark, f"{root}/csv/ppp", f"country string, country_code string, {years}"
    )
    raw = read_csv(spark, f"{source}/{FILES['food']}", schemas.FOOD_RAW)
    region = read_csv(spark, f"{source}/{FILES['region']}", schemas.COUNTRY_REGION)
    groups = read_csv(spark, f"{source}/{FILES['groups']}", schemas.FOOD_GROUPS)
    # The dimensions are small files: counting them is the check on broadcasting them.
    clean = cleaning.clean_food(
        cleaning.observations(raw), region, groups, ppp,
        region_rows=region.count(), group_rows=groups.count(), ppp_rows=ppp.count(),
    )
    save_tables({"food": clean}, root)
    food = load_tables(spark, root, ["food"])["food"]
    write_csv(food, f"{root}/csv/food")
    return food


def analyse(
    spark: SparkSession,
    root: str,
    order: Sequence[str] = ROW_ORDER,
    **options,
) -> None:
    """Read the clean food table under ``root`` and write every analysis table there."""
    food = load_tables(spark, root, ["food"])["food"]
    clean = food.withColumn("import_block", import_block())
    tables = analysis.group_analysis(clean, order, **options)
    # The series feeds all the others: written once, read back with its columns pruned.
    save_tables({"series": tables["series"]}, root)
    series = load_tables(spark, root, ["series"])["series"]
    regions = {k: options.pop(k) for k in ("regions", "without") if k in options}
    options.pop("groups", None)
    save_tables(analysis.tables_of(series, order, **regions, **options), root)


def report(spark: SparkSession, root: str, group: str = "Rice") -> DataFrame:
    """The report of one food group from the saved tables."""
    stats = load_tables(spark, root, ["stats"])["stats"]
    chosen = stats.filter(stats.food_group == group)
    return report_order(chosen.select("country", "avg_infla", "stdev"))
