"""Queries for aggregates, averages, windows, order and the analysis pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import averages, filters, statistics, unions, windows
from larder.plans import analysis
from larder.registry import twins as T
from larder.registry.inputs import (
    CLEAN_ORDER, GROUPS, ORDER, REGIONS, ROW_ID, Inputs,
)
from larder.registry.queries import query

ID = list(ROW_ID)
# Decimal places of the columns that have a fixed number of them.
DECIMALS = {"price": 2, "ppp_factor": 4}
CENTS = {"decimals": DECIMALS}
TOP = "food_group IN ('Rice', 'Maize', 'Sorghum', 'Beans', 'Millet', 'Oil')"


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    """Round sums of doubles, whose last bits depend on the order of the rows."""
    return df.withColumns({n: F.round(n, places) for n in names})


def means_of(df: DataFrame) -> DataFrame:
    return rounded(df.drop(*CLEAN_ORDER), "price_per_one_unit", "unified_price")


# Aggregates ------------------------------------------------------------------------


@query("distinct_values", T.select(T.OBS, "DISTINCT food_name", "obs"))
def distinct_values(t: Inputs) -> DataFrame:
    return statistics.distinct_values(t.obs(), "food_name")


@query("count_distinct", T.select(T.OBS, "count(DISTINCT food_name) AS n", "obs"))
def count_distinct(t: Inputs) -> DataFrame:
    return statistics.count_distinct(t.obs(), "food_name")


@query("count_distinct_sketch", T.select(
    T.OBS, "year(l_shipdate) AS year, count(DISTINCT food_name) AS n", "obs",
    "GROUP BY year(l_shipdate)"))
def count_distinct_sketch(t: Inputs) -> DataFrame:
    """Foods a year from stored sketches a month; exact, as the twin is, up to 16,384 foods."""
    rows = t.obs().select("food_name", F.date_trunc("month", "l_shipdate").alias("first_day"))
    monthly = t.stored("sketches", statistics.distinct_sketches(rows, "food_name", ["first_day"]))
    yearly = monthly.withColumn("year", F.year("first_day"))
    return statistics.count_distinct_of(yearly, ["year"])


@query("frequency_by_country", T.select(
    T.CLEAN, "n_name AS Var1, count(country) AS Freq",
    "nation LEFT JOIN clean ON n_name = country", "GROUP BY n_name"))
def frequency_by_country(t: Inputs) -> DataFrame:
    domain = t.table("nation").select(F.col("n_name").alias("Var1"))
    return statistics.frequency(t.clean(), domain=domain)


@query("strict_mean", T.select(
    T.CLEAN, f"country, year, {T.mean('unified_price')} AS unified_price", "clean",
    "GROUP BY country, year"))
def strict_mean(t: Inputs) -> DataFrame:
    means = statistics.strict_mean_by(t.clean(), ["country", "year"], "unified_price")
    return rounded(means, "unified_price")


@query("first_row_carry", T.select(
    T.OBS, f"country, date, market, food_name, unit, {T.ID}",
    f"(SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY {T.ID}) AS place "
    "FROM obs)", "WHERE place = 1"))
def first_row_carry(t: Inputs) -> DataFrame:
    carried = ["market", "food_name", "unit", *ID]
    return statistics.first_row_carry(t.obs(), ["country", "date"], carried, ORDER)


CARRIED_WORLD = "year, month, import, food_group, food_name, unit_type, unit, currency"


@query("world_average", T.average(
    T.CLEAN, "clean", "date", CARRIED_WORLD, constants="'World' AS country"))
def world_average(t: Inputs) -> DataFrame:
    return means_of(averages.world_average(t.clean(), CLEAN_ORDER, **CENTS))


@query("world_average_present", T.average(
    T.CLEAN, "clean", "date", CARRIED_WORLD, strict=False,
    constants="'World' AS country"))
def world_average_present(t: Inputs) -> DataFrame:
    return means_of(
        averages.world_average(t.clean(), CLEAN_ORDER, strict=False, **CENTS)
    )


@query("region_average", T.average(
    T.CLEAN, "clean", "region, date", CARRIED_WORLD, where="region = 'ASIA'"))
def region_average(t: Inputs) -> DataFrame:
    return means_of(averages.region_average(t.clean(), CLEAN_ORDER, "ASIA", **CENTS))


@query("region_average_all", T.average(
    T.CLEAN, "clean", "region, date", CARRIED_WORLD, strict=False))
def region_average_all(t: Inputs) -> DataFrame:
    return means_of(averages.region_average_all(
        t.clean(), CLEAN_ORDER, REGIONS, strict=False, **CENTS
    ))


@query("seller_type_average", T.average(
    T.CLEAN, "clean", "seller_type, date", CARRIED_WORLD, strict=False))
def seller_type_average(t: Inputs) -> DataFrame:
    return means_of(averages.seller_type_average(
        t.clean(), CLEAN_ORDER, strict=False, **CENTS
    ))


CARRIED_IMPORT = "country, year, month, food_group, food_name, unit_type, unit, currency"


@query("import_type_average", T.average(
    T.CLEAN, "clean", "import, date", CARRIED_IMPORT, where="import = 'Local'"))
def import_type_average(t: Inputs) -> DataFrame:
    return means_of(averages.import_type_average(t.clean(), CLEAN_ORDER, "Local", **CENTS))


@query("import_type_grouping", T.average(
    T.CLEAN, "clean", "import, date", CARRIED_IMPORT, strict=False))
def import_type_grouping(t: Inputs) -> DataFrame:
    return means_of(averages.import_type_grouping(
        t.clean(), CLEAN_ORDER, strict=False, **CENTS
    ))


CARRIED_NATIONAL = (
    "country_code, country_income_group, region, year, month, seller_type, import, "
    "food_group, food_name, unit_type, unit, currency"
)
NATIONAL = "'' AS city, 'National Average' AS market"


@query("national_average", T.average(
    T.CLEAN, "clean", "country, date", CARRIED_NATIONAL, constants=NATIONAL))
def national_average(t: Inputs) -> DataFrame:
    return means_of(averages.national_average(t.clean(), CLEAN_ORDER, **CENTS))


@query("national_average_stdv", T.select(
    T.INFLATION,
    "country, date, round(avg(unified_price), 4) AS unified_price, "
    "round(any_value(s), 4) AS stdv",
    "inflation JOIN (SELECT country AS c, stddev_samp(monthly_inflation) AS s "
    "FROM inflation GROUP BY country) ON country = c", "GROUP BY country, date"))
def national_average_stdv(t: Inputs) -> DataFrame:
    averaged = averages.national_average(t.with_inflation(), CLEAN_ORDER, strict=False)
    out = averaged.select("country", "date", "unified_price", "stdv")
    return rounded(out, "unified_price", "stdv")


PUBLISHED = f"""{T.CLEAN}, published AS (
SELECT DISTINCT country FROM clean WHERE market = 'National Average')"""
NATIONAL_ROWS = f"""
SELECT country, date, food_name, market, price_per_one_unit, unified_price, ppp_factor, price
FROM clean WHERE market = 'National Average'
UNION ALL
SELECT country, date, arg_min(food_name, (import_block, l_shipdate, l_orderkey, l_linenumber, l_partkey,
       l_suppkey)), 'National Average',
       {", ".join(T.mean(m, False) for m in T.MEANS)}
FROM clean WHERE country NOT IN (SELECT country FROM published) GROUP BY country, date"""


@query("join_published_else_computed", f"WITH {PUBLISHED} SELECT country, date, food_name, "
       "market, round(price_per_one_unit, 4) AS price_per_one_unit, "
       f"round(unified_price, 4) AS unified_price, ppp_factor, price FROM ({NATIONAL_ROWS})")
def join_published_else_computed(t: Inputs) -> DataFrame:
    rows = averages.join_published_else_computed(
        t.clean(), CLEAN_ORDER, strict=False, **CENTS
    )
    return rounded(rows, "price_per_one_unit", "unified_price").select(
        "country", "date", "food_name", "market", "price_per_one_unit", "unified_price",
        "ppp_factor", "price",
    )


@query("inflation_stats", T.select(
    T.INFLATION, "country, round(avg(monthly_inflation), 6) AS avg_infla, "
    "round(stddev_samp(monthly_inflation), 6) AS stdev", "inflation", "GROUP BY country"))
def inflation_stats(t: Inputs) -> DataFrame:
    stats = statistics.inflation_stats(t.with_inflation())
    return rounded(stats, "avg_infla", "stdev", places=6)


# The cost of rice: no other food counts, also for which countries are published.
COST = f"""WITH {T.CLEAN}, rice AS (SELECT * FROM clean WHERE food_group = 'Rice'), published AS (
SELECT DISTINCT country FROM rice WHERE market = 'National Average'), national AS (
SELECT country, date, price_per_one_unit FROM rice WHERE market = 'National Average'
UNION ALL SELECT country, date, avg(price_per_one_unit) FROM rice
WHERE country NOT IN (SELECT country FROM published) GROUP BY country, date)"""


def cost(t: Inputs) -> DataFrame:
    rice = filters.filter_equals(t.clean(), food_group="Rice")
    national = averages.join_published_else_computed(rice, CLEAN_ORDER, strict=False, **CENTS)
    return rounded(statistics.cost_to_survive(national), "price_to_survive", places=0)


@query("cost_to_survive", f"{COST}, yearly AS (SELECT *, year(date) AS year FROM national) "
       "SELECT country, CAST(year AS INT) AS year, "
       "round(365 * avg(769.23076923 * price_per_one_unit), 0) AS price_to_survive "
       "FROM yearly GROUP BY country, year "
       "HAVING count(price_per_one_unit) = count(*) AND avg(price_per_one_unit) <> 0")
def cost_to_survive(t: Inputs) -> DataFrame:
    return cost(t)


@query("min_group_size", T.select(
    T.CLEAN, f"{T.ID}, import, country, food_name",
    "(SELECT *, count(*) OVER (PARTITION BY country, food_name) AS size FROM clean)",
    "WHERE size >= 10"))
def min_group_size(t: Inputs) -> DataFrame:
    kept = filters.min_group_size(
        t.clean(), ["country", "food_name"], key_rows=t.group_rows
    )
    return kept.select(*ID, "import", "country", "food_name")


@query("countries_not_national", T.select(
    T.CLEAN, "country AS Var1, count(*) AS Freq", "clean",
    "WHERE market <> 'National Average' GROUP BY country"))
def countries_not_national(t: Inputs) -> DataFrame:
    return statistics.countries_not_national(t.clean())


@query("countries_without_national", T.select(
    T.CLEAN, "DISTINCT country", "clean", "WHERE country NOT IN "
    "(SELECT country FROM clean WHERE market = 'National Average')"))
def countries_without_national(t: Inputs) -> DataFrame:
    return statistics.countries_without_national(t.clean())


@query("countries_without_stdev", f"""WITH {T.SERIES}, published AS (
SELECT DISTINCT food_group, country FROM series WHERE market = 'National Average'),
national AS (
SELECT country, CAST(NULL AS DOUBLE) AS stdv, monthly_inflation FROM series
WHERE market = 'National Average'
UNION ALL
SELECT f.country, s.stdv, f.monthly_inflation FROM
(SELECT *, row_number() OVER (PARTITION BY food_group, country, date
 ORDER BY import_block, {T.ID}) AS place FROM series) f
JOIN (SELECT food_group, country, stddev_samp(monthly_inflation) AS stdv FROM series
      GROUP BY food_group, country) s ON f.food_group = s.food_group AND f.country = s.country
WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM published p
 WHERE p.food_group = f.food_group AND p.country = f.country))
SELECT country AS Var1, count(*) AS Freq FROM national
WHERE stdv IS NULL AND monthly_inflation IS NULL GROUP BY country""")
def countries_without_stdev(t: Inputs) -> DataFrame:
    # Without the text columns, which the first row of a date would carry along.
    series = t.series().select(
        *CLEAN_ORDER, "food_group", "country", "date", "market", "monthly_inflation")
    national = averages.join_published_else_computed(
        series, CLEAN_ORDER, ["food_group", "country", "date"]
    )
    return statistics.countries_without_stdev(national)


# Windows ---------------------------------------------------------------------------


@query("monthly_inflation", T.select(
    T.INFLATION, f"{T.ID}, import, country, price, monthly_inflation", "inflation"))
def monthly_inflation(t: Inputs) -> DataFrame:
    return t.with_inflation().select(*ID, "import", "country", "price", "monthly_inflation")


# Supplier and part names are nearly unique here: without them the series are long.
SERIES_KEYS = "country, city, seller_type, currency, unit"


@query("monthly_inflation_series", T.select(
    T.OBS, f"{T.ID}, {SERIES_KEYS}, 100 * (price / NULLIF(lag(price) OVER ("
    f"PARTITION BY {SERIES_KEYS} ORDER BY {T.ID}), 0) - 1) AS monthly_inflation", "obs"))
def monthly_inflation_series(t: Inputs) -> DataFrame:
    keys = SERIES_KEYS.split(", ")
    rows = windows.monthly_inflation_series(t.stored("obs", t.obs()), ORDER, keys)
    return rows.select(*ID, *keys, "monthly_inflation")


@query("food_group_by", T.select(
    T.SERIES, f"{T.ID}, import, food_group, country, price, monthly_inflation", "series"))
def food_group_by(t: Inputs) -> DataFrame:
    return t.series().select(
        *ID, "import", "food_group", "country", "price", "monthly_inflation"
    )


@query("country_food_series", T.select(
    T.CLEAN, f"{T.ID}, import, country, food_name, 100 * (price / NULLIF(lag(price) OVER ("
    f"PARTITION BY country, food_name ORDER BY import_block, {T.ID}), 0) - 1) AS monthly_inflation",
    "(SELECT *, count(*) OVER (PARTITION BY country, food_name) AS size FROM clean)",
    "WHERE size >= 10"))
def country_food_series(t: Inputs) -> DataFrame:
    rows = windows.country_food_series(
        t.stored_clean(), CLEAN_ORDER, key_rows=t.group_rows
    )
    return rows.select(*ID, "import", "country", "food_name", "monthly_inflation")


# Order -----------------------------------------------------------------------------


@query("report_order", T.select(
    T.INFLATION, "country, round(avg(monthly_inflation), 6) AS avg_infla, "
    "round(stddev_samp(monthly_inflation), 6) AS stdev", "inflation",
    "GROUP BY country ORDER BY avg_infla DESC NULLS LAST, country"))
def report_order(t: Inputs) -> DataFrame:
    stats = statistics.inflation_stats(t.with_inflation())
    return statistics.report_order(rounded(stats, "avg_infla", "stdev", places=6))


@query("sorted_domain", T.select(T.CLEAN, "DISTINCT country", "clean", "ORDER BY country"))
def sorted_domain(t: Inputs) -> DataFrame:
    return statistics.sorted_domain(t.clean(), "country")


# Pipelines -------------------------------------------------------------------------

ROUNDED = ("round(price_per_one_unit, 4) AS price_per_one_unit, "
           "round(unified_price, 4) AS unified_price, ppp_factor, price")


def _part(table: str, key: str, where: str = "true") -> str:
    means = ", ".join(f"{T.mean(m, False)} AS {m}" for m in T.MEANS)
    return (f"SELECT '{table}' AS level, food_group, {key} AS key, date, {means} "
            f"FROM series WHERE {TOP} AND {where} GROUP BY food_group, key, date")


GROUP_ANALYSIS = f"""WITH {T.SERIES}, published AS (
SELECT DISTINCT food_group AS g, country AS c FROM series WHERE market = 'National Average')
{_part("world", "'World'")} UNION ALL {_part("region", "region")}
UNION ALL {_part("import", "import")} UNION ALL {_part(
    "national", "country",
    "NOT EXISTS (SELECT 1 FROM published WHERE g = food_group AND c = country)")}
UNION ALL SELECT 'national', food_group, country, date, round(price_per_one_unit, 4),
round(unified_price, 4), ppp_factor, price FROM series
WHERE {TOP} AND market = 'National Average'"""


def _group_series(t: Inputs) -> DataFrame:
    """Like the published pipeline: the clean table, then the series, are written once and
    read back, with their columns and food groups pruned."""
    return t.stored("series", analysis.group_analysis(
        t.stored_clean(), CLEAN_ORDER, tuple(GROUPS), key_rows=t.group_rows
    )["series"])


def _stacked(series: DataFrame, outliers: DataFrame | None = None) -> DataFrame:
    tables = analysis.tables_of(
        series, CLEAN_ORDER, REGIONS, outliers=outliers, strict=False, **CENTS)
    keys = {"world": "country", "region": "region", "import": "import", "national": "country"}
    parts = [
        tables[level].select(
            F.lit(level).alias("level"), "food_group", F.col(key).alias("key"), "date",
            *averages.AVERAGED,
        )
        for level, key in keys.items()
    ]
    return rounded(unions.union_all(*parts), "price_per_one_unit", "unified_price")


@query("group_analysis", GROUP_ANALYSIS)
def group_analysis(t: Inputs) -> DataFrame:
    """Every average of the six groups, stacked."""
    return _stacked(_group_series(t))


# Each country's dearest row of a group is the one that is out of line.
LISTED = f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (
PARTITION BY food_group, country ORDER BY price DESC, import_block, {T.ID}) AS place FROM series)
WHERE place > 1), published AS ("""


@query("group_analysis_outliers", GROUP_ANALYSIS.replace(
    "FROM series\nWHERE", "FROM series WHERE").replace("FROM series WHERE", "FROM kept WHERE").replace(
    "published AS (", LISTED, 1))
def group_analysis_outliers(t: Inputs) -> DataFrame:
    """The averages without a list of rows, the dearest of each country and group."""
    series = _group_series(t)
    keys = ["food_group", "country", *CLEAN_ORDER]
    dearest = statistics.first_row_carry(
        series.withColumn("cheapness", -F.col("price")), ["food_group", "country"],
        list(CLEAN_ORDER), ["cheapness", *CLEAN_ORDER])
    return _stacked(series, t.stored("outliers", dearest.select(*keys)))


@query("group_analysis_stats", T.select(
    T.SERIES, "food_group, country, round(avg(monthly_inflation), 6) AS avg_infla, "
    "round(stddev_samp(monthly_inflation), 6) AS stdev", "series",
    f"WHERE {TOP} GROUP BY food_group, country"))
def group_analysis_stats(t: Inputs) -> DataFrame:
    tables = analysis.group_analysis(
        t.stored_clean(), CLEAN_ORDER, tuple(GROUPS), key_rows=t.group_rows
    )
    return rounded(tables["stats"], "avg_infla", "stdev", places=6)


def _label(name: str, where: str) -> str:
    return f"SELECT *, '{name}' AS label FROM rice WHERE {where}"


def _comparison(neither: str) -> str:
    means = ", ".join(f"{T.mean(m, False)} AS {m}" for m in T.MEANS)
    return f"""WITH {T.CLEAN}, rice AS (SELECT * FROM clean WHERE food_group = 'Rice'),
stacked AS ({_label("Local", "food_name LIKE '%local%'")}
UNION ALL {_label("Import", "food_name LIKE '%import%'")} UNION ALL {neither})
SELECT country, label AS import, date, 'National Average' AS market, {means}
FROM stacked GROUP BY country, label, date"""


def _compare(t: Inputs, as_written: bool, countries=None) -> DataFrame:
    rice = filters.filter_equals(t.clean(), food_group="Rice")
    compared = analysis.import_comparison(
        rice, CLEAN_ORDER, countries, as_written, strict=False, **CENTS
    )
    columns = ["country", "import", "date", "market", *averages.AVERAGED]
    return rounded(compared.select(*columns), "price_per_one_unit", "unified_price")


@query("import_comparison", _comparison(
    _label("Not Listed", "food_name NOT LIKE '%local%' AND food_name NOT LIKE '%import%'")))
def import_comparison(t: Inputs) -> DataFrame:
    return _compare(t, as_written=False)


FEW = ("NATION_1", "NATION_4", "NATION_9")


@query("import_comparison_countries", _comparison(
    _label("Not Listed", "food_name NOT LIKE '%local%' AND food_name NOT LIKE '%import%'")
).replace("GROUP BY country, label", f"WHERE country IN {FEW} GROUP BY country, label"))
def import_comparison_countries(t: Inputs) -> DataFrame:
    return _compare(t, as_written=False, countries=FEW)


@query("import_comparison_as_written", _comparison(
    _label("Not Listed", "food_name NOT LIKE '%local%'") + " UNION ALL "
    + _label("Not Listed", "food_name NOT LIKE '%import%'")))
def import_comparison_as_written(t: Inputs) -> DataFrame:
    return _compare(t, as_written=True)


@query("inflation_report", T.select(
    T.SERIES, "country, round(avg(monthly_inflation), 6) AS avg_infla, "
    "round(stddev_samp(monthly_inflation), 6) AS stdev", "series",
    "WHERE food_group = 'Rice' GROUP BY country ORDER BY avg_infla DESC NULLS LAST, country"))
def inflation_report(t: Inputs) -> DataFrame:
    """The report of one group: rice."""
    rice = windows.food_group_by(
        t.stored_clean(), CLEAN_ORDER, "Rice", key_rows=t.group_rows
    )
    report = analysis.inflation_report(rice)
    return rounded(report, "avg_infla", "stdev", places=6)
