"""Queries for the chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import averages, charts, statistics
from larder.operators.quantiles import coded_counts
from larder.registry import twins as T
from larder.registry.analysis import COST, cost, rounded
from larder.registry.inputs import CLEAN_ORDER, REGIONS, Inputs
from larder.registry.queries import query



@query("series_table", T.select(
    T.CLEAN, "country AS facet, import AS colour, date, price_per_one_unit AS value", "clean",
    "ORDER BY ALL"))
def series_table(t: Inputs) -> DataFrame:
    return charts.series_table(t.clean(), "price_per_one_unit", "import", "country")


@query("series_table_inflation", T.select(
    T.INFLATION, "seller_type AS colour, date, monthly_inflation AS value", "inflation",
    "ORDER BY ALL"))
def series_table_inflation(t: Inputs) -> DataFrame:
    return charts.series_table(t.with_inflation(), "monthly_inflation", "seller_type")


@query("trend_table", f"""WITH {T.CLEAN}, points AS (
SELECT country, CAST(year AS INT) * 12 + CAST(month AS INT) - 1 AS month_index, unified_price AS y
FROM clean WHERE unified_price IS NOT NULL),
monthly AS (SELECT country, month_index, count(*) AS points, sum(y) AS total
            FROM points GROUP BY country, month_index),
line AS (SELECT country, regr_slope(y, month_index) AS slope,
                regr_intercept(y, month_index) AS intercept FROM points GROUP BY country)
SELECT a.country, a.month_index, a.points, round(sum(b.total) / sum(b.points), 4) AS smooth,
       round(any_value(slope), 4) AS slope, round(any_value(intercept), 2) AS intercept
FROM monthly a JOIN monthly b ON a.country = b.country
     AND b.month_index BETWEEN a.month_index - 6 AND a.month_index + 6
JOIN line l ON a.country = l.country
GROUP BY a.country, a.month_index, a.points""")
def trend_table(t: Inputs) -> DataFrame:
    trend = charts.trend_table(t.clean(), "unified_price", ["country"])
    return rounded(rounded(trend, "smooth", "slope"), "intercept", places=2)


@query("local_trend_table", f"""WITH {T.CLEAN}, monthly AS (
SELECT country, CAST(year AS INT) * 12 + CAST(month AS INT) - 1 AS x, count(*) AS n,
       avg(unified_price) AS y FROM clean WHERE unified_price IS NOT NULL GROUP BY ALL),
pairs AS (
SELECT a.country, a.x AS centre, a.n AS points, b.x - a.x AS d, b.n, b.y,
       sum(b.n) OVER (PARTITION BY a.country, a.x ORDER BY abs(b.x - a.x)) AS counted,
       sum(b.n) OVER (PARTITION BY a.country, a.x) AS total
FROM monthly a JOIN monthly b ON a.country = b.country),
reached AS (
SELECT *, min(CASE WHEN counted >= greatest(floor(total * 0.75::DOUBLE + 1e-5), 1) THEN abs(d) END)
          OVER (PARTITION BY country, centre) AS reach FROM pairs),
weighed AS (
SELECT country, centre, points, y, CASE WHEN reach > 0 THEN d / reach::DOUBLE ELSE 0 END AS u,
       n * pow(1 - pow(CASE WHEN reach > 0 THEN abs(d) / reach::DOUBLE ELSE 0 END, 3), 3) AS w
FROM reached WHERE abs(d) < reach OR d = 0),
m AS (
SELECT country, centre, points, count(*) AS months, sum(w) AS s0, sum(w * u) AS s1,
       sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
       sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2
FROM weighed GROUP BY country, centre, points)
SELECT country, centre AS month_index, points, round(CASE WHEN months >= 3 THEN
  (t0 * (s2 * s4 - s3 * s3) - t1 * (s1 * s4 - s2 * s3) + t2 * (s1 * s3 - s2 * s2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
  WHEN months = 2 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 3) AS smooth
FROM m""")
def local_trend_table(t: Inputs) -> DataFrame:
    trend = charts.local_trend_table(t.clean(), "unified_price", ["country"])
    return rounded(trend, "smooth", places=3)


def _histogram(source: str, table: str, keys: str) -> str:
    on = " AND ".join(f"v.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"v.{k.strip()}" for k in keys.split(","))
    return f"""WITH {source}, v AS (SELECT * FROM {table} WHERE monthly_inflation IS NOT NULL),
b AS (SELECT {keys}, min(monthly_inflation) AS low, max(monthly_inflation) AS high
      FROM v GROUP BY {keys})
SELECT {named}, low, high, CASE WHEN low = high THEN 1 ELSE
       least(CAST(floor(25.0::DOUBLE * (monthly_inflation - low) / (high - low)) AS INT) + 1, 25)
       END AS bin, count(*) AS count
FROM v JOIN b ON {on} GROUP BY ALL"""


@query("histogram_table", _histogram(T.SERIES, "series", "food_group"))
def histogram_table(t: Inputs) -> DataFrame:
    return charts.histogram_table(t.series(), ["food_group"], key_rows=t.names)


@query("region_country_histogram", _histogram(T.INFLATION, "inflation", "region, country"))
def region_country_histogram(t: Inputs) -> DataFrame:
    return charts.region_country_histogram(t.with_inflation(), key_rows=t.nations)


def _boxplot(source: str, table: str, keys: str) -> str:
    on = " AND ".join(f"v.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"v.{k.strip()}" for k in keys.split(","))
    inside = ("monthly_inflation BETWEEN lower - 1.5 * (upper - lower) "
              "AND upper + 1.5 * (upper - lower)")
    return f"""WITH {source}, v AS (SELECT * FROM {table} WHERE monthly_inflation IS NOT NULL),
q AS (SELECT {keys}, quantile_cont(monthly_inflation, 0.25) AS lower,
             quantile_cont(monthly_inflation, 0.5) AS middle,
             quantile_cont(monthly_inflation, 0.75) AS upper FROM v GROUP BY {keys})
SELECT {named}, round(lower, 6) AS lower, round(middle, 6) AS middle, round(upper, 6) AS upper,
       round(min(CASE WHEN {inside} THEN monthly_inflation END), 6) AS whisker_low,
       round(max(CASE WHEN {inside} THEN monthly_inflation END), 6) AS whisker_high,
       CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM v JOIN q ON {on} GROUP BY {named}, lower, middle, upper"""


def _box(t: Inputs, df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    coded = t.stored("coded", coded_counts(df, "monthly_inflation", keys))
    box = charts.boxplot_of(coded, keys, key_rows=rows)
    return rounded(
        box, "lower", "middle", "upper", "whisker_low", "whisker_high", places=6
    )


@query("boxplot_table", _boxplot(T.INFLATION, "inflation", "region, country"))
def boxplot_table(t: Inputs) -> DataFrame:
    return _box(t, t.with_inflation(), ["region", "country"], t.nations)


@query("boxplot_table_region", _boxplot(T.INFLATION, "inflation", "region"))
def boxplot_table_region(t: Inputs) -> DataFrame:
    return _box(t, t.with_inflation(), ["region"], t.nations)


@query("boxplot_table_food_group", _boxplot(T.SERIES, "series", "food_group"))
def boxplot_table_food_group(t: Inputs) -> DataFrame:
    return _box(t, t.series(), ["food_group"], t.names)


@query("boxplot_table_import", _boxplot(T.INFLATION, "inflation", "country, import"))
def boxplot_table_import(t: Inputs) -> DataFrame:
    # Three import labels.
    return _box(t, t.with_inflation(), ["country", "import"], 3 * t.nations)


@query("bar_table", f"{COST} "
       "SELECT CAST(year(date) AS INT) AS facet, country, "
       "round(365 * avg(769.23076923 * price_per_one_unit), 0) AS price_to_survive "
       "FROM national GROUP BY country, facet "
       "HAVING count(price_per_one_unit) = count(*) AND avg(price_per_one_unit) <> 0")
def bar_table(t: Inputs) -> DataFrame:
    return charts.bar_table(cost(t))


@query("spread_vs_mean", T.select(
    T.INFLATION, "country, round(avg(monthly_inflation), 6) AS avg_infla, "
    "round(stddev_samp(monthly_inflation), 6) AS stdev", "inflation", "GROUP BY country"))
def spread_vs_mean(t: Inputs) -> DataFrame:
    stats = statistics.inflation_stats(t.with_inflation())
    return rounded(charts.spread_vs_mean(stats), "avg_infla", "stdev", places=6)


@query("region_country_series", T.select(
    T.CLEAN, "c.region, c.country, c.date, c.price_per_one_unit AS value, s.layout",
    "clean c JOIN (SELECT region, CASE WHEN count(DISTINCT country) <= 4 THEN 'combined' "
    "ELSE 'per_country' END AS layout FROM clean GROUP BY region) s ON c.region = s.region"))
def region_country_series(t: Inputs) -> DataFrame:
    return charts.region_country_series(t.clean(), region_rows=t.nations)


@query("region_series", T.select(
    T.CLEAN, f"region, date, {T.mean('unified_price', False)} AS value", "clean",
    "GROUP BY region, date"))
def region_series(t: Inputs) -> DataFrame:
    region = averages.region_average_all(t.clean(), CLEAN_ORDER, REGIONS, strict=False)
    lines = charts.region_series(region, "unified_price")
    return lines.withColumn("value", F.round("value", 4))
