"""Queries for sources, columns, filters, joins and unions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import fixed_values as V
from larder.functions import scalars as S
from larder.operators import columns as C
from larder.operators import filters, joins, statistics, unions
from larder.plans import cleaning
from larder.registry import twins as T
from larder.registry.inputs import AFTER, BEFORE, GROUPS, ROW_ID, YEARS, Inputs
from larder.registry.queries import query
from larder.session import shared_folder
from larder.sources.csv import read_csv, write_csv
from larder.sources.tables import (
    load_tables, load_with_ordinals, save_in_order, save_tables,
)

ID = list(ROW_ID)


def _folder(t: Inputs) -> str:
    return f"{shared_folder(t.spark)}/larder-{uuid.uuid4().hex}"


# Sources and sinks -----------------------------------------------------------------

PRICES_DDL = (
    "country string, city string, market string, date date, year int, month int, "
    "seller_type string, food_name string, unit string, currency string, price double"
)
PRICES = [c.split()[0] for c in PRICES_DDL.split(", ")]


@query("src_csv", T.select(T.OBS, PRICES, "obs"))
def src_csv(t: Inputs) -> DataFrame:
    path = _folder(t)
    write_csv(t.obs().select(*PRICES), path)
    return read_csv(t.spark, path, PRICES_DDL)


@query("src_csv_na", T.select(T.PPP, "*", "ppp"))
def src_csv_na(t: Inputs) -> DataFrame:
    path, ppp = _folder(t), t.ppp()
    write_csv(ppp, path, na="")
    ddl = ", ".join(f"{name} {kind}" for name, kind in ppp.dtypes)
    return read_csv(t.spark, path, ddl, na="")


@query("src_csv_inferred", T.select(
    T.OBS, "country, market, CAST(date AS VARCHAR) AS date, year, unit, price, "
    "l_linenumber % 2 = 0 AS even, l_linenumber AS line, l_orderkey * 10000000.0::DOUBLE AS large, "
    "CASE WHEN l_linenumber = 7 THEN price ELSE l_partkey END::DOUBLE AS late, "
    "CASE WHEN l_linenumber = 7 THEN 'none' ELSE l_partkey::VARCHAR END AS word", "obs"))
def src_csv_inferred(t: Inputs) -> DataFrame:
    """Columns of each type, some of which only a few rows tell from a narrower one."""
    path, last = _folder(t), F.col("l_linenumber") == 7
    rows = t.obs().select(
        "country", "market", "date", "year", "unit", "price",
        (F.col("l_linenumber") % 2 == 0).alias("even"), F.col("l_linenumber").alias("line"),
        (F.col("l_orderkey") * 10_000_000).cast("double").alias("large"),
        F.when(last, F.col("price")).otherwise(F.col("l_partkey").cast("double")).alias("late"),
        F.when(last, F.lit("none")).otherwise(F.col("l_partkey").cast("string")).alias("word"))
    write_csv(rows, path)
    return read_csv(t.spark, path)


@query("src_csv_header", T.select(T.PPP, "*", "ppp"))
def src_csv_header(t: Inputs) -> DataFrame:
    """A file whose header is spelt as published, in another order than the schema's."""
    path, raw = _folder(t), t.ppp_raw()
    spelt = {name: name.replace(".", " ").removeprefix("X") for name in raw.columns}
    published = raw.select(*(F.col(f"`{name}`").alias(spelt[name]) for name in reversed(raw.columns)))
    write_csv(published, path, na="")
    years = ", ".join(f"X{y} double" for y in YEARS)
    wide = read_csv(t.spark, path, f"`Country.Name` string, `Country.Code` string, {years}", na="")
    return C.rename_columns(wide, V.RAW_PPP_NAMES)


@query("sink_csv", T.select(
    T.CLEAN, "country, date, food_name, import, unit_type, unit, price, unified_price, "
    "price_per_one_unit, ppp_factor * 10000000 AS large, ppp_factor / 10000000 AS small",
    "clean"))
def sink_csv(t: Inputs) -> DataFrame:
    """Missing values, and numbers that Spark alone would write with an exponent."""
    path = _folder(t)
    rows = t.clean().select(
        "country", "date", "food_name", "import", "unit_type", "unit", "price",
        "unified_price", "price_per_one_unit",
        (F.col("ppp_factor") * 10000000).alias("large"),
        (F.col("ppp_factor") / 10000000).alias("small"),
    )
    write_csv(rows, path)
    ddl = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return read_csv(t.spark, path, ddl)


@query("sink_tables", T.select(T.CLEAN, T.CLEAN_COLUMNS, "clean"))
def sink_tables(t: Inputs) -> DataFrame:
    root = _folder(t)
    save_tables({"food": t.clean().select(*V.CLEAN_FOOD)}, root)
    return load_tables(t.spark, root, ["food"])["food"].select(*V.CLEAN_FOOD)


# Projection and schema -------------------------------------------------------------


@query("drop_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
       "l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem")
def drop_columns(t: Inputs) -> DataFrame:
    dropped = C.drop_columns(
        t.table("lineitem"), "l_discount", "l_tax", "l_returnflag", "l_linestatus", "absent"
    )
    return dropped.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("drop_column_range", "SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, "
       "CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem")
def drop_column_range(t: Inputs) -> DataFrame:
    kept = C.drop_column_range(t.table("lineitem"), 3, 8)
    return kept.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("rename_columns", "SELECT p_partkey AS mkt_id, p_name AS food_name, p_brand, p_type, "
       "p_size, p_retailprice AS price FROM part")
def rename_columns(t: Inputs) -> DataFrame:
    names = {"p_partkey": "mkt_id", "p_name": "food_name", "p_retailprice": "price", "no": "x"}
    return C.rename_columns(t.table("part"), names)


@query("select_reorder", T.select(T.OBS, "price, country, food_name, unit, date", "obs"))
def select_reorder(t: Inputs) -> DataFrame:
    return C.select_reorder(t.obs(), ["price", "country", "food_name", "unit", "date"])


@query("add_constant", T.select(T.OBS, f"{T.ID}, 'Local' AS import", "obs"))
def add_constant(t: Inputs) -> DataFrame:
    return C.add_constant(t.obs().select(*ID), "import", "Local")


@query("unified_price", T.select(
    T.OBS + ", " + T.PPP,
    f"{T.ID}, o.country, price, ppp_factor, price / NULLIF(ppp_factor, 0) AS unified_price",
    "obs o LEFT JOIN ppp_long p ON o.country = p.country AND o.year = p.year"))
def unified_price(t: Inputs) -> DataFrame:
    priced = C.unified_price(joins.join_ppp(t.obs(), t.ppp(), t.nations))
    return priced.select(*ID, "country", "price", "ppp_factor", "unified_price")


@query("price_per_one_unit", T.select(
    T.CLEAN, f"{T.ID}, import, unified_price, unit, unit_type, price_per_one_unit", "clean"))
def price_per_one_unit(t: Inputs) -> DataFrame:
    return t.clean().select(
        *ID, "import", "unified_price", "unit", "unit_type", "price_per_one_unit"
    )


# Filters ---------------------------------------------------------------------------

OBS_ID = f"{T.ID}, country, food_name, price"


def _with_id(df: DataFrame) -> DataFrame:
    return df.select(*ID, "country", "food_name", "price")


@query("filter_exclude", "SELECT c_custkey AS NumericCode, "
       "CASE c_custkey % 11 WHEN 0 THEN 'XXX' WHEN 1 THEN 'XTS' WHEN 2 THEN 'BUK' WHEN 3 THEN '' "
       "ELSE concat('C', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) END AS AlphabeticCode "
       "FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 11 > 3")
def filter_exclude(t: Inputs) -> DataFrame:
    used = filters.filter_exclude(
        t.currency_codes(), "AlphabeticCode", V.EXCLUDED_CURRENCY_CODES
    )
    return used.select("NumericCode", "AlphabeticCode")


@query("filter_range", T.select(T.ROWS, OBS_ID + ", year", "obs_rows"))
def filter_range(t: Inputs) -> DataFrame:
    kept = filters.filter_range(t.obs(), "year", AFTER, BEFORE)
    return kept.select(*ID, "country", "food_name", "price", "year")


@query("filter_equals", T.select(
    T.OBS, OBS_ID, "obs", "WHERE seller_type = 'Retail' AND unit = 'KG'"))
def filter_equals(t: Inputs) -> DataFrame:
    return _with_id(filters.filter_equals(t.obs(), seller_type="Retail", unit="KG"))


@query("filter_label", T.select(T.OBS, OBS_ID, "obs", "WHERE market = 'National Average'"))
def filter_label(t: Inputs) -> DataFrame:
    return _with_id(filters.filter_label(t.obs(), "market", V.NATIONAL_AVERAGE))


@query("filter_label_drop", T.select(
    T.OBS, OBS_ID, "obs", "WHERE market <> 'National Average'"))
def filter_label_drop(t: Inputs) -> DataFrame:
    return _with_id(filters.filter_label(t.obs(), "market", V.NATIONAL_AVERAGE, keep=False))


@query("filter_contains", T.select(T.OBS, OBS_ID, "obs", "WHERE food_name LIKE '%local%'"))
def filter_contains(t: Inputs) -> DataFrame:
    return _with_id(filters.filter_contains(t.obs(), "food_name", "local"))


@query("filter_contains_drop", T.select(
    T.OBS, OBS_ID, "obs", "WHERE food_name NOT LIKE '%import%'"))
def filter_contains_drop(t: Inputs) -> DataFrame:
    return _with_id(filters.filter_contains(t.obs(), "food_name", "import", keep=False))


@query("complete_cases", T.select(
    f"{T.OBS}, {T.REGION}, {T.GROUPS}",
    f"{T.ID}, o.country, o.food_name, region, food_group",
    "obs o LEFT JOIN region_names r ON o.country = r.country "
    "LEFT JOIN food_groups g ON o.food_name = g.food_name",
    "WHERE region IS NOT NULL AND food_group IS NOT NULL"))
def complete_cases(t: Inputs) -> DataFrame:
    joined = joins.join_region(t.obs(), t.region_names(), t.nations)
    joined = joins.join_food_group(joined, t.food_groups(), t.names)
    whole = filters.complete_cases(joined)
    return whole.select(*ID, "country", "food_name", "region", "food_group")


@query("filter_both_null", T.select(
    T.CLEAN, f"{T.ID}, import, country", "clean",
    "WHERE ppp_factor IS NULL AND unit IS NULL"))
def filter_both_null(t: Inputs) -> DataFrame:
    kept = filters.filter_both_null(t.clean(), "ppp_factor", "unit")
    return kept.select(*ID, "import", "country")


@query("filter_nonzero", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax "
       "FROM lineitem WHERE l_tax <> 0")
def filter_nonzero(t: Inputs) -> DataFrame:
    kept = filters.filter_nonzero(t.table("lineitem"), "l_tax")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax")


@query("drop_outlier_rows", T.select(
    T.OBS, OBS_ID,
    f"(SELECT *, row_number() OVER (PARTITION BY country ORDER BY price DESC, {T.ID}) AS place "
    "FROM obs)", "WHERE place > 1"))
def drop_outlier_rows(t: Inputs) -> DataFrame:
    """The key list is each country's dearest row."""
    obs = t.obs().withColumn("cheapness", -F.col("price"))
    dearest = statistics.first_row_carry(obs, ["country"], ID, ["cheapness", *ID])
    return _with_id(filters.drop_outlier_rows(obs, dearest, ID, t.nations))


@query("drop_outlier_ordinals", T.select(
    T.OBS, OBS_ID, f"(SELECT *, row_number() OVER (ORDER BY {T.ID}) AS place FROM obs)",
    "WHERE place NOT IN (1, 2, 100, 20716, 89587)"))
def drop_outlier_ordinals(t: Inputs) -> DataFrame:
    """The rows to drop are named by their place in the table."""
    path = _folder(t)
    save_in_order(_with_id(t.obs()), path, ID)
    numbered = load_with_ordinals(t.spark, path)
    return _with_id(filters.drop_ordinals(numbered, (1, 2, 100, 20716, 89587)))


@query("drop_outliers_by_spread", T.select(
    T.OBS, OBS_ID,
    "obs JOIN (SELECT country AS c, avg(price) AS mean, stddev_samp(price) AS spread "
    "FROM obs GROUP BY country) ON country = c", "WHERE abs(price - mean) <= 1.5 * spread"))
def drop_outliers_by_spread(t: Inputs) -> DataFrame:
    return _with_id(
        filters.drop_outliers_by_spread(t.obs(), "price", ["country"], 1.5, t.nations)
    )


# Joins -----------------------------------------------------------------------------


@query("join_region", T.select(
    f"{T.OBS}, {T.REGION}",
    f"{T.ID}, o.country, country_code, country_income_group, region",
    "obs o LEFT JOIN region_names r ON o.country = r.country"))
def join_region(t: Inputs) -> DataFrame:
    joined = joins.join_region(t.obs(), t.region_names(), t.nations)
    return joined.select(*ID, "country", "country_code", "country_income_group", "region")


@query("join_food_group", T.select(
    f"{T.OBS}, {T.GROUPS}", f"{T.ID}, o.food_name, food_group",
    "obs o LEFT JOIN food_groups g ON o.food_name = g.food_name"))
def join_food_group(t: Inputs) -> DataFrame:
    joined = joins.join_food_group(t.obs(), t.food_groups(), t.names)
    return joined.select(*ID, "food_name", "food_group")


@query("join_ppp", T.select(
    f"{T.OBS}, {T.PPP}", f"{T.ID}, o.country, o.year, ppp_factor",
    "obs o LEFT JOIN ppp_long p ON o.country = p.country AND o.year = p.year"))
def join_ppp(t: Inputs) -> DataFrame:
    joined = joins.join_ppp(t.obs(), t.ppp(), t.nations)
    return joined.select(*ID, "country", "year", "ppp_factor")


@query("join_ppp_by_code", T.select(
    f"{T.OBS}, {T.REGION}, {T.PPP}", f"{T.ID}, r.country_code, o.year, ppp_factor",
    "obs o LEFT JOIN region_names r ON o.country = r.country "
    "LEFT JOIN ppp_long p ON r.country_code = p.country_code AND o.year = p.year"))
def join_ppp_by_code(t: Inputs) -> DataFrame:
    food = joins.join_region(t.obs(), t.region_names(), t.nations)
    joined = joins.join_ppp(food, t.ppp(), t.nations, on="country_code")
    return joined.select(*ID, "country_code", "year", "ppp_factor")


@query("unpivot_years", T.select(T.PPP, "country, country_code, year, ppp_factor", "ppp_long"))
def unpivot_years(t: Inputs) -> DataFrame:
    return joins.unpivot_years(t.ppp(), ["country", "country_code"])


# Row counts of the clean table hold no row of nation 3.
FREQUENCY = (
    f"{T.CLEAN}, frequency AS (SELECT country AS Var1, count(*) AS Freq FROM clean "
    "GROUP BY country), domain AS (SELECT n_name AS Var1 FROM nation)"
)


def _frequency(t: Inputs) -> tuple[DataFrame, DataFrame]:
    domain = t.table("nation").select(F.col("n_name").alias("Var1"))
    return statistics.frequency(t.clean()), domain


@query("join_full_frequency", T.select(
    FREQUENCY, "Var1, Freq", "domain FULL OUTER JOIN frequency USING (Var1)"))
def join_full_frequency(t: Inputs) -> DataFrame:
    return joins.join_full_frequency(*_frequency(t))


@query("join_full_frequency_as_written", T.select(
    FREQUENCY, "Var1, Freq",
    "frequency UNION ALL SELECT Var1, CAST(NULL AS BIGINT) FROM domain"))
def join_full_frequency_as_written(t: Inputs) -> DataFrame:
    return joins.join_full_frequency(*_frequency(t), as_written=True)


@query("map_frequency", T.select(
    FREQUENCY, "Var1, Freq", "domain FULL OUTER JOIN frequency USING (Var1)"))
def map_frequency(t: Inputs) -> DataFrame:
    return joins.join_full_frequency(*_frequency(t))


@query("join_grid", T.select(
    T.ROWS, "c.country, y.year, v.price",
    f"(SELECT DISTINCT country FROM obs) c CROSS JOIN (SELECT DISTINCT year FROM obs_rows) y "
    f"LEFT JOIN (SELECT country, year, {T.mean('price')} AS price FROM obs "
    "GROUP BY country, year) v ON c.country = v.country AND y.year = v.year"))
def join_grid(t: Inputs) -> DataFrame:
    rows = t.obs()
    means = statistics.strict_mean_by(rows, ["country", "year"], "price", decimals=2)
    return joins.join_grid(rows, means, "country", YEARS)


# Set operations --------------------------------------------------------------------


@query("union_all", T.select(
    T.OBS, OBS_ID, "obs", "WHERE seller_type = 'Retail' UNION ALL "
    f"SELECT {OBS_ID} FROM obs WHERE seller_type = 'Wholesale' UNION ALL "
    f"SELECT {OBS_ID} FROM obs WHERE market = 'National Average'"))
def union_all(t: Inputs) -> DataFrame:
    obs = t.obs()
    return _with_id(unions.union_all(
        filters.filter_equals(obs, seller_type="Retail"),
        filters.filter_equals(obs, seller_type="Wholesale"),
        filters.filter_label(obs, "market", V.NATIONAL_AVERAGE),
    ))


@query("import_label_union", T.select(
    T.OBS, f"{OBS_ID}, 'Import' AS import", "obs",
    f"WHERE food_name LIKE '%import%' UNION ALL SELECT {OBS_ID}, 'Not Import' FROM obs "
    f"WHERE food_name NOT LIKE '%import%' UNION ALL SELECT {OBS_ID}, 'Local' FROM obs "
    "WHERE food_name LIKE '%local%'"))
def import_label_union(t: Inputs) -> DataFrame:
    labelled = unions.import_label_union(t.obs())
    return labelled.select(*ID, "country", "food_name", "price", "import")


@query("neither_union", T.select(
    T.OBS, OBS_ID, "obs",
    "WHERE food_name NOT LIKE '%local%' AND food_name NOT LIKE '%import%'"))
def neither_union(t: Inputs) -> DataFrame:
    return _with_id(unions.neither_union(t.obs()))


@query("neither_union_as_written", T.select(
    T.OBS, OBS_ID, "obs",
    f"WHERE food_name NOT LIKE '%local%' UNION ALL SELECT {OBS_ID} FROM obs "
    "WHERE food_name NOT LIKE '%import%'"))
def neither_union_as_written(t: Inputs) -> DataFrame:
    return _with_id(unions.neither_union(t.obs(), as_written=True))


@query("top_foods_union", T.select(
    T.CLEAN, f"{T.ID}, import, food_group, food_name", "clean",
    "WHERE food_group IN ('Rice', 'Maize', 'Sorghum', 'Beans', 'Millet', 'Oil')"))
def top_foods_union(t: Inputs) -> DataFrame:
    return unions.top_foods_union(t.clean()).select(*ID, "import", "food_group", "food_name")


# Scalars ---------------------------------------------------------------------------


@query("pad_month", T.select(
    T.OBS, f"{T.ID}, lpad(CAST(month AS VARCHAR), 2, '0') AS month", "obs"))
def pad_month(t: Inputs) -> DataFrame:
    return C.pad_month(t.obs()).select(*ID, "month")


@query("month_date", T.select(T.OBS, f"{T.ID}, make_date(year, month, 1) AS date", "obs"))
def month_date(t: Inputs) -> DataFrame:
    return C.month_date(t.obs().drop("date")).select(*ID, "date")


@query("recode_currency", T.select(
    T.OBS, f"{T.ID}, CASE currency WHEN 'Somaliland Shilling' THEN 'SOS' ELSE currency END "
    "AS currency", "obs"))
def recode_currency(t: Inputs) -> DataFrame:
    return C.recode_currency(t.obs()).select(*ID, "currency")


@query("normalize_unit", T.select(
    T.OBS, f"{T.ID}, {T.UNIT.format('unit')} AS unit", "obs"))
def normalize_unit(t: Inputs) -> DataFrame:
    return C.normalize_unit(t.obs()).select(*ID, "unit")


@query("split_unit", T.select(
    T.OBS, f"{T.ID}, split_part(unit, ' ', 1) AS unit, "
    "NULLIF(split_part(unit, ' ', 2), '') AS unit_type", "obs"))
def split_unit(t: Inputs) -> DataFrame:
    return C.split_unit(t.obs()).select(*ID, "unit", "unit_type")


@query("to_number", T.select(
    T.OBS, f"{T.ID}, TRY_CAST(split_part(unit, ' ', 1) AS DOUBLE) AS unit", "obs"))
def to_number(t: Inputs) -> DataFrame:
    return C.to_number(C.split_unit(t.obs()), "unit").select(*ID, "unit")


@query("unify_food_group", T.select(
    T.OBS, f"{T.ID}, food_name, {T.GROUP_NAME} AS food_group", "obs"))
def unify_food_group(t: Inputs) -> DataFrame:
    return C.unify_food_group(t.obs(), GROUPS).select(*ID, "food_name", "food_group")


@query("contains_label", T.select(
    T.OBS, f"{T.ID}, food_name, CASE WHEN contains(food_name, 'import') THEN 'Import' "
    "WHEN contains(food_name, 'local') THEN 'Local' ELSE 'Not Listed' END AS import", "obs"))
def contains_label(t: Inputs) -> DataFrame:
    return C.contains_label(t.obs()).select(*ID, "food_name", "import")


# Pipelines -------------------------------------------------------------------------

CODES = """codes AS (
SELECT concat('Currency of ', n_name) AS Currency,
       CASE c_custkey % 11 WHEN 0 THEN 'XXX' WHEN 1 THEN 'XTS' WHEN 2 THEN 'BUK' WHEN 3 THEN ''
       ELSE concat('C', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) END AS AlphabeticCode
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("distinct_pairs", T.select(CODES, "DISTINCT Currency, AlphabeticCode", "codes"))
def distinct_pairs(t: Inputs) -> DataFrame:
    return statistics.distinct_pairs(t.currency_codes(), "Currency", "AlphabeticCode")


@query("clean_currency", T.select(
    CODES, "Currency, AlphabeticCode", "codes",
    "WHERE AlphabeticCode NOT IN ('XXX', 'XTS', 'BUK', '') GROUP BY ALL"))
def clean_currency(t: Inputs) -> DataFrame:
    return cleaning.clean_currency(t.currency_codes())


@query("clean_ppp", T.select(T.PPP, "*", "ppp"))
def clean_ppp(t: Inputs) -> DataFrame:
    return t.ppp()


@query("clean_food", T.select(T.CLEAN, T.CLEAN_COLUMNS, "clean"))
def clean_food(t: Inputs) -> DataFrame:
    return t.clean().select(*V.CLEAN_FOOD)


@query("observations", T.select(
    T.ROWS, f"{T.ID}, country, lpad(CAST(month AS VARCHAR), 2, '0') AS month, "
    "make_date(year, month, 1) AS date, price", "obs_rows"))
def observations(t: Inputs) -> DataFrame:
    rows = cleaning.observations(t.obs(), AFTER, BEFORE)
    return rows.select(*ID, "country", "month", "date", "price")


@query("divide_by_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       "l_extendedprice / NULLIF(l_tax, 0) AS ratio FROM lineitem")
def divide_by_zero(t: Inputs) -> DataFrame:
    ratio = S.divide(F.col("l_extendedprice"), F.col("l_tax"))
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ratio.alias("ratio")
    )
