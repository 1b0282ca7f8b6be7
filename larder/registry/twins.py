"""SQL for DuckDB: the derived tables, and pieces that several queries share."""

from __future__ import annotations

from collections.abc import Sequence

ID = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

OBS = """obs AS (
SELECT n_name AS country, c_mktsegment AS city,
       CASE WHEN l_suppkey % 10 = 0 AND n_nationkey % 2 = 0 THEN 'National Average'
            ELSE s_name END AS market,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
       CASE WHEN l_returnflag = 'A' THEN 'Retail' WHEN l_returnflag = 'R' THEN 'Wholesale'
            WHEN l_linestatus = 'O' THEN 'Producer' ELSE 'Farm Gate' END AS seller_type,
       concat(p_name, CASE l_linenumber % 5 WHEN 1 THEN ' (imported)' WHEN 2 THEN ' (local)'
              WHEN 3 THEN ' (importedlocal)' ELSE '' END) AS food_name,
       CASE CAST(l_quantity AS INT) % 8 WHEN 0 THEN 'KG' WHEN 1 THEN '500 ML'
            WHEN 2 THEN 'Dozen' WHEN 3 THEN 'Marmite' WHEN 4 THEN '400 G'
            WHEN 5 THEN 'Bunch' WHEN 6 THEN 'a b c' ELSE '11.5 KG' END AS unit,
       CASE WHEN n_nationkey % 6 = 0 THEN 'Somaliland Shilling'
            ELSE concat('C', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) END AS currency,
       l_extendedprice AS price, CAST(l_shipdate AS DATE) AS l_shipdate,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

ROWS = OBS + """, obs_rows AS (
SELECT * FROM obs WHERE year BETWEEN 1996 AND 2000)"""

REGION = """region_names AS (
SELECT n_name AS country, concat('C', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS country_code,
       CASE n_nationkey % 3 WHEN 0 THEN 'Low income' WHEN 1 THEN 'Lower middle income'
            ELSE 'Upper middle income' END AS country_income_group,
       r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3)"""

GROUPS = """food_groups AS (
SELECT DISTINCT concat(p_name, sfx) AS food_name,
       CASE WHEN p_name LIKE '% gizmo' THEN 'Not Food' WHEN p_name LIKE '% widget' THEN 'Loaf'
            ELSE p_name END AS food_group
FROM part CROSS JOIN (VALUES (''), (' (imported)'), (' (local)'), (' (importedlocal)')) AS v(sfx)
WHERE p_name NOT LIKE '% ring')"""


def _factor(year: int) -> str:
    return (f"round(avg(CASE WHEN year(o_orderdate) = {year} THEN o_totalprice END) "
            f"/ 100000, 4) AS X{year}")


PPP = f"""ppp AS (
SELECT n_name AS country, concat('C', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS country_code,
       {", ".join(_factor(y) for y in range(1996, 2001))}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey <> 7 GROUP BY n_name, n_nationkey),
ppp_long AS (
{" UNION ALL ".join(
    f"SELECT country, country_code, {y} AS year, X{y} AS ppp_factor FROM ppp"
    for y in range(1996, 2001))})"""

UNIT = """CASE {0} WHEN 'KG' THEN '1000 G' WHEN '500 ML' THEN '0.5 L'
 WHEN 'Dozen' THEN '12 Unit' WHEN 'Marmite' THEN '2500 G' WHEN '11.5 KG' THEN '11500 G'
 ELSE {0} END"""

GROUP_NAME = """CASE WHEN split_part(food_name, ' ', 2) = 'rod' THEN 'Rice'
 WHEN split_part(food_name, ' ', 2) = 'gear' THEN 'Beans'
 WHEN split_part(food_name, ' ', 2) = 'bolt' THEN 'Sorghum'
 WHEN split_part(food_name, ' ', 2) = 'plate' THEN 'Maize'
 WHEN food_name = 'new anvil' THEN 'Millet' WHEN food_name = 'old anvil' THEN 'Oil'
 ELSE food_name END"""

CLEAN = f"""{ROWS}, {REGION}, {GROUPS}, {PPP}, priced AS (
SELECT o.country, r.country_code, r.country_income_group, r.region, o.city, o.market,
       o.date, o.year, lpad(CAST(o.month AS VARCHAR), 2, '0') AS month, o.seller_type,
       o.food_name, o.price, {UNIT.format("o.unit")} AS measure,
       CASE o.currency WHEN 'Somaliland Shilling' THEN 'SOS' ELSE o.currency END AS currency,
       p.ppp_factor, o.price / NULLIF(p.ppp_factor, 0) AS unified_price, {ID}
FROM obs_rows o JOIN region_names r ON o.country = r.country
JOIN food_groups g ON o.food_name = g.food_name
LEFT JOIN ppp_long p ON o.country = p.country AND o.year = p.year
WHERE g.food_group NOT IN ('Not Food', 'Loaf', 'Sack', 'Bunch')
AND o.city IS NOT NULL AND o.market IS NOT NULL AND o.date IS NOT NULL
AND o.seller_type IS NOT NULL AND o.unit IS NOT NULL AND o.currency IS NOT NULL
AND o.price IS NOT NULL AND r.region IS NOT NULL),
measured AS (
SELECT * EXCLUDE (measure), TRY_CAST(split_part(measure, ' ', 1) AS DOUBLE) AS unit,
       NULLIF(split_part(measure, ' ', 2), '') AS unit_type, {GROUP_NAME} AS food_group
FROM priced),
labelled AS (
SELECT *, 'Import' AS import, 1 AS import_block FROM measured WHERE food_name LIKE '%import%'
UNION ALL SELECT *, 'Not Import', 2 FROM measured WHERE food_name NOT LIKE '%import%'
UNION ALL SELECT *, 'Local', 3 FROM measured WHERE food_name LIKE '%local%'),
clean AS (
SELECT *, unified_price / NULLIF(unit, 0) AS price_per_one_unit FROM labelled)"""

CLEAN_COLUMNS = (
    "country, country_code, country_income_group, region, city, market, date, year, month, "
    "seller_type, import, food_group, food_name, price_per_one_unit, unit_type, price, unit, "
    "currency, unified_price, ppp_factor"
)

# Clean rows with the change against the previous row of the country.
INFLATION = f"""{CLEAN}, inflation AS (
SELECT *, 100 * (price / NULLIF(lag(price) OVER (
    PARTITION BY country ORDER BY import_block, {ID}), 0) - 1) AS monthly_inflation
FROM clean)"""

# The same within food group and country, groups of ten rows or more.
SERIES = f"""{CLEAN}, series AS (
SELECT *, 100 * (price / NULLIF(lag(price) OVER (
    PARTITION BY food_group, country ORDER BY import_block, {ID}), 0) - 1) AS monthly_inflation
FROM (SELECT *, count(*) OVER (PARTITION BY food_group, country) AS size FROM clean)
WHERE size >= 10)"""


def mean(name: str, strict: bool = True) -> str:
    """A mean as the registered queries return it: exact for prices and factors."""
    places = {"price": 2, "ppp_factor": 4}.get(name)
    if places:
        total = f"CAST(sum(CAST({name} AS DECIMAL(18, {places}))) AS DOUBLE)"
        value = f"{total} / NULLIF(count({name}), 0)"
    else:
        value = f"round(avg({name}), 4)"
    return f"CASE WHEN count({name}) = count(*) THEN {value} END" if strict else value


MEANS = ("price_per_one_unit", "unified_price", "ppp_factor", "price")


def average(
    source: str, table: str, keys: str, carried: str, strict: bool = True,
    where: str = "true", constants: str = "",
) -> str:
    """Means per group next to the carried columns of the group's first row."""
    means = ", ".join(f"{mean(m, strict)} AS {m}" for m in MEANS)
    first = ", ".join(f"f.{c.strip()}" for c in carried.split(",")) if carried else ""
    on = " AND ".join(f"f.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    parts = [p for p in ("m.*", first, constants) if p]
    return f"""WITH {source}, chosen AS (SELECT * FROM {table} WHERE {where}),
means AS (SELECT {keys}, {means} FROM chosen GROUP BY {keys}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY import_block, {ID}) AS place
FROM chosen)
SELECT {", ".join(parts)} FROM means m JOIN firsts f ON {on} WHERE f.place = 1"""


def select(source: str, columns: str | Sequence[str], table: str, rest: str = "") -> str:
    text = columns if isinstance(columns, str) else ", ".join(columns)
    return f"WITH {source} SELECT {text} FROM {table} {rest}"
