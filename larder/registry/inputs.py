"""Price observations and dimensions, derived from the test tables.

No test table holds food prices, so order lines stand in for price observations: a
line's customer nation is the country, its part the food, its supplier the market. The
SQL twins of these views are in ``twins.py``.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.fixed_values import NATIONAL_AVERAGE, RAW_REGION_NAMES
from larder.operators.columns import drop_columns, rename_columns
from larder.operators.windows import food_group_by, monthly_inflation
from larder.operators.unions import import_block
from larder.plans import cleaning
from larder.session import shared_folder
from larder.sources.tables import write_table

# Tells all rows apart, and starts with the day of the observation.
ROW_ID = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
ORDER = ROW_ID
# The clean table stacks a block per import label: a row's copy is in another block.
CLEAN_ORDER = ("import_block", *ORDER)
AFTER, BEFORE = 1995, 2001
YEARS = range(1996, 2001)
DAYS = ("1996-01-01", "2001-01-01")
SUFFIXES = ("", " (imported)", " (local)", " (importedlocal)")
ADJECTIVES = ("small", "large", "red", "blue", "hot", "cold", "old", "new")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def names_of(noun: str) -> tuple[str, ...]:
    return tuple(f"{a} {noun}{s}" for a in ADJECTIVES for s in SUFFIXES)


# The parts that play the food groups; Millet and Oil are single exact names.
GROUPS = {
    "Rice": names_of("rod"),
    "Beans": names_of("gear"),
    "Sorghum": names_of("bolt"),
    "Maize": names_of("plate"),
    "Millet": ("new anvil",),
    "Oil": ("old anvil",),
}


def chosen(number: Column, values: dict[int, str], default: Column) -> Column:
    cases = [F.when(number == key, F.lit(value)) for key, value in values.items()]
    return F.coalesce(*cases, default)


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


class Inputs:
    """The derived tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A test table; the declared schema saves the job that would infer it."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def picked(self, name: str, *columns: str) -> DataFrame:
        return self.table(name).select(*columns)

    @cached_property
    def nations(self) -> int:
        """Rows of the nation table: the bound of every table with a row per country."""
        return self.table("nation").count()

    @cached_property
    def names(self) -> int:
        """Number of food names: the bound of every table with a row per food."""
        return self.table("part").select("p_name").distinct().count() * len(SUFFIXES)

    def obs(self, days: tuple[str, str] | None = None) -> DataFrame:
        """Raw price observations; ``days`` (from, before) reaches the scan."""
        # The order side is joined first, so the lines move once for it.
        buyers = (
            self.picked("orders", "o_orderkey", "o_custkey")
            .join(self.picked("customer", "c_custkey", "c_nationkey", "c_mktsegment"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .join(self.picked("nation", "n_nationkey", "n_name"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
        )
        sold = self.picked(
            "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
        )
        if days is not None:
            day = F.col("l_shipdate")
            first, end = (F.lit(d).cast("timestamp_ntz") for d in days)
            sold = sold.filter((day >= first) & (day < end))
        # Both sides grow with the data, whatever their estimate: a merge join.
        lines = (
            sold
            .join(buyers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.picked("part", "p_partkey", "p_name"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .join(self.picked("supplier", "s_suppkey", "s_name"),
                  F.col("l_suppkey") == F.col("s_suppkey"))
        )
        nation, day = F.col("n_nationkey"), F.col("l_shipdate")
        national = (F.col("l_suppkey") % 10 == 0) & (nation % 2 == 0)
        seller = (
            F.when(F.col("l_returnflag") == "A", "Retail")
            .when(F.col("l_returnflag") == "R", "Wholesale")
            .when(F.col("l_linestatus") == "O", "Producer")
            .otherwise("Farm Gate")
        )
        suffix = chosen(
            F.col("l_linenumber") % 5,
            {1: SUFFIXES[1], 2: SUFFIXES[2], 3: SUFFIXES[3]}, F.lit(SUFFIXES[0]),
        )
        unit = chosen(
            F.col("l_quantity").cast("int") % 8,
            {0: "KG", 1: "500 ML", 2: "Dozen", 3: "Marmite", 4: "400 G", 5: "Bunch",
             6: "a b c"},
            F.lit("11.5 KG"),
        )
        currency = F.when(nation % 6 == 0, "Somaliland Shilling").otherwise(code(nation))
        return lines.select(
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("city"),
            F.when(national, NATIONAL_AVERAGE).otherwise(F.col("s_name")).alias("market"),
            F.trunc(day.cast("date"), "month").alias("date"),
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            seller.alias("seller_type"),
            F.concat("p_name", suffix).alias("food_name"),
            unit.alias("unit"),
            currency.alias("currency"),
            F.col("l_extendedprice").alias("price"),
            day.cast("date").alias("l_shipdate"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )

    def obs_rows(self) -> DataFrame:
        """Observations of the years used, without the raw file's leftovers."""
        return self.obs(DAYS)

    def country_region(self) -> DataFrame:
        """Country dimension; nation 3 is missing so that the left join has a gap."""
        nation = F.col("n_nationkey")
        income = chosen(
            nation % 3, {0: "Low income", 1: "Lower middle income"},
            F.lit("Upper middle income"),
        )
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .filter(nation != 3)
            .select(
                F.col("n_name").alias("food_country_name"), code(nation).alias("code"),
                income.alias("incomegroup"), F.col("r_name").alias("region"),
                F.col("n_name").alias("ppp_country_name"),
            )
        )

    def food_groups(self) -> DataFrame:
        """Food dimension; rings have no group, gizmos and widgets are no food."""
        name = F.col("p_name")
        group = (
            F.when(name.endswith(" gizmo"), "Not Food")
            .when(name.endswith(" widget"), "Loaf")
            .otherwise(name)
        )
        suffixes = F.explode(F.array(*(F.lit(s) for s in SUFFIXES)))
        names = self.table("part").select("p_name").distinct()
        return (
            names.filter(~name.endswith(" ring"))
            .select("p_name", suffixes.alias("suffix"))
            .select(F.concat("p_name", "suffix").alias("food_name"), group.alias("food_group"))
        )

    def ppp_raw(self) -> DataFrame:
        """Conversion factors as published: two indicator columns, a column per year.

        Nation 7 has none.
        """
        nation = F.col("n_nationkey")
        priced = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == nation)
            .filter(nation != 7)
        )
        year = F.year("o_orderdate")
        factors = [
            F.round(F.avg(F.when(year == y, F.col("o_totalprice"))) / 100000, 4).alias(f"X{y}")
            for y in range(1995, 2002)
        ]
        averaged = priced.groupBy("n_name", "n_nationkey").agg(*factors)
        return averaged.select(
            F.col("n_name").alias("Country.Name"), code(nation).alias("Country.Code"),
            F.lit("PPP conversion factor").alias("Indicator.Name"),
            F.lit("PA.NUS.PPP").alias("Indicator.Code"),
            *[f"X{y}" for y in range(1995, 2002)],
        )

    def ppp(self) -> DataFrame:
        return cleaning.clean_ppp(self.ppp_raw(), 3, 5, ["X2001"])

    def region_names(self) -> DataFrame:
        """The country dimension under its clean names."""
        dropped = drop_columns(self.country_region(), "ppp_country_name")
        return rename_columns(dropped, RAW_REGION_NAMES)

    def clean(self) -> DataFrame:
        """The clean price table, with the row identity and the label's block."""
        rows = cleaning.observations(self.obs(DAYS), AFTER, BEFORE)
        return cleaning.clean_food(
            rows, self.country_region(), self.food_groups(), self.ppp(),
            keep=ORDER, food_groups=GROUPS, region_rows=self.nations,
            group_rows=self.names, ppp_rows=self.nations,
        ).withColumn("import_block", import_block())

    def stored(self, name: str, df: DataFrame) -> DataFrame:
        """The table written to the shared folder and read back, with its columns pruned.

        For what a query reads several times; the folder belongs to whoever names it.
        """
        path = f"{shared_folder(self.spark)}/larder-{uuid.uuid4().hex}/{name}"
        write_table(df, path)
        return self.spark.read.parquet(path)

    def stored_clean(self) -> DataFrame:
        return self.stored("food", self.clean())

    @property
    def group_rows(self) -> int:
        """Bound of every table with a row per country and food group."""
        return self.nations * self.names

    def with_inflation(self) -> DataFrame:
        """Clean rows with the change against the country's previous row."""
        return monthly_inflation(self.stored_clean(), CLEAN_ORDER)

    def series(self) -> DataFrame:
        """Clean rows of every food group and country with ten rows, with inflation."""
        return food_group_by(
            self.stored_clean(), CLEAN_ORDER, key_rows=self.group_rows
        )

    def currency_codes(self) -> DataFrame:
        """Currency codes per customer, with unused and empty ones."""
        nation, key = F.col("n_nationkey"), F.col("c_custkey")
        alphabetic = chosen(
            key % 11, {0: "XXX", 1: "XTS", 2: "BUK", 3: ""}, code(nation)
        )
        joined = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == nation
        )
        return joined.select(
            F.col("c_name").alias("Entity"),
            F.concat(F.lit("Currency of "), "n_name").alias("Currency"),
            alphabetic.alias("AlphabeticCode"),
            key.alias("NumericCode"),
            F.lit("2").alias("MinorUnit"),
            F.lit(None).cast("string").alias("WithdrawalDate"),
        )


def code(nation: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(nation.cast("string"), 2, "0"))
