import datetime as dt
import math
import statistics as st

import pytest
from pyspark.sql import functions as F

from larder.functions.aggregates import mean, strict_mean
from larder.operators import averages, statistics
from larder.plans import analysis
from larder.registry.analysis import countries_without_stdev

D1, D2 = dt.date(2001, 1, 1), dt.date(2001, 2, 1)
SCHEMA = (
    "i int, country string, region string, city string, market string, seller_type string, "
    "import string, food_name string, date date, year int, price double, ppp_factor double, "
    "unified_price double, price_per_one_unit double, monthly_inflation double"
)


def table(spark, rows):
    """Rows of (country, market, date, price, inflation) as a clean-like table."""
    data = [
        (i, c, "South Asia" if c < "C" else "Elsewhere", "city", m, "Retail", "Import",
         f"food {i}", d, d.year, p, 2.0, None if p is None else p / 2,
         None if p is None else p / 4, f)
        for i, (c, m, d, p, f) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_strict_mean_and_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    v = F.col("v")
    row = df.agg(mean(v), strict_mean(v), mean(v, 2), strict_mean(v, 2)).first()
    assert tuple(row) == (2.0, None, 2.0, None)
    assert df.filter("v = 1").agg(strict_mean(v, 2)).first()[0] == 1.0
    assert df.filter("v > 9").agg(mean(v, 2)).first()[0] is None


def test_world_average(spark):
    df = table(spark, [
        ("B", "m1", D1, 3.0, None), ("A", "m2", D1, 1.0, None), ("A", "m2", D2, None, 5.0),
    ])
    out = {r["date"]: r for r in averages.world_average(df, ["i"]).collect()}
    assert set(out[D1].asDict()) == {
        "i", "country", "import", "food_name", "date", "year", "price", "ppp_factor",
        "unified_price", "price_per_one_unit", "monthly_inflation",
    }
    assert (out[D1]["country"], out[D1]["price"], out[D1]["food_name"]) == ("World", 2.0, "food 0")
    assert out[D2]["price"] is None and out[D2]["ppp_factor"] == 2.0


def test_region_average_leaves_other_regions_out(spark, rows):
    df = table(spark, [("A", "m", D1, 2.0, None), ("B", "m", D1, 4.0, None),
                       ("C", "m", D1, 9.0, None)])
    out = averages.region_average_all(df, ["i"])
    assert rows(out, "region", "date", "price") == [("South Asia", D1, 3.0)]
    assert "country" not in out.columns
    assert averages.region_average(df, ["i"], "Elsewhere").first()["price"] == 9.0


def test_seller_and_import_averages(spark, rows):
    df = table(spark, [("A", "m", D1, 2.0, None), ("B", "m", D1, 4.0, None)])
    assert rows(averages.seller_type_average(df, ["i"]), "seller_type", "price") == [
        ("Retail", 3.0)]
    assert rows(averages.import_type_grouping(df, ["i"]), "import", "country", "price") == [
        ("Import", "A", 3.0)]
    assert averages.import_type_average(df, ["i"], "Local").count() == 0


def test_national_average_spread_is_over_all_dates(spark):
    changes = [None, 4.0, -2.0, 7.5, 1.25]
    df = table(spark, [("A", "m", d, 1.0, f) for d, f in zip([D1, D1, D1, D2, D2], changes)]
               + [("B", "m", D1, 1.0, 3.0)])
    out = {(r["country"], r["date"]): r for r in averages.national_average(df, ["i"]).collect()}
    expected = st.stdev(changes[1:])
    assert out["A", D1]["stdv"] == pytest.approx(expected)
    assert out["A", D2]["stdv"] == pytest.approx(expected)
    assert out["B", D1]["stdv"] is None
    assert (out["A", D1]["city"], out["A", D1]["market"]) == ("", "National Average")


def test_published_rows_win_over_computed(spark, rows):
    df = table(spark, [
        ("A", "National Average", D1, 2.0, None), ("A", "m", D2, 8.0, 1.0),
        ("B", "m", D1, 4.0, None), ("B", "n", D1, 6.0, 2.0), ("C", "m", D1, 1.0, None),
    ])
    out = averages.join_published_else_computed(df, ["i"], without=["C"])
    assert rows(out, "country", "date", "price") == [("A", D1, 2.0), ("B", D1, 5.0)]
    assert rows(statistics.countries_without_national(df)) == [("B",), ("C",)]
    assert rows(statistics.countries_not_national(df)) == [("A", 1), ("B", 2), ("C", 1)]


def test_inflation_stats_skip_missing(spark):
    df = spark.createDataFrame(
        [("A", 1.0), ("A", None), ("A", 3.0), ("B", 5.0), ("C", None), ("D", math.nan)],
        "country string, monthly_inflation double",
    )
    stats = statistics.inflation_stats(df)
    out = {r["country"]: (r["avg_infla"], r["stdev"]) for r in stats.collect()}
    assert out["A"] == (2.0, pytest.approx(1.4142135623730951))
    assert out["B"] == (5.0, None)
    assert out["C"] == out["D"] == (None, None)
    order = [r["country"] for r in statistics.report_order(stats).collect()]
    assert order == ["B", "A", "C", "D"]


def test_cost_to_survive(spark, rows):
    df = spark.createDataFrame(
        [("A", 2001, 1.0), ("A", 2001, 3.0), ("B", 2001, None), ("B", 2002, 0.0)],
        "country string, year int, price_per_one_unit double",
    )
    out = statistics.cost_to_survive(df).collect()
    assert len(out) == 1
    assert out[0]["price_to_survive"] == pytest.approx(2.0 * 769.23076923 * 365)


def test_countries_without_stdev_carry_no_text_columns(spark, rows):
    class Series:
        def series(self):
            return spark.sql("""SELECT 1 import_block, DATE '2000-01-01' l_shipdate, id l_orderkey,
                1 l_linenumber, 1L l_partkey, 1L l_suppkey, 'Rice' food_group, 'A' country,
                DATE '2000-01-01' date, 'M' market, CAST(NULL AS DOUBLE) monthly_inflation,
                'B' city, 'unseen' seller_type, 2.0D price FROM range(3)""")

    found = countries_without_stdev(Series())
    assert rows(found) == [("A", 1)]
    assert "unseen" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_countries_without_stdev(spark, rows):
    df = spark.createDataFrame(
        [("A", None, None), ("A", None, 1.0), ("B", 2.0, None)],
        "country string, stdv double, monthly_inflation double",
    )
    assert rows(statistics.countries_without_stdev(df)) == [("A", 1)]


def test_import_comparison_counts(spark, rows):
    names = ["x local", "x imported", "x importedlocal", "x"]
    data = table(spark, [("Mali", "m", D1, float(2 ** i), None) for i in range(4)])
    data = data.withColumn("food_name", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1))
    out = analysis.import_comparison(data, ["i"])
    assert rows(out, "import", "price") == [
        ("Import", 3.0), ("Local", 2.5), ("Not Listed", 8.0)]
    written = analysis.import_comparison(data, ["i"], as_written=True)
    # 1 and 2 once, 8 twice.
    assert rows(written, "import", "price")[-1] == ("Not Listed", (1 + 2 + 8 + 8) / 4)
    assert analysis.import_comparison(data.withColumn("country", F.lit("Peru")), ["i"]).count() == 0
