from larder.sources.tables import load_with_ordinals, save_in_order
import math

from pyspark.sql import functions as F

from larder.operators import filters, joins, statistics, unions


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "food_name string")


def test_filter_exclude_drops_listed_and_missing(spark, rows):
    df = spark.createDataFrame([("XXX",), ("",), ("USD",), (None,)], "code string")
    assert rows(filters.filter_exclude(df, "code", ["XXX", ""])) == [("USD",)]


def test_filter_range_is_open(spark, rows):
    df = spark.createDataFrame([(1999,), (2000,), (2015,), (2016,), (None,)], "year int")
    assert rows(filters.filter_range(df, "year", 1999, 2016)) == [(2000,), (2015,)]


def test_filter_equals_and_label(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "c string, f string")
    assert rows(filters.filter_equals(df, c="a", f="x")) == [("a", "x")]
    assert rows(filters.filter_label(df, "c", "a", keep=False)) == [("b", "x")]


def test_filter_contains_minds_case_and_keeps_missing_when_negated(spark, rows):
    df = names(spark, "a local", "a LOCAL", "b", None)
    assert rows(filters.filter_contains(df, "food_name", "local")) == [("a local",)]
    kept = filters.filter_contains(df, "food_name", "local", keep=False)
    assert rows(kept) == [("a LOCAL",), ("b",), (None,)]


def test_complete_cases(spark, rows):
    df = spark.createDataFrame(
        [("", 1.0), ("x", math.nan), (None, 1.0), ("y", None), ("z", 2.0)],
        "t string, v double",
    )
    assert rows(filters.complete_cases(df)) == [("", 1.0), ("z", 2.0)]
    assert len(rows(filters.complete_cases(df, ["t"]))) == 4


def test_both_null_and_nonzero(spark, rows):
    df = spark.createDataFrame([(None, None), (None, 1.0), (0.0, 2.0)], "a double, b double")
    assert rows(filters.filter_both_null(df, "a", "b")) == [(None, None)]
    assert rows(filters.filter_nonzero(df, "b")) == [(0.0, 2.0), (None, 1.0)]
    assert rows(filters.filter_nonzero(df, "a")) == []


def test_min_group_size(spark, rows):
    df = spark.range(19).select(F.when(F.col("id") < 9, "nine").otherwise("ten").alias("k"))
    for key_rows in (None, 2):
        kept = filters.min_group_size(df, ["k"], key_rows=key_rows)
        assert rows(kept.groupBy("k").count()) == [("ten", 10)]


def test_drop_outliers(spark, rows):
    df = spark.createDataFrame(
        [("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 9.0, None])]
        + [("b", 9, 5.0)], "k string, i int, v double",
    )
    kept = filters.drop_outliers_by_spread(df, "v", ["k"], 1.5)
    assert kept.columns == df.columns
    assert rows(kept, "i") == [(0,), (1,), (2,), (3,), (5,), (9,)]
    listed = spark.createDataFrame([(4,), (5,)], "i int")
    assert rows(filters.drop_outlier_rows(df, listed, ["i"]), "i") == [
        (0,), (1,), (2,), (3,), (9,)
    ]
    missing = spark.createDataFrame([("a", None), ("b", None)], "k string, v double")
    assert rows(filters.drop_outlier_rows(df, missing, ["k", "v"]), "i") == [
        (0,), (1,), (2,), (3,), (4,), (9,)]


def test_rows_by_ordinal(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS place", "CAST(NULL AS INT) AS no")
    path = str(tmp_path / "ordered")
    save_in_order(df.repartition(7), path, ["place"])
    numbered = load_with_ordinals(spark, path)
    assert all(r.ordinal == r.place + 1 for r in numbered.collect())
    left = filters.drop_ordinals(numbered, [1, 500, 1000, 5000])
    keys = df.where("place IN (0, 499, 999)").select("id", "no")
    same = filters.drop_outlier_rows(df, keys, ["id", "no"])
    assert {r.id for r in left.collect()} == {r.id for r in same.collect()}


WIDE = "country string, country_code string, X2000 double, X2001 double"


def test_join_ppp_is_a_lookup(spark, rows):
    food = spark.createDataFrame(
        [("A", 2000), ("A", 2001), ("A", 2002), ("B", 2000), ("C", 2000)],
        "country string, year int",
    )
    wide = spark.createDataFrame(
        [("A", "a2", 9.0, 9.0), ("A", "a1", 2.0, None), ("B", "b", 3.0, 4.0)], WIDE
    )
    for bound in (None, 3):
        assert rows(joins.join_ppp(food, wide, bound), "country", "year", "ppp_factor") == [
            ("A", 2000, 2.0), ("A", 2001, None), ("A", 2002, None), ("B", 2000, 3.0),
            ("C", 2000, None),
        ]


def test_unused_factor_is_not_looked_up(spark):
    food = spark.createDataFrame([("A", 2000, 1.0)], "country string, year int, price double")
    wide = spark.createDataFrame([("A", "a", 2.0, 3.0)], WIDE)
    plan = joins.join_ppp(food, wide, 1).select("country", "price")
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_unpivot_years(spark, rows):
    wide = spark.createDataFrame([("A", "a", 2.0, None)], WIDE)
    assert rows(joins.unpivot_years(wide, ["country"])) == [("A", 2000, 2.0), ("A", 2001, None)]


def test_full_frequency(spark, rows):
    frequency = spark.createDataFrame([("A", 2)], "Var1 string, Freq long")
    domain = spark.createDataFrame([("A",), ("B",)], "Var1 string")
    intended = joins.join_full_frequency(frequency, domain)
    assert rows(intended, "Var1", "Freq") == [("A", 2), ("B", None)]
    written = joins.join_full_frequency(frequency, domain, as_written=True)
    assert rows(written) == [("A", 2), ("A", None), ("B", None)]


def test_grid(spark, rows):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "k string, year int")
    values = spark.createDataFrame([("A", 1, 5.0)], "k string, year int, v double")
    assert rows(joins.join_grid(df, values, "k", range(1, 3))) == [
        ("A", 1, 5.0), ("A", 2, None), ("B", 1, None), ("B", 2, None)
    ]


def test_import_label_union(spark, rows):
    df = names(
        spark, "Rice (whiteimported)", "Rice (low qualitylocal)", "x (importedlocal)", "Rice",
        "Rice (IMPORTED)",
    )
    assert rows(unions.import_label_union(df)) == sorted([
        ("Rice (whiteimported)", "Import"), ("Rice (low qualitylocal)", "Not Import"),
        ("Rice (low qualitylocal)", "Local"), ("x (importedlocal)", "Import"),
        ("x (importedlocal)", "Local"), ("Rice", "Not Import"),
        ("Rice (IMPORTED)", "Not Import"),
    ], key=repr)


def test_neither_union(spark, rows):
    df = names(spark, "a import", "a local", "a importlocal", "a")
    assert rows(unions.neither_union(df)) == [("a",)]
    assert rows(unions.neither_union(df, as_written=True)) == [
        ("a import",), ("a local",), ("a",), ("a",)
    ]


def test_union_all_fills_absent_columns(spark, rows):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert rows(unions.union_all(a, b, a, fill=True)) == [(1, 2), (1, 2), (3, None)]


def test_frequency_counts_absent_names_as_zero(spark, rows):
    df = spark.createDataFrame([("A",), ("A",), (None,)], "country string")
    domain = spark.createDataFrame([("A",), ("B",)], "Var1 string")
    assert rows(statistics.frequency(df)) == [("A", 2)]
    assert rows(statistics.frequency(df, domain=domain)) == [("A", 2), ("B", 0)]
