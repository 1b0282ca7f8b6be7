import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import windows


def priced(spark, prices, key="a"):
    data = [(key, i, p) for i, p in enumerate(prices)]
    return spark.createDataFrame(data, "country string, i int, price double")


def test_monthly_inflation(spark):
    df = windows.monthly_inflation(priced(spark, [10.0, 12.0, 6.0]), ["i"])
    change = [r["monthly_inflation"] for r in df.orderBy("i").collect()]
    assert change[0] is None
    assert change[1:] == pytest.approx([20.0, -50.0])


def test_zero_price_gives_no_change(spark):
    df = windows.monthly_inflation(priced(spark, [0.0, 12.0, None, 6.0]), ["i"])
    change = [r["monthly_inflation"] for r in df.orderBy("i").collect()]
    assert change == [None, None, None, None]


def mixed(spark):
    chance = random.Random(7)
    # One country has most rows; keys, order columns and values may be missing.
    data = [
        (chance.choice(["a", "a", "a", "a", "b", "c", None]), chance.choice([None, *range(12)]),
         chance.randrange(4), i,
         chance.choice([None, float(chance.randrange(99))]))
        for i in range(600)
    ]
    return spark.createDataFrame(data, "k string, d int, e int, i int, v double").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 100, 1000])
@pytest.mark.parametrize("keys", [[], ["k"], ["k", "e"]])
def test_previous_value_equals_plain_lag(spark, rows, keys, size):
    df = mixed(spark)
    order = [c for c in ("d", "e", "i") if c not in keys]
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy(*keys).orderBy(*order)))
    assert rows(windows.previous_value(df, "v", "p", keys, order, size)) == rows(plain)


def test_previous_value_of_no_rows(spark):
    none = mixed(spark).limit(0)
    assert windows.previous_value(none, "v", "p", ["k"], ["d", "i"], 7).collect() == []


def test_equal_rows_keep_their_number(spark):
    same = spark.range(50).select(F.lit("a").alias("k"), F.lit(1).alias("i"), F.lit(2.0).alias("v"))
    found = windows.previous_value(same, "v", "p", ["k"], ["i"], 7).collect()
    assert sorted(str(r["p"]) for r in found) == ["2.0"] * 49 + ["None"]


def test_stretches_are_of_the_size_asked(spark):
    """One hot series is cut as evenly as many short ones; each bound has one copy."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") / 30).cast("int").cast("string"))
        .alias("k"), "id")
    cut = windows.stretches(df, ["k"], ["id"], 1000)
    sizes = {r["_stretch"]: r["n"] for r in
             cut.filter("NOT _copy").groupBy("_stretch").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 20000 and 18 <= len(sizes) <= 23
    assert max(sizes.values()) < 2500
    assert cut.filter("_copy").count() in (len(sizes) - 1, len(sizes))


def test_rows_are_shuffled_once(spark):
    plan = windows.previous_value(mixed(spark), "v", "p", ["k"], ["d", "i"], 7)
    physical = plan._jdf.queryExecution().executedPlan().toString()
    main = physical.split("Subqueries")[0]
    assert main.count("hashpartitioning(_stretch") == 1 and "Join" not in main


def test_a_copy_does_not_follow_its_original(spark):
    """A row labelled twice stands in two blocks, so its copy follows another copy."""
    from larder.operators.unions import import_block, import_label_union

    data = [("a", i, p, "rice (local)") for i, p in enumerate([10.0, 12.0, 6.0])]
    df = spark.createDataFrame(data, "country string, i int, price double, food_name string")
    stacked = import_label_union(df).withColumn("import_block", import_block())
    out = windows.monthly_inflation(stacked, ["import_block", "i"])
    found = {(r["import"], r["i"]): r["monthly_inflation"] for r in out.collect()}
    assert found[("Not Import", 0)] is None
    assert found[("Not Import", 1)] == pytest.approx(20) == found[("Local", 1)]
    assert found[("Not Import", 2)] == pytest.approx(-50) == found[("Local", 2)]
    assert found[("Local", 0)] == pytest.approx(100 * (10 / 6 - 1))


def grouped(spark):
    data = [("Rice", "a", "Rice", i, 1.0 + i) for i in range(10)]
    data += [("Rice", "b", "Rice", i, 1.0) for i in range(9)]
    data += [("Oil", "a", "Oil", i, 2.0) for i in range(12)]
    return spark.createDataFrame(
        data, "food_group string, country string, food_name string, i int, price double"
    )


def test_food_group_by_needs_ten_rows(spark, rows):
    out = windows.food_group_by(grouped(spark), ["i"], "Rice")
    assert rows(out.groupBy("country").count()) == [("a", 10)]
    every = windows.food_group_by(grouped(spark), ["i"], key_rows=3)
    assert rows(every.groupBy("food_group", "country").count()) == [
        ("Oil", "a", 12), ("Rice", "a", 10)
    ]
    assert every.filter("monthly_inflation IS NULL").count() == 2


def test_country_food_series(spark):
    assert windows.country_food_series(grouped(spark), ["i"], "a", "Rice").count() == 10
    assert windows.country_food_series(grouped(spark), ["i"], "b", "Rice").count() == 0
