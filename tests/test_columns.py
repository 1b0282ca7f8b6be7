import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder import fixed_values as V
from larder.functions import scalars as S
from larder.operators import columns as C


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("unit, amount, kind", [
    ("KG", 1000.0, "G"), ("Marmite", 2500.0, "G"), ("400 G", 400.0, "G"),
    ("Bunch", None, None), ("a b c", None, "b"), ("750 ML", 0.75, "L"),
    ("Cuartilla", 2721.55422, "G"), ("100 Tubers", 100.0, "Unit"), (None, None, None),
])
def test_unit_becomes_amount_and_type(spark, unit, amount, kind):
    df = spark.createDataFrame([(unit,)], "unit string")
    row = C.to_number(C.split_unit(C.normalize_unit(df)), "unit").first()
    assert (row["unit"], row["unit_type"]) == (amount, kind)


@pytest.mark.parametrize("month, padded", [("3", "03"), ("03", "03"), ("12", "12")])
def test_pad_month_twice_is_once(spark, month, padded):
    assert one(spark, month, S.pad_month) == padded


@pytest.mark.parametrize("year, month, day", [
    (2003, "07", dt.date(2003, 7, 1)), (2003, "7", dt.date(2003, 7, 1)),
    (2003, "13", None), (2003, None, None), (None, "07", None), (2003, "x", None),
])
def test_month_date(spark, year, month, day):
    df = spark.createDataFrame([(year, month)], "year int, month string")
    assert C.month_date(df).first()["date"] == day


def test_recode_currency(spark, rows):
    df = spark.createDataFrame([("Somaliland Shilling",), ("USD",), (None,)], "currency string")
    assert rows(C.recode_currency(df)) == [("SOS",), ("USD",), (None,)]


@pytest.mark.parametrize("text, number", [
    ("12", 12.0), ("1e3", 1000.0), (" 7 ", 7.0), ("Bunch", None), ("a1", None), ("", None),
    (None, None), ("-0.5", -0.5),
])
def test_to_number(spark, text, number):
    assert one(spark, text, S.to_number) == number


@pytest.mark.parametrize("name, group", [
    ("Rice (red nadu)", "Rice"), ("Beans(mash)", "Beans"), ("Sorghum (food aid)", "Sorghum"),
    ("Maize meal (whiteroller)", "Maize"), ("Millet", "Millet"), ("rice", "rice"),
])
def test_unify_food_group(spark, name, group):
    df = spark.createDataFrame([(name, "joined")], "food_name string, food_group string")
    assert C.unify_food_group(df).first()["food_group"] == group


def test_fixed_values_are_complete():
    sizes = {group: len(names) for group, names in V.GROUPED_FOOD_NAMES.items()}
    assert sizes == {"Rice": 34, "Beans": 21, "Sorghum": 5, "Maize": 12}
    assert len(V.UNIT_RULES) == 32 and len(V.CLEAN_FOOD) == 20


@pytest.mark.parametrize("name, label", [
    ("Rice (whiteimported)", "Import"), ("Rice (local)", "Local"), ("Rice", "Not Listed"),
    ("Rice (LOCAL)", "Not Listed"),
])
def test_contains_label(spark, name, label):
    df = spark.createDataFrame([(name,)], "food_name string")
    assert C.contains_label(df).first()["import"] == label


def test_prices(spark):
    df = spark.createDataFrame(
        [(10.0, 4.0, 5.0), (10.0, 0.0, 5.0), (10.0, None, 5.0), (10.0, 4.0, 0.0)],
        "price double, ppp_factor double, unit double",
    )
    priced = C.price_per_one_unit(C.unified_price(df))
    out = [tuple(r) for r in priced.select("unified_price", "price_per_one_unit").collect()]
    assert out == [(2.5, 0.5), (None, None), (None, None), (2.5, None)]


def test_columns_by_name_and_position(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a.b", "c", "d", "e"])
    assert C.drop_columns(df, "c", "absent").columns == ["a.b", "d", "e"]
    assert C.drop_column_range(df, 2, 3).columns == ["a.b", "e"]
    assert C.rename_columns(df, {"a.b": "x", "absent": "y"}).columns == ["x", "c", "d", "e"]
    assert C.select_reorder(df, ["e", "c"]).columns == ["e", "c"]
    assert C.add_constant(df, "import", "Local").first()["import"] == "Local"


@pytest.mark.parametrize("value, text", [
    (12345678.9, "12345678.9"), (1e7, "10000000"), (-2.5e-7, "-0.00000025"), (0.1, "0.1"),
    (1000.0, "1000"), (1.5e20, "150000000000000000000"), (0.0, "0"), (None, None),
])
def test_plain_number(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    out = df.select(S.plain_number(F.col("x")).alias("t")).first()["t"]
    assert out == text
    assert value is None or float(out) == value
