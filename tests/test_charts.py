import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import charts
from larder.operators.quantiles import quantiles_by


@pytest.fixture(scope="module")
def spread(spark):
    """A hot group larger than the sketch, a tied one, and small ones."""
    chance = np.random.default_rng(3)
    groups = {
        "hot": np.concatenate([chance.normal(0, 30, 40_000), np.zeros(20_000),
                               chance.pareto(1, 5_000) * 1e4]),
        "tied": np.repeat([1.0, 2.0, 2.5], [9_000, 9_000, 9_000]),
        "few": np.array([4.0, 1.0, 3.0, 2.0, 100.0]),
        "one": np.array([7.0]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    rows += [("hot", None), ("few", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, monthly_inflation double").repartition(6)
    return groups, df.cache()


@pytest.mark.parametrize("key_rows", [None, 5])
def test_quantiles_are_exact(spread, key_rows):
    groups, df = spread
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    out = quantiles_by(df, "monthly_inflation", ["k"], shares, key_rows).collect()
    assert {r["k"] for r in out} == set(groups)
    for row in out:
        expected = np.quantile(groups[row["k"]], shares)
        assert list(row)[1:] == pytest.approx(list(expected), rel=1e-12, abs=1e-12)


def test_quantiles_of_odd_values(spark):
    far = [float("-inf"), -1e300, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2 ** -52, 1e300, float("inf")]
    rows = [(None, v) for v in far] + [("k", 1e15 + i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [i / 9 for i in range(10)]
    found = {r["k"]: list(r)[1:] for r in quantiles_by(df, "v", ["k"], shares).collect()}
    assert found[None][1:9] == pytest.approx(far[1:9], rel=1e-12, abs=0)
    assert found["k"] == pytest.approx(np.quantile([v for k, v in rows if k], shares).tolist(), rel=1e-15)


def test_no_group_is_sorted(spark):
    df = spark.createDataFrame([("k", 1.0)], "k string, v double")
    plan = quantiles_by(df, "v", ["k"], (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window " in line]
    assert windows and all("_code" in w for w in windows)


def test_boxplot(spread):
    groups, df = spread
    for row in charts.boxplot_table(df, ["k"]).collect():
        values = groups[row["k"]]
        low, middle, high = np.quantile(values, (0.25, 0.5, 0.75))
        inside = (values >= low - 1.5 * (high - low)) & (values <= high + 1.5 * (high - low))
        assert row["middle"] == pytest.approx(middle)
        assert row["whisker_low"] == values[inside].min()
        assert row["whisker_high"] == values[inside].max()
        assert row["outliers"] == (~inside).sum()


def test_histogram_holds_every_value(spread):
    groups, df = spread
    out = charts.histogram_table(df, ["k"], key_rows=5).collect()
    for key, values in groups.items():
        bins = {r["bin"]: r["count"] for r in out if r["k"] == key}
        assert sum(bins.values()) == len(values)
        assert min(bins) == 1 and max(bins) == (25 if len(set(values)) > 1 else 1)
        if key == "few":
            counts, _ = np.histogram(values, bins=25)
            assert bins == {i + 1: n for i, n in enumerate(counts) if n}


def test_trend(spark):
    dates = [dt.date(2001 + m // 12, m % 12 + 1, 1) for m in range(30) for _ in range(m % 3 + 1)]
    months = np.array([d.year * 12 + d.month - 1 for d in dates])
    values = np.sin(months) * 5 + months * 0.3
    df = spark.createDataFrame(
        [("a", d, float(v)) for d, v in zip(dates, values)] + [("a", dates[0], None)],
        "k string, date date, v double",
    )
    slope, intercept = np.polyfit(months, values, 1)
    out = charts.trend_table(df, "v", ["k"]).collect()
    assert len(out) == 30
    for row in out:
        near = abs(months - row["month_index"]) <= 6
        assert row["smooth"] == pytest.approx(values[near].mean())
        assert row["slope"] == pytest.approx(slope)
        assert row["intercept"] == pytest.approx(intercept, rel=1e-6)


def test_region_layout(spark, rows):
    data = [("big", f"c{i}") for i in range(5)] + [("small", "x"), ("small", "y")]
    df = spark.createDataFrame(data, "region string, country string").withColumns(
        {"date": F.lit(dt.date(2001, 1, 1)), "price_per_one_unit": F.lit(1.0)})
    layouts = charts.region_country_series(df).select("region", "layout").distinct()
    assert rows(layouts) == [("big", "per_country"), ("small", "combined")]
    assert charts.region_country_series(df, "small", region_rows=2).count() == 2


def test_series_is_ordered(spark):
    df = spark.createDataFrame(
        [("b", dt.date(2001, 2, 1), 1.0), ("b", dt.date(2001, 1, 1), 2.0),
         ("a", dt.date(2001, 3, 1), 3.0)], "country string, date date, p double")
    out = [tuple(r) for r in charts.series_table(df, "p", "country").collect()]
    assert [v for *_, v in out] == [3.0, 2.0, 1.0]


def local_fit(x, y, at, span=0.75):
    """The local quadratic at ``at`` by numpy, from single points."""
    distance = np.abs(x - at)
    reach = np.sort(distance)[max(int(np.floor(len(x) * span + 1e-5)), 1) - 1]
    near = (distance < reach) | (distance == 0)
    weight = (1 - (distance[near] / max(reach, 1)) ** 3) ** 3
    degree = min(len(set(x[near])) - 1, 2)
    return np.polyval(np.polyfit(x[near] - at, y[near], degree, w=np.sqrt(weight)), 0)


def test_local_trend_is_a_local_quadratic(spark):
    chance = np.random.default_rng(5)
    groups = {
        "long": np.sort(chance.integers(0, 40, 300)),
        "hot month": np.concatenate([[3] * 500, np.arange(0, 12)]),
        "two months": np.array([1, 1, 9]),
        "one": np.array([4]),
    }
    data, points = [], {}
    for key, months in groups.items():
        values = np.sin(months / 4) * 20 + chance.normal(0, 1, len(months))
        points[key] = (months + 2001 * 12, values)
        data += [(key, dt.date(2001 + m // 12, int(m % 12) + 1, 1), float(v))
                 for m, v in zip(months.tolist(), values)]
    data += [("long", dt.date(2001, 1, 1), None), ("long", None, 1.0),
             ("one", dt.date(2001, 2, 1), float("nan")), ("none", dt.date(2001, 1, 1), None)]
    df = spark.createDataFrame(data, "k string, date date, v double")
    out = charts.local_trend_table(df, "v", ["k"]).collect()
    assert {(r["k"], r["month_index"]) for r in out} == {
        (k, m) for k, (months, _) in points.items() for m in months.tolist()}
    for row in out:
        x, y = points[row["k"]]
        assert row["points"] == (x == row["month_index"]).sum()
        assert row["smooth"] == pytest.approx(local_fit(x, y, row["month_index"]), rel=1e-6)
    assert charts.local_trend_table(df.limit(0), "v", ["k"]).count() == 0
