"""The tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.fixed_values import HISTOGRAM_BINS
from larder.operators.quantiles import coded_counts, present, quantiles_of, same_keys
from larder.sizing import bounded


def series_table(
    df: DataFrame,
    value: str,
    colour: str | None = None,
    facet: str | None = None,
) -> DataFrame:
    """Points of a line chart, ordered along each line.

    The value closes the sort key, so that a line with most of the points can still be
    cut into several sorted ranges.
    """
    keys = {"facet": facet, "colour": colour}
    named = [F.col(c).alias(name) for name, c in keys.items() if c]
    points = df.select(*named, "date", F.col(value).alias("value"))
    return points.orderBy(*points.columns)


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def trend_table(
    df: DataFrame, value: str, keys: Sequence[str], months: int = 6
) -> DataFrame:
    """Smooth line per group: the mean of all points within ``months`` months either
    side, and the least-squares line of value over month number.

    Points are first summed per month, so the window holds months, not points.
    """
    month, y = month_index(F.col("date")), F.col(value)
    monthly = (
        df.filter(y.isNotNull() & F.col("date").isNotNull())
        .groupBy(*keys, month.alias("month_index"))
        .agg(F.count(y).alias("_n"), F.avg(y).alias("_mean"))
    )
    group = Window.partitionBy(*keys)
    near = group.orderBy("month_index").rangeBetween(-months, months)
    n, x, mean = F.col("_n"), F.col("month_index"), F.col("_mean")
    # Points weighted by month give the same line as the single points.
    rows = F.sum(n).over(group)
    with_centre = monthly.withColumns({
        "smooth": F.sum(n * mean).over(near) / F.sum(n).over(near),
        "_x": F.sum(n * x).over(group) / rows,
        "_y": F.sum(n * mean).over(group) / rows,
    })
    dx, dy = x - F.col("_x"), mean - F.col("_y")
    slope = F.try_divide(F.sum(n * dx * dy).over(group), F.sum(n * dx * dx).over(group))
    with_slope = with_centre.withColumn("slope", slope)
    line = F.col("_y") - F.col("slope") * F.col("_x")
    return with_slope.select(
        *keys, "month_index", n.alias("points"), "smooth", "slope", line.alias("intercept")
    )


def local_trend_table(
    df: DataFrame, value: str, keys: Sequence[str], span: float = 0.75
) -> DataFrame:
    """Smooth line per group by local regression, at every month that has points.

    A quadratic is fitted around each month to the nearest ``span`` of the group's points, with
    tricube weights that fall to zero at the farthest of these; its value at the month is the
    line. Where fewer than three months have weight the fit is a straight line, with a single one
    the mean. Points are first summed per month: what is held per group is its months, however
    many points they have. A missing value, NaN or date takes no part.
    """
    y = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    monthly = (
        df.filter(y.isNotNull() & F.col("date").isNotNull())
        .groupBy(*keys, month_index(F.col("date")).alias("x"))
        .agg(F.count(y).cast("double").alias("n"), F.avg(y).alias("y"))
    )
    group = Window.partitionBy(*keys)
    months = monthly.select(
        *keys, "x", "n", F.collect_list(F.struct("x", "n", "y")).over(group).alias("_months"),
        F.greatest(F.floor(F.sum("n").over(group) * span + 1e-5), F.lit(1)).alias("_least"),
    )

    def farther(state: Column, near: Column) -> Column:
        """The points counted so far, and the distance where they first suffice."""
        counted = state["n"] + near["n"]
        found = F.when(counted >= F.col("_least"), near["d"])
        return F.struct(counted.alias("n"), F.coalesce(state["d"], found).alias("d"))

    distances = F.array_sort(F.transform("_months", lambda m: F.struct(
        F.abs(m["x"] - F.col("x")).cast("double").alias("d"), m["n"].alias("n"))))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("d"))
    reached = months.withColumn("_reach", F.aggregate(distances, start, farther)["d"])

    def weighed(m: Column) -> Column:
        """A month's offset in units of the reach, its weight and its mean."""
        offset = F.coalesce(F.try_divide(m["x"] - F.col("x"), F.col("_reach")),
                            F.signum((m["x"] - F.col("x")).cast("double")))
        weight = F.when(F.abs(offset) < 1, m["n"] * F.pow(1 - F.pow(F.abs(offset), 3.0), 3.0))
        return F.struct(offset.alias("u"), F.coalesce(weight, F.lit(0.0)).alias("w"),
                        m["y"].alias("y"))

    def summed(state: Column, m: Column) -> Column:
        """Moments of the offsets (s) and of the offsets with the value (t), and the months."""
        u, w = m["u"], m["w"]
        steps = {"s0": w, "s1": w * u, "s2": w * u * u, "s3": w * u * u * u,
                 "s4": w * u * u * u * u, "t0": w * m["y"], "t1": w * u * m["y"],
                 "t2": w * u * u * m["y"], "months": F.when(w > 0, 1.0).otherwise(0.0)}
        return F.struct(*((state[name] + step).alias(name) for name, step in steps.items()))

    names = ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "months")
    nothing = F.struct(*(F.lit(0.0).alias(name) for name in names))
    fitted = reached.withColumn(
        "_m", F.aggregate(F.transform("_months", weighed), nothing, summed))
    s0, s1, s2, s3, s4, t0, t1, t2, used = (F.col("_m")[name] for name in names)
    # Cramer's rule for the fit's value where the offset is zero.
    c0, c1, c2 = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    curve = (t0 * c0 - t1 * c1 + t2 * c2) / (s0 * c0 - s1 * c1 + s2 * c2)
    line = (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1)
    smooth = F.when(used >= 3, curve).when(used == 2, line).otherwise(t0 / s0)
    return fitted.select(*keys, F.col("x").alias("month_index"),
                         F.col("n").cast("long").alias("points"), smooth.alias("smooth"))


def histogram_table(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "monthly_inflation",
    bins: int = HISTOGRAM_BINS,
    key_rows: int | None = None,
) -> DataFrame:
    """Counts in ``bins`` equal bins from smallest to largest value of each group.

    Bins hold their left end, the last one both ends; one single value is bin 1.
    """
    v = F.col(value)
    known = present(df, value, keys)
    ends = known.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    placed = same_keys(known, bounded(ends, key_rows), keys)
    low, high, last = F.col("low"), F.col("high"), F.lit(bins)
    # A largest value falls past the end, and equal ends make no bins at all.
    number = F.least(F.width_bucket(v, low, high, last), last).cast("int")
    placed = placed.withColumn("bin", F.when(low == high, 1).otherwise(number))
    return placed.groupBy(*keys, "low", "high", "bin").agg(F.count(F.lit(1)).alias("count"))


def boxplot_table(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "monthly_inflation",
    key_rows: int | None = None,
) -> DataFrame:
    """Quartiles, whiskers and outlier count of each group.

    Whiskers end at the last value within 1.5 interquartile ranges of the box.
    """
    return boxplot_of(coded_counts(df, value, keys), keys, value, key_rows)


def boxplot_of(
    coded: DataFrame, keys: Sequence[str], value: str = "monthly_inflation",
    key_rows: int | None = None,
) -> DataFrame:
    """The same from ``coded_counts``, which it reads several times."""
    box = quantiles_of(coded, value, keys, (0.25, 0.5, 0.75), key_rows).withColumnsRenamed(
        {"q1": "lower", "q2": "middle", "q3": "upper"}
    )
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    v = F.col(value)
    inside = v.between(F.col("lower") - reach, F.col("upper") + reach)
    return (
        same_keys(coded, bounded(box, key_rows), keys)
        .groupBy(*keys, "lower", "middle", "upper")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        )
    )


def bar_table(cost: DataFrame) -> DataFrame:
    """Bars of the yearly cost by country, one facet per year."""
    return cost.select(F.col("year").alias("facet"), "country", "price_to_survive")


def spread_vs_mean(stats: DataFrame) -> DataFrame:
    """Points of mean inflation against its spread."""
    return stats.select("country", "avg_infla", "stdev")


def region_country_series(
    df: DataFrame,
    region: str | None = None,
    value: str = "price_per_one_unit",
    together: int = 4,
    region_rows: int | None = None,
) -> DataFrame:
    """Every country's price line, by region (or of one region).

    ``layout`` is "combined" where a region has at most ``together`` countries, which
    then share one chart, else "per_country".
    """
    chosen = df if region is None else df.filter(F.col("region") == region)
    size = chosen.groupBy("region").agg(F.count_distinct(F.col("country")).alias("_n"))
    layout = F.when(F.col("_n") <= together, F.lit("combined")).otherwise(F.lit("per_country"))
    layouts = size.select("region", layout.alias("layout"))
    points = chosen.select("region", "country", "date", F.col(value).alias("value"))
    return points.join(bounded(layouts, region_rows), "region")


def region_country_histogram(
    df: DataFrame, region: str | None = None, key_rows: int | None = None
) -> DataFrame:
    """A histogram of monthly inflation per country, by region (or of one region)."""
    chosen = df if region is None else df.filter(F.col("region") == region)
    return histogram_table(chosen, ["region", "country"], key_rows=key_rows)


def region_series(region_averages: DataFrame, value: str = "price_per_one_unit") -> DataFrame:
    """One price line per region."""
    return region_averages.select("region", "date", F.col(value).alias("value"))
