"""Month-over-month change: the previous row of a group, at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.fixed_values import MIN_GROUP_ROWS
from larder.functions.scalars import divide
from larder.operators.filters import filter_equals, min_group_size

# Rows that one task puts in order, on average.
STRETCH_ROWS = 50_000
# Rows looked at for each bound between stretches: the more, the more alike the stretches.
SAMPLED = 8
# Most bounds. They travel with every task; on tables of more rows than
# STRETCH_ROWS * MOST_BOUNDS the stretches grow instead.
MOST_BOUNDS = 20_000
_HASHES = 1 << 40


def bounds(df: DataFrame, columns: Sequence[str], rows: int) -> Column:
    """An ascending array of rows of ``df``, as structs of ``columns``, about ``rows`` apart.

    They come from a sample by hash, so all bounds are the same whenever they are computed.
    The column is a scalar subquery: it is computed as the query runs, once.
    """
    total = F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")
    wanted = F.least(F.ceil(total / rows).cast("double"), F.lit(float(MOST_BOUNDS)))
    below = df.agg((wanted * SAMPLED / total * F.lit(float(_HASHES))).alias("_below")).scalar()
    sample = df.filter(F.pmod(F.xxhash64(*columns), F.lit(_HASHES)) < below)
    ordered = sample.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_rows"))
    return ordered.select(F.array_distinct(
        F.filter("_rows", lambda _, i: i % SAMPLED == SAMPLED - 1))).scalar()


def with_stretch(df: DataFrame, limits: Column, columns: Sequence[str]) -> DataFrame:
    """Add ``_stretch``: how many of the ascending ``limits`` lie before the row, by bisection."""
    # One column, so that the subquery stands in the plan once; it is gone before the shuffle.
    found = df.withColumns(
        {"_limits": limits, "_row": F.struct(*columns), "_stretch": F.lit(0)})
    for power in reversed(range(MOST_BOUNDS.bit_length())):
        place = F.col("_stretch") + F.lit((1 << power) - 1)
        further = F.get("_limits", place) < F.col("_row")
        step = F.when(further, F.lit(1 << power)).otherwise(F.lit(0))
        found = found.withColumn("_stretch", F.col("_stretch") + step)
    return found


def stretches(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], rows: int = STRETCH_ROWS
) -> DataFrame:
    """``df`` with ``_stretch``, its place in a cut of all rows, by ``partition`` and ``order``.

    The cut knows no series: a long one lies in many stretches, many short ones in one. The
    row that ends a stretch also stands in the next one, there with ``_copy`` set.
    """
    columns = [*partition, *order]
    placed = with_stretch(df, bounds(df, columns, rows), columns)
    ends = F.get("_limits", F.col("_stretch")).eqNullSafe(F.col("_row"))
    placed = placed.withColumn("_ends", ends).drop("_limits", "_row")
    once, twice = F.array(F.lit(False)), F.array(F.lit(False), F.lit(True))
    copied = placed.withColumn("_copy", F.explode(F.when(F.col("_ends"), twice).otherwise(once)))
    place = F.col("_stretch") + F.col("_copy").cast("int")
    return copied.withColumn("_stretch", place).drop("_ends")


def previous_value(
    df: DataFrame,
    value: str,
    into: str,
    partition: Sequence[str],
    order: Sequence[str],
    rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Add ``into``: ``value`` of the row before, in ``order``, within ``partition``.

    A plain ``lag`` brings a whole partition into one task. Here a task orders one stretch of
    all rows (``stretches``), which starts with a copy of the row before it; the rows are
    shuffled once. The result equals the plain ``lag``. Rows that ``order`` doesn't tell apart
    follow each other in any order, as they do there.
    """
    keys, order = list(partition), list(order)
    inside = Window.partitionBy("_stretch").orderBy(*keys, *order)
    fields = [F.col(value).alias("v"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))]
    found = stretches(df, keys, order, rows).withColumn(
        "_before", F.lag(F.struct(*fields)).over(inside))
    same = F.lit(True)
    for i, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col("_before")[f"k{i}"])
    known = found.filter(~F.col("_copy")).withColumn(into, F.when(same, F.col("_before")["v"]))
    return known.drop("_before", "_stretch", "_copy")


def monthly_inflation(
    df: DataFrame,
    order: Sequence[str],
    partition: Sequence[str] = ("country",),
) -> DataFrame:
    """Percent change of ``price`` against the previous row of the partition.

    Missing on a partition's first row and after a price of zero.
    """
    known = previous_value(df, "price", "_previous", partition, order)
    ratio = divide(F.col("price"), F.col("_previous"))
    change = F.lit(100) * (ratio - F.lit(1))
    return known.withColumn("monthly_inflation", change).drop("_previous")


# One product sold in one place: the series whose price changes are comparable.
SERIES = ("country", "city", "market", "food_name", "seller_type", "currency", "unit")


def monthly_inflation_series(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = SERIES
) -> DataFrame:
    """Percent change within one product series instead of across a whole country."""
    return monthly_inflation(df, order, keys)


def food_group_by(
    food: DataFrame,
    order: Sequence[str],
    group: str | None = None,
    key_rows: int | None = None,
) -> DataFrame:
    """Rows of a food group (of every group if None) with monthly inflation.

    Countries with fewer than ten rows of a group are left out of that group.
    """
    keys = ["food_group", "country"]
    chosen = food if group is None else filter_equals(food, food_group=group)
    large = min_group_size(chosen, keys, MIN_GROUP_ROWS, key_rows)
    return monthly_inflation(large, order, keys)


def country_food_series(
    food: DataFrame,
    order: Sequence[str],
    country: str | None = None,
    food_name: str | None = None,
    key_rows: int | None = None,
) -> DataFrame:
    """The same for one (or, if None, every) country and exact food name.

    Fewer than ten rows give no rows.
    """
    chosen = food
    if country is not None:
        chosen = filter_equals(chosen, country=country)
    if food_name is not None:
        chosen = filter_equals(chosen, food_name=food_name)
    keys = ["country", "food_name"]
    large = min_group_size(chosen, keys, MIN_GROUP_ROWS, key_rows)
    return monthly_inflation(large, order, keys)
