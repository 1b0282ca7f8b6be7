"""Exact quantiles of groups of any size, by radix selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sizing import bounded

# Bits of the fraction in a value's code: values of one code differ by less than a part in so
# many powers of two.
BITS = 12
EXPONENTS = 1100  # above the least exponent there is
LARGEST = 1.7e308


def present(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """The keys and the value, rows without a value left out."""
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, value)


def same_keys(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on equal keys, where missing equals missing."""
    marks = {k: f"_key_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(m)) for k, m in marks.items()]
    return df.join(groups.withColumnsRenamed(marks), on).drop(*marks.values())


def coded_counts(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Each value of each group once, with its rows as ``_n`` and its ``_code``.

    A code is made of a number's leading bits: sign, exponent and ``BITS`` of the fraction. So
    codes follow the order of the values. Store the table where several operators read it.
    """
    v = F.col(value)
    counts = present(df, value, keys).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.abs(v), F.lit(LARGEST))
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    # Where rounding gives the neighbouring exponent, the fraction leaves [1, 2) to match.
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << BITS))
    code = (exponent + EXPONENTS) * (1 << BITS) + fraction
    signed = F.when(v < 0, -code).otherwise(code)
    return counts.withColumn("_code", F.coalesce(signed, F.lit(0)).cast("long"))


def holding(
    targets: DataFrame, cells: DataFrame, within: Sequence[str], cell: str, bound: int | None,
) -> DataFrame:
    """For each target (``within``, _place, _rank) the cell that holds its rank.

    ``cells`` count rows (_n) per ``within`` and ``cell``; ``_ahead``, where there is one, says how
    many rows lie before all of them.
    """
    order = Window.partitionBy(*within).orderBy(cell)
    upto = F.sum("_n").over(order)
    if "_ahead" in cells.columns:
        upto += F.col("_ahead")
    counted = cells.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    found = same_keys(counted.select(*within, cell, "_before", "_upto"),
                      bounded(targets, bound), within)
    rank = F.col("_rank")
    return found.filter((rank >= F.col("_before")) & (rank < F.col("_upto"))).drop("_upto")


def quantiles_of(
    coded: DataFrame, value: str, keys: Sequence[str], shares: Sequence[float],
    key_rows: int | None = None,
) -> DataFrame:
    """Quantiles ``q1``, ``q2``, ... of each group of ``coded_counts``, interpolated between
    neighbours.

    Rows counted per code tell which codes hold a quantile's two neighbours; only the distinct
    values of those codes are put in order. No group is sorted.
    """
    keys, v = list(keys), F.col(value)
    totals = coded.groupBy(*keys).agg(F.sum("_n").alias("_total"))

    def place(share: float) -> Column:
        return F.lit(float(share)) * (F.col("_total") - 1)

    ranks = [f(place(share)) for share in shares for f in (F.floor, F.ceil)]
    targets = totals.select(
        *keys, "_total", F.posexplode(F.array(*ranks)).alias("_place", "_rank"))
    bound = None if key_rows is None else key_rows * len(ranks)

    codes = coded.groupBy(*keys, "_code").agg(F.sum("_n").alias("_n"))
    found = holding(targets, codes, keys, "_code", bound)
    chosen = found.select(*keys, "_code", F.col("_before").alias("_ahead")).distinct()
    last = same_keys(coded, bounded(chosen, bound), [*keys, "_code"])
    found = holding(found.drop("_before"), last, [*keys, "_code"], value, bound)

    def at(number: int) -> Column:
        return F.max(F.when(F.col("_place") == number, v))

    near = found.groupBy(*keys, "_total").agg(*(at(i).alias(f"_v{i}") for i in range(len(ranks))))
    return near.select(*keys, *(
        (F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}"))
         * (place(share) - F.floor(place(share)))).alias(f"q{i + 1}")
        for i, share in enumerate(shares)
    ))


def quantiles_by(
    df: DataFrame, value: str, keys: Sequence[str], shares: Sequence[float],
    key_rows: int | None = None,
) -> DataFrame:
    """``quantiles_of`` the values present in each group.

    Spark's ``percentile`` holds all values of a group in one task.
    """
    return quantiles_of(coded_counts(df, value, keys), value, keys, shares, key_rows)
