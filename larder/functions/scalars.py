"""Per-row expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.fixed_values import RECODED_CURRENCY, UNIT_RULES


def pad_month(month: Column) -> Column:
    """Two-digit month text; text that is already padded stays as it is."""
    text = month.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def month_date(year: Column, month: Column) -> Column:
    """First day of the month; missing where year and month name no real month."""
    number = month.try_cast("int")
    real = number.between(1, 12) & year.between(1, 9999)
    return F.when(real, F.make_date(year, number, F.lit(1)))


def divide(above: Column, below: Column) -> Column:
    """Quotient, missing where the divisor is zero."""
    return F.try_divide(above, below)


def recode(values: Column, rules: Mapping[str, str]) -> Column:
    """Exact-match replacement; values without a rule stay as they are."""
    pairs = [F.lit(text) for rule in rules.items() for text in rule]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), values), values)


def recode_currency(currency: Column) -> Column:
    old, new = RECODED_CURRENCY
    return F.when(currency == old, F.lit(new)).otherwise(currency)


def normalize_unit(unit: Column) -> Column:
    return recode(unit, UNIT_RULES)


def unit_amount(unit: Column) -> Column:
    """The piece before the first space, as text."""
    return F.get(F.split(unit, " "), F.lit(0))


def unit_type(unit: Column) -> Column:
    """The piece after the first space; later pieces are dropped."""
    return F.get(F.split(unit, " "), F.lit(1))


def to_number(text: Column) -> Column:
    """Text as a double, missing where it is not a number.

    Only text that may be a number is parsed: each failed parse throws in the JVM.
    """
    return F.when(text.rlike(r"[0-9]|(?i)inf|nan"), text.try_cast("double"))


def group_of_name(name: Column, groups: Mapping[str, Iterable[str]]) -> Column:
    """The group that lists ``name``, else the name itself."""
    found = [F.when(name.isin(list(names)), F.lit(g)) for g, names in groups.items()]
    return F.coalesce(*found, name)


def import_label(name: Column) -> Column:
    """One exclusive label: Import or Local by what the name contains."""
    return (
        F.when(name.contains("import"), F.lit("Import"))
        .when(name.contains("local"), F.lit("Local"))
        .otherwise(F.lit("Not Listed"))
    )


def plain_number(value: Column) -> Column:
    """A number as text without an exponent, keeping every digit.

    Spark writes doubles of 1e7 and more, or below 1e-3, as ``d.dddE±n``; the digits
    are kept and the point moved, so reading the text gives the same double.
    """
    text = value.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    head = F.substring_index(text, "E", 1)
    digits = F.replace(F.replace(head, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    power = F.substring_index(text, "E", -1).try_cast("int")
    left = F.rpad(digits, power + 1, "0")
    grown = F.concat(sign, left.substr(F.lit(1), power + 1), F.lit("."),
                     digits.substr(power + 2, F.length(digits)))
    shrunk = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    moved = F.rtrim(F.when(power >= 0, grown).otherwise(shrunk), F.lit("0"))
    plain = F.when(text.contains("E"), moved).otherwise(text)
    whole = plain.endswith(".0") | plain.endswith(".")
    return F.when(whole, F.substring_index(plain, ".", 1)).otherwise(plain)
