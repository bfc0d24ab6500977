"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discounted(price: Column, discount: Column, tax: Column | None = None) -> Column:
    """price * (1 - discount), and * (1 + tax)."""
    out = price * (1 - discount)
    return out * (1 + tax) if tax is not None else out


def date_number(value: Column) -> Column:
    """A date as the integer yyyymmdd."""
    return (F.year(value) * 10000 + F.month(value) * 100 + F.dayofmonth(value)).cast("int")


def number_date(value: Column) -> Column:
    """The date of an integer yyyymmdd; null if there is none."""
    return F.to_date(F.lpad(value.cast("string"), 8, "0"), "yyyyMMdd")


def integer_of(value: Column, radix: int = 10) -> Column:
    """A number written in a radix from 2 to 36; null if it is none."""
    return F.when(value.rlike("^[+-]?[0-9A-Za-z]+$"), F.conv(F.regexp_replace(value, r"^\+", ""), radix, -10).cast("long"))


def exponential(mean: float | Column, uniform: Column) -> Column:
    """A draw from the exponential distribution, by a uniform one in [0, 1)."""
    return -F.lit(mean) * F.log(1 - uniform) if not isinstance(mean, Column) else -mean * F.log(1 - uniform)


def failure_probability(time: Column, mean: Column) -> Column:
    """That something with this mean time to failure fails within time."""
    return 1 - F.exp(-time / mean)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest prefix that two strings share."""
    n = F.least(F.length(a), F.length(b))
    different = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
    first = F.when(F.size(different) > 0, F.element_at(different, 1) - 1).otherwise(n)
    return F.when(n > 0, F.substr(a, F.lit(1), first)).otherwise(F.lit(""))


def harmonic(a: Column, b: Column) -> Column:
    """Rate of two steps one after the other."""
    return 1 / (1 / a + 1 / b)


def network_rate(backbone: Column, local: Column, copies: Column) -> Column:
    """Rate of each of several copies that share a backbone; none gives the local rate."""
    return F.when(copies <= 0, local).otherwise(F.least(backbone / copies, local))
