"""Ranges of a key: design, assignment, and pruning. A range holds start <= key < end; null bounds are open."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    start: Any = None
    end: Any = None

    def contains(self, value: Any) -> bool:
        return (self.start is None or value >= self.start) and (self.end is None or value < self.end)

    def column(self, key: Column) -> Column:
        """key is in the range; a null key is in none."""
        cond = key.isNotNull()
        if self.start is not None:
            cond = cond & (key >= self.start)
        if self.end is not None:
            cond = cond & (key < self.end)
        return cond


def _from_cuts(cuts: Sequence[Any]) -> list[Range]:
    bounds = [None, *cuts, None]
    return [Range(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def equal_width(least: Any, greatest: Any, n: int) -> list[Range]:
    """About n ranges of one width between the extremes; cuts that coincide collapse, so few keys give few ranges. The ends are open."""
    if n <= 1 or least is None or greatest is None or least == greatest:
        return [Range()]
    cuts: list[Any] = []
    if isinstance(least, str):
        cuts = split_strings(least, greatest, n)
    elif isinstance(least, int):
        cuts = [least + (greatest - least) * k // n for k in range(n)]
    else:
        cuts = [least + (greatest - least) * k / n for k in range(n)]
    return _from_cuts(list(dict.fromkeys(cuts)))


def split_strings(least: str, greatest: str, n: int) -> list[str]:
    """Cuts by the first character behind the common prefix of the extremes."""
    k = 0
    while k < min(len(least), len(greatest)) and least[k] == greatest[k]:
        k += 1
    low = ord(least[k]) if k < len(least) else 0
    high = ord(greatest[k]) if k < len(greatest) else 0
    points = dict.fromkeys(low + (high - low) * j // n for j in range(n))
    return [greatest[:k] + chr(p) for p in points]


def design(df: DataFrame, key: str, n: int) -> list[Range]:
    """equal_width() of a column's extremes: one row goes to the driver."""
    least, greatest = df.agg(F.min(key), F.max(key)).first()
    return equal_width(least, greatest, n)


def range_id(key: Column, ranges: Sequence[Range]) -> Column:
    """Number of the range that holds a key; keys beyond the ends belong to the first and the last, nulls to the first."""
    out = F.lit(0)
    for x in ranges[1:]:
        out = out + F.when(key >= x.start, 1).otherwise(0)
    return F.coalesce(out, F.lit(0)).cast("int")


def deal(df: DataFrame, key: str, ranges: Sequence[Range], name: str = "range_id") -> DataFrame:
    """df with its range number, dealt so that each range is one partition; the rows of a range need no sampling to find."""
    return df.withColumn(name, range_id(F.col(key), ranges)).repartitionById(len(ranges), F.col(name))


def disjoint(ranges: Sequence[Range]) -> bool:
    """No key is in two of the ranges."""

    ordered = sorted(ranges, key=lambda r: (r.start is not None, r.start if r.start is not None else 0))
    return all(a.end is not None and b.start is not None and a.end <= b.start for a, b in zip(ordered[:-1], ordered[1:], strict=True))


def to_json(value: Any) -> list | None:
    """A key as JSON with its type."""
    if value is None:
        return None
    return [type(value).__name__, value.isoformat() if isinstance(value, date) else value]


def from_json(value: list | None) -> Any:
    if value is None:
        return None
    kind, x = value
    return {"date": date.fromisoformat, "datetime": datetime.fromisoformat}[kind](x) if kind in ("date", "datetime") else x


def overlap(a: tuple[Any, Any], b: tuple[Any, Any]) -> bool:
    """Whether two (least, greatest) have a key in common; one of no keys has none."""
    return a[0] is not None and b[0] is not None and a[0] <= b[1] and b[0] <= a[1]
