"""Seeded substitution parameters of the 22 queries: each seed gives texts of its own, the same each time.

A parameter is a literal of the text in `tpch.SQL` and what may stand in its place. Fixed values: the spans and lists below,
as far as the data folder's columns have such values; years are moved to those that it holds.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from datetime import date

from tessera.plans import tpch
from tessera.plans.shared import Query, plain, query

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
COLOURS = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
FLAGS = ("A", "N", "R")
YEARS = (1995, 2000)

Draw = Callable[[random.Random], dict[str, str]]


def _number(literal: str, least: int, greatest: int) -> Draw:
    """A literal with one number in it, 0 standing for the drawn one."""
    shape = "".join("0" if c.isdigit() else c for c in literal)
    while "00" in shape:
        shape = shape.replace("00", "0")
    return lambda r: {literal: shape.replace("0", str(r.randint(least, greatest)))}


def _choice(literal: str, values: tuple[str, ...], shape: str = "'{}'") -> Draw:
    return lambda r: {literal: shape.format(r.choice(values))}


def _pair(literals: tuple[str, str], values: tuple[str, ...]) -> Draw:
    """Two different values."""
    return lambda r: {old: f"'{new}'" for old, new in zip(literals, r.sample(values, 2), strict=True)}


def _month(literal: str) -> Draw:
    return lambda r: {literal: f"DATE '{date(r.randint(*YEARS), r.randint(1, 12), 1)}'"}


def _year(first: str, last: str | None = None) -> Draw:
    """A year's first day, and that of the next one if `last` stands for it."""

    def draw(r: random.Random) -> dict[str, str]:
        y = r.randint(*YEARS)
        return {first: f"DATE '{y}-01-01'"} | ({last: f"DATE '{y + 1}-01-01'"} if last else {})

    return draw


def _brand(literal: str) -> Draw:
    return lambda r: {literal: f"'Brand#{r.randint(1, 25)}'"}


def _nations(*literals: str) -> Draw:
    return lambda r: {old: f"'NATION_{n}'" for old, n in zip(literals, r.sample(range(25), len(literals)), strict=True)}


def _sizes(r: random.Random) -> dict[str, str]:
    return {"(49, 14, 23, 45, 19, 3, 36, 9)": "(" + ", ".join(map(str, r.sample(range(1, 51), 8))) + ")"}


def _codes(r: random.Random) -> dict[str, str]:
    return {"('MA', 'BU', 'AU')": "(" + ", ".join(f"'{x[:2]}'" for x in r.sample(SEGMENTS, 3)) + ")"}


def _discount(r: random.Random) -> dict[str, str]:
    d = r.randint(2, 9)
    return {"BETWEEN 0.05 - 0.000001 AND 0.07 + 0.000001": f"BETWEEN 0.{d - 1:02} - 0.000001 AND {(d + 1) / 100:.2f} + 0.000001"}


PARAMETERS: dict[str, tuple[Draw, ...]] = {
    "q01": (_number("INTERVAL '90' DAY", 60, 120),),
    "q02": (_number("p_size = 15", 1, 50), _choice("'%MO'", TYPES, "'%{}'"), _choice("'EUROPE'", REGIONS)),
    "q03": (_choice("'BUILDING'", SEGMENTS), lambda r: {"DATE '1998-03-15'": f"DATE '1998-03-{r.randint(1, 31):02}'"}),
    "q04": (_month("DATE '1997-07-01'"),),
    "q05": (_choice("'ASIA'", REGIONS), _year("DATE '1996-01-01'")),
    "q06": (_year("DATE '1996-01-01'", "DATE '1997-01-01'"), _discount, _number("l_quantity < 24", 24, 25)),
    "q07": (_nations("'NATION_1'", "'NATION_2'"),),
    "q08": (_nations("'NATION_3'"), _choice("'AMERICA'", REGIONS), _choice("'ECONOMY'", TYPES)),
    "q09": (_choice("'%bolt%'", NOUNS, "'%{}%'"),),
    "q10": (_month("DATE '1997-01-01'"),),
    "q11": (_nations("'NATION_4'"),),
    "q12": (_pair(("'A'", "'R'"), FLAGS), _year("DATE '1996-01-01'", "DATE '1997-01-01'")),
    "q13": (_choice("'%URGENT%'", ("URGENT", "HIGH", "MEDIUM", "LOW", "SPECIFIED"), "'%{}%'"), _month("DATE '1995-03-01'")),
    "q14": (_month("DATE '1996-09-01'"),),
    "q15": (_month("DATE '1996-01-01'"),),
    "q16": (_brand("'Brand#5'"), _choice("'MEDIUM%'", TYPES, "'{}%'"), _sizes),
    "q17": (_brand("'Brand#3'"), _choice("'MEDIUM'", TYPES)),
    "q18": (_number("sum(l_quantity) > 300", 312, 315),),
    "q19": (_brand("'Brand#1'"), _brand("'Brand#2'"), _brand("'Brand#3'"), lambda r: {f"l_quantity >= {a} AND l_quantity <= {a + 10}": f"l_quantity >= {q} AND l_quantity <= {q + 10}" for a, q in ((1, r.randint(1, 10)), (10, r.randint(10, 20)), (20, r.randint(20, 30)))}),
    "q20": (_choice("'small%'", COLOURS, "'{}%'"), _number("n_regionkey = 1", 0, 4)),
    "q21": (_choice("l1.l_returnflag = 'R'", FLAGS, "l1.l_returnflag = '{}'"),),
    "q22": (_codes,),
}


def text(name: str, seed: int) -> str:
    """The text of a query with the parameters of a seed."""
    r, sql = random.Random(f"{name} {seed}"), tpch.SQL[name]
    drawn: dict[str, str] = {}
    for draw in PARAMETERS[name]:
        drawn |= draw(r)
    # All at once, so that no drawn value is taken for another literal.
    for k, old in enumerate(drawn):
        if old not in sql:
            raise ValueError(f"{name} has no {old}")
        sql = sql.replace(old, f"\0{k}\0")
    for k, new in enumerate(drawn.values()):
        sql = sql.replace(f"\0{k}\0", new)
    return sql


#: The queries as another seed has them.
SEED = 7
QUERIES: dict[str, Query] = {f"{k}_seeded": query(text(k, SEED)) for k in tpch.SQL}
ORACLE_SQL = {f"{k}_seeded": plain(text(k, SEED)) for k in tpch.SQL}
