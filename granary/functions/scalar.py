"""Scalar functions by name, as column expressions."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient of integers, cut towards zero; division by zero gives an error."""
    return F.call_function("div", a, b)


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)


def if_(condition: Column, then, otherwise) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def case(*branches: tuple[Column, object], otherwise=None) -> Column:
    """The value of the first branch that holds."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def date_literal(text: str) -> Column:
    """A date, from yyyy-mm-dd with or without a time; no time zone matters."""
    return F.lit(datetime.date.fromisoformat(text[:10]))


def to_bigint(a: Column) -> Column:
    """Cut towards zero."""
    return a.cast("bigint")


#: Functions by name.
FUNCTIONS = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: a / b,
    "int_div": int_div,
    "mod": lambda a, b: a % b,
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less_than": lambda a, b: a < b,
    "less_than_or_equal_to": lambda a, b: a <= b,
    "greater_than": lambda a, b: a > b,
    "greater_than_or_equal_to": lambda a, b: a >= b,
    "is_distinct_from": lambda a, b: ~a.eqNullSafe(b),
    "and": all_of,
    "or": any_of,
    "not": lambda a: ~a,
    "if": if_,
    "in": lambda a, *values: a.isin(*values),
    "between": lambda a, low, high: a.between(low, high),
    "like": lambda a, pattern: a.like(pattern),
    "is_null": lambda a: a.isNull(),
    "concat": F.concat,
    "castBIGINT": to_bigint,
    "castFLOAT8": lambda a: a.cast("double"),
    "castDATE": lambda a: a.cast("date"),
    "timestampaddYear": lambda a, n: F.add_months(a, 12 * n),
    "timestampaddMonth": lambda a, n: F.add_months(a, n),
    "timestampaddDay": lambda a, n: F.date_add(a, n),
    "extract_year": lambda a: F.year(a),
    "extract_month": lambda a: F.month(a),
    "extract_day": lambda a: F.day(a),
}


def call(name: str, *args) -> Column:
    """A function's value by its name."""
    if name not in FUNCTIONS:
        raise ValueError(f"the function {name} isn't known")
    return FUNCTIONS[name](*args)
