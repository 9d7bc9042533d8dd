"""Aggregate functions by name, with or without groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions by name; `count_all` takes no column.
AGGREGATES = {
    "count_all": lambda _=None: F.count(F.lit(1)),
    "count": F.count,
    "count_distinct": F.countDistinct,
    "distinct": lambda c: F.sort_array(F.collect_set(c)),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "min_max": lambda c: F.struct(F.min(c).alias("min"), F.max(c).alias("max")),
    "mean": F.avg,
    "all": F.bool_and,
    "any": F.bool_or,
    "approximate_median": lambda c: F.percentile_approx(c, 0.5, 10_000),
    "median": F.median,
}

#: How partial results of a function are put together.
MERGES = {"count_all": "sum", "count": "sum", "sum": "sum", "min": "min", "max": "max", "all": "all", "any": "any"}


def aggregate(name: str, column: Column | str | None = None) -> Column:
    """An aggregate by name; a hash_ in front (grouped form) is the same function."""
    plain = name.removeprefix("hash_")
    if plain not in AGGREGATES:
        raise ValueError(f"the aggregate {name} isn't known")
    return AGGREGATES[plain](column)
