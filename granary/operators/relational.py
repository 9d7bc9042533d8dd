"""Operators of plans: scan, filter, project, joins, aggregation, sort, top-k, limit and exchange.

Each builds on DataFrame operations and leaves the physical form to
Catalyst; where a plan asks for one (a join's strategy, an exchange), it is a
hint or an explicit partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.aggregate import MERGES, aggregate

#: Join strategies: hints, or partitioning both sides by the keys ahead of the join.
STRATEGIES = {"auto": None, "broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge", "shuffle_stage": None, "probe_shuffle": None}
#: Bytes, by Spark's statistics, of a side that may be broadcast where a plan asks for it; above, the join shuffles.
BROADCAST_BYTES = 64 << 20


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def project(df: DataFrame, keep=(), rename=None, compute=None) -> DataFrame:
    """Columns kept as they are, renamed ({old: new}) and computed ({name: expression}); all others go."""
    return df.select(
        *[F.col(c) for c in keep], *[F.col(a).alias(b) for a, b in (rename or {}).items()], *[e.alias(n) for n, e in (compute or {}).items()]
    )


def _small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most that many bytes by the optimizer's statistics; nothing runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def join(probe: DataFrame, build: DataFrame, on: list[tuple[str, str]] | list[str], how: str = "inner", strategy: str = "auto", residual: Column | None = None) -> DataFrame:
    """Equi-join: columns of the probe side, then of the build side. Null keys match nothing.

    on: pairs of column names (probe, build), or common names. residual: a condition that pairs must meet besides. strategy:
    auto; broadcast (the build side is copied if it is small by its statistics, else the
    join shuffles); hash or merge (shuffled); shuffle_stage (both sides are
    partitioned by the keys in stages of their own); probe_shuffle (the probe side is).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy {strategy} isn't known")
    pairs = [(p, p) if isinstance(p, str) else p for p in on]
    if strategy in ("shuffle_stage", "probe_shuffle"):
        probe = probe.repartition(*[F.col(a) for a, _ in pairs])
        if strategy == "shuffle_stage":
            build = build.repartition(*[F.col(b) for _, b in pairs])
    hint = STRATEGIES[strategy]
    if hint == "broadcast" and not _small(build, BROADCAST_BYTES):
        hint = None
    if hint:
        build = build.hint(hint)
    keys = [probe[a] == build[b] for a, b in pairs]
    return probe.join(build, reduce(lambda x, y: x & y, keys if residual is None else [*keys, residual]), how)


def cross_join(probe: DataFrame, build: DataFrame, condition: Column | None = None) -> DataFrame:
    """All pairs, or those that a condition holds for."""
    return probe.crossJoin(build) if condition is None else probe.join(build, condition)


def group(df: DataFrame, keys=(), **aggregates) -> DataFrame:
    """Aggregates by keys, or of all rows: name=("sum", column), or name="count_all".

    Of no rows there are no groups; without keys there is one row even so.
    """
    columns = [aggregate(*([a] if isinstance(a, str) else a)).alias(n) for n, a in aggregates.items()]
    if not columns:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*columns)


def partial_group(df: DataFrame, keys=(), **aggregates) -> DataFrame:
    """Partial aggregates for each key and partition, which final_group puts together."""
    if bad := [a for a in aggregates.values() if (a if isinstance(a, str) else a[0]).removeprefix("hash_") not in MERGES]:
        raise ValueError(f"{bad} have no partial form")
    return group(df.withColumn("_part", F.spark_partition_id()), ["_part", *keys], **aggregates).drop("_part")


def final_group(df: DataFrame, keys=(), **aggregates) -> DataFrame:
    """Results from partial_group's rows; takes the same arguments."""
    merged = {n: (MERGES[(a if isinstance(a, str) else a[0]).removeprefix("hash_")], n) for n, a in aggregates.items()}
    return group(df, keys, **merged)


def _orders(keys) -> list[Column]:
    """Nulls come last in either direction."""
    out = []
    for key in keys:
        name, down = (key, False) if isinstance(key, str) else (key[0], key[1] == "desc")
        out.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    return out


def sort(df: DataFrame, *keys) -> DataFrame:
    """Rows in order of keys: names, or (name, "asc" or "desc")."""
    return df.orderBy(*_orders(keys))


def top_k(df: DataFrame, k: int, *keys) -> DataFrame:
    """The first k rows in order of keys."""
    return df.orderBy(*_orders(keys)).limit(k)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def gather(df: DataFrame, *keys) -> DataFrame:
    """One partition, in order of keys if there are any. For small results alone."""
    one = df.repartition(1)
    return one.sortWithinPartitions(*_orders(keys)) if keys else one


def repartition(df: DataFrame, *keys, parts: int | None = None) -> DataFrame:
    """Partitions by keys, or evenly by turns without keys."""
    return df.repartition(*([parts] if parts else []), *keys) if keys or parts else df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def replicate(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A copy for every task if df has at most that many bytes by its statistics, else df as it is."""
    return F.broadcast(df) if _small(df, limit) else df
