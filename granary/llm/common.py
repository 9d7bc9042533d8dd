"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of a batch that Spark hands to Python, but for a row that is longer; bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: A side is broadcast only when Spark's statistics give it at most this many bytes; files are compressed, so it may take some times more in memory.
BROADCAST_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small.

    Both hold for the session: plans run only after the operator has returned.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it isn't set, one in the warehouse is, which all machines share too."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts the lineage: later jobs survive lost executors without computing
    df again. The table goes when the session's Python process ends.
    narrow: rows of a few numbers are written by an eighth as many tasks as a shuffle has partitions.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables():
    """Tables that are materialized inside go at the end, but for those given to the function that this gives."""
    before, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_written[-1][1])
        return df

    yield keep
    mine = _written[before:]
    _written[before:] = [x for x in mine if x[1] in kept]
    _delete([x for x in mine if x[1] not in kept])


def forget_tables() -> None:
    """Delete what materialize() wrote; also runs at exit."""
    gone, _written[:] = list(_written), []
    _delete(gone)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in reversed(tables):
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; nothing is left to ask
            return


atexit.register(forget_tables)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A materialized table with a broadcast hint if its files are small enough, else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def let(value, body):
    """body(value), where value is computed once however often body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release() -> None:
    """Give memory that isn't used back to the machine: idle workers count in an executor's share."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches, at: int, rows: int, size: int):
    """Batches cut into pieces of so many rows at most; a piece ends where column `at` has that many bytes (list elements)."""
    for batch in batches:
        column = batch.column(at)
        lengths = pc.fill_null(pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pc.list_value_length(column), 0)
        total, begin = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = min(begin + rows, int(np.searchsorted(total, before + size)) + 1, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def map_arrow(df: DataFrame, run, added: str, keep: bool = True) -> DataFrame:
    """mapInArrow with df's columns (if kept) and then those in `added`.

    run yields record batches in that order; names don't matter, so that
    tables with odd or clashing names pass through.
    """
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(added)
    schema = StructType([*(df.schema.fields if keep else []), *extra.fields])
    names = [f"c{i}" for i in range(len(schema.fields))]
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def renamed(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)
        release()

    plain = StructType.fromJson(schema.jsonValue())
    for f, n in zip(plain.fields, names, strict=True):
        f.name = n
    plain.names = names
    out = inner.mapInArrow(renamed, plain)
    return out.toDF(*schema.names)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Batches of that many rows for the jobs run inside."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def same(a, b):
    """Equality that holds for two nulls."""
    return a.eqNullSafe(b)


def components(nodes: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """nodes (id) with the smallest id reachable by edges (a, b).

    Labels spread along edges and jump to their own label's label, so the
    rounds grow with the logarithm of a chain's length. Each round is a
    table in the shared folder. Edges' ends must be among the nodes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("u", "v"), "edges", narrow=True)
    # At first a row's label is the least of itself and its neighbours.
    now = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least("u", F.min("v")).alias("l"), F.lit(True).alias("moved")), "labels", narrow=True)
    while not now.where("moved").isEmpty():
        old = now.select("id", "l")
        near = both.join(old.toDF("v", "m"), "v").groupBy(F.col("u").alias("id")).agg(F.min("m").alias("m"))
        spread = old.join(near, "id").select("id", F.least("l", "m").alias("s"), F.col("l").alias("was"))
        jump = spread.join(old.toDF("s", "j"), "s").select("id", F.least("s", "j").alias("l"), "was")
        now = materialize(jump.select("id", "l", (F.col("l") != F.col("was")).alias("moved")), "labels", narrow=True)
    return nodes.select("id").join(now.select("id", "l"), "id", "left").select("id", F.coalesce("l", "id").alias(label))
