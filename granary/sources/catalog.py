"""Table definitions, and how tables are read.

A Catalog knows tables by name, each with a format and a location. Column
names and types are declared for delimited files; parquet has its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of the eight decision-support tables, in the order of their files.
SCHEMAS = {
    "region": "r_regionkey bigint, r_name string, r_comment string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey bigint, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey bigint, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size bigint, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty bigint, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority bigint, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}
#: Type names of table dictionaries, without length or precision. Decimals are computed as doubles.
TYPES = {
    "bigint": "bigint", "int64": "bigint", "int32": "bigint", "double": "double", "decimal": "double", "float": "float",
    "char": "string", "varchar": "string", "string": "string", "bool": "boolean", "boolean": "boolean", "date": "date", "date32": "date",
}


def spark_type(name: str) -> str:
    """The Spark type of a dictionary type such as varchar(25) or decimal(10,2)."""
    plain = name.split("(")[0].strip().lower()
    if plain not in TYPES:
        raise ValueError(f"the type {name} isn't known")
    return TYPES[plain]


@dataclass(frozen=True)
class TableDef:
    """A table: its name, format (parquet or csv), files and, for csv, its columns."""

    name: str
    format: str
    paths: tuple[str, ...]
    columns: str | None = None


class Catalog:
    """Tables by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, TableDef] = {}

    def add(self, table: TableDef) -> None:
        self.tables[table.name] = table

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the table {name} isn't in the catalog")
        t = self.tables[name]
        if t.format == "parquet":
            return self.spark.read.parquet(*t.paths)
        if t.format == "csv":
            return read_delimited(self.spark, t.paths, t.columns or SCHEMAS[name])
        raise ValueError(f"unknown data file type {t.format}")

    def show_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, name: str) -> list[tuple[str, str]]:
        """Columns and their types."""
        return self.table(name).dtypes

    def views(self) -> None:
        """Make every table a view of the session, for SQL."""
        for name in self.tables:
            self.table(name).createOrReplaceTempView(name)

    @classmethod
    def of_dictionary(cls, spark: SparkSession, entries: list[dict]) -> Catalog:
        """A catalog from dictionary entries: tableName, fileType, filePath or distributedFilePaths, columnNames, columnTypes."""
        out = cls(spark)
        for e in entries:
            paths = tuple(e.get("distributedFilePaths") or [e["filePath"]])
            columns = ", ".join(f"{n} {spark_type(t)}" for n, t in zip(e["columnNames"], e["columnTypes"], strict=True))
            out.add(TableDef(e["tableName"], e.get("fileType", "csv").lower(), paths, columns))
        return out


def read_delimited(spark: SparkSession, paths, columns: str, header: bool = True) -> DataFrame:
    """Files delimited by | with a delimiter after the last column too."""
    schema = T.StructType.fromDDL(columns)
    padded = T.StructType([*schema.fields, T.StructField("_after", T.StringType())])
    rows = spark.read.csv(list(paths), schema=padded, sep="|", header=header, enforceSchema=True, dateFormat="yyyy-MM-dd")
    return rows.select(*schema.names)


def write_delimited(df: DataFrame, path: str, files: int | None = None) -> None:
    """df as files that read_delimited reads; `files` partitions of them if given."""
    from pyspark.sql import functions as F

    rows = df.withColumn("_after", F.lit(""))
    (rows.repartition(files) if files else rows).write.csv(path, sep="|", header=True, emptyValue="")


#: Bytes that a task reads of a table, where that isn't left to the session.
SCAN_BYTES: dict[str, int] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines share: below spark.checkpoint.dir, or the warehouse."""
    import uuid

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder; partsupp, which there isn't, from lineitem."""
    if name == "partsupp":
        return partsupp(load(spark, sf_dir, "lineitem"))
    reader = spark.read
    if name in SCAN_BYTES:  # files are dealt out again; a reader's split size is the session's
        df = reader.parquet(f"{sf_dir}/{name}.parquet")
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(max(1, -(-size // SCAN_BYTES[name])))
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def set_scan_size(name: str, size: int | None) -> None:
    """Have tasks take about that many bytes of a table, for the queries that follow; None: as the session has it."""
    if size is None:
        SCAN_BYTES.pop(name, None)
    elif size <= 0:
        raise ValueError("a scan size is above 0")
    else:
        SCAN_BYTES[name] = size


def partsupp(lineitem: DataFrame) -> DataFrame:
    """Parts by supplier, with how often and how cheaply lines have them."""
    from pyspark.sql import functions as F

    return lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.count(F.lit(1)).alias("ps_availqty"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_supplycost")
    )


#: SQL of the derived table.
PARTSUPP = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(count(*) AS BIGINT) AS ps_availqty,
         min(l_extendedprice / l_quantity) AS ps_supplycost
  FROM lineitem GROUP BY 1, 2)"""


def views(spark: SparkSession, sf_dir: str, names=("region", "nation", "supplier", "customer", "part", "orders", "lineitem")) -> None:
    """Make tables of a data folder views of the session."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
