"""Rows on the fly: the eight tables at a scale factor, as expressions over row numbers.

Cardinalities, keys and value ranges follow the benchmark's tables; texts
and random values are this module's own. A range of rows gives the same
rows however it is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the benchmark's small domains.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = (
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3),
    ("INDIA", 2), ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0), ("MOZAMBIQUE", 0),
    ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")
SIZES_OF_TYPE = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
# Parts of the names of containers.
CONTAINERS = tuple(f"{a} {b}" for a in ("SM", "LG", "MED", "JUMBO", "WRAP") for b in ("CASE", "BOX", "BAG", "JAR", "PKG", "PACK", "CAN", "DRUM"))
#: Lines of seven orders that follow each other, from one to seven: four to an order in the mean.
LINES = (4, 1, 6, 3, 7, 2, 5)
#: Rows at scale factor 1.
ROWS = {"supplier": 10_000, "customer": 150_000, "part": 200_000, "partsupp": 800_000, "orders": 1_500_000, "lineitem": 6_000_000}


def _pick(names, salt: str):
    return F.get(F.array(*map(F.lit, names)), _number(salt, len(names)).cast("int"))


def _number(salt: str, below: int):
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(below))


def _money(salt: str, low: int, high: int):
    """Whole cents from low to high."""
    return (_number(salt, high - low) + low) / 100.0


def rows_of(table: str, scale: float) -> int:
    return {"region": 5, "nation": 25}.get(table) or max(1, int(ROWS[table] * scale))


def generate(spark: SparkSession, table: str, scale: float = 1.0, offset: int = 0, rows: int | None = None, parts: int | None = None) -> DataFrame:
    """Rows of a table from an offset on; all of them if no number is given."""
    most = rows_of(table, scale)
    end = most if rows is None else min(most, offset + rows)
    ids = spark.range(min(offset, end), end, 1, parts) if parts else spark.range(min(offset, end), end)
    comment = F.concat(F.lit("comment "), F.hex(F.xxhash64("id"))).alias
    if table == "region":
        return ids.select(F.col("id").alias("r_regionkey"), F.get(F.array(*map(F.lit, REGIONS)), F.col("id").cast("int")).alias("r_name"), comment("r_comment"))
    if table == "nation":
        names, regions = F.array(*[F.lit(n) for n, _ in NATIONS]), F.array(*[F.lit(r) for _, r in NATIONS])
        at = F.col("id").cast("int")
        return ids.select(F.col("id").alias("n_nationkey"), F.get(names, at).alias("n_name"), F.get(regions, at).cast("bigint").alias("n_regionkey"), comment("n_comment"))
    key = F.col("id") + 1
    if table in ("supplier", "customer"):
        c = table[0]
        name = F.format_string(f"{table.capitalize()}#%09d", key)
        own = [
            key.alias(f"{c}_{'supp' if c == 's' else 'cust'}key"), name.alias(f"{c}_name"), F.sha1(F.col("id").cast("string")).alias(f"{c}_address"),
            _number("nation", 25).alias(f"{c}_nationkey"), F.format_string("%02d-%07d", _number("nation", 25) + 10, _number("phone", 10_000_000)).alias(f"{c}_phone"),
            _money("balance", -99_999, 1_000_000).alias(f"{c}_acctbal"),
        ]
        return ids.select(*own, *([_pick(SEGMENTS, "segment").alias("c_mktsegment")] if c == "c" else []), comment(f"{c}_comment"))
    suppliers, parts_, customers = rows_of("supplier", scale), rows_of("part", scale), rows_of("customer", scale)
    if table == "part":
        maker = _number("maker", 5) + 1
        return ids.select(
            key.alias("p_partkey"), F.concat_ws(" ", F.lit("part"), key).alias("p_name"), F.format_string("Manufacturer#%d", maker).alias("p_mfgr"),
            F.format_string("Brand#%d%d", maker, _number("brand", 5) + 1).alias("p_brand"), _pick(SIZES_OF_TYPE, "type").alias("p_type"),
            (_number("size", 50) + 1).alias("p_size"), _pick(CONTAINERS, "container").alias("p_container"), (90_000 + F.pmod(key, F.lit(1000)) * 100) .cast("double").alias("p_retailprice"), comment("p_comment"),
        ).withColumn("p_retailprice", F.col("p_retailprice") / 100)
    if table == "partsupp":
        return ids.select(
            (F.expr("id div 4") + 1).alias("ps_partkey"), (F.pmod(F.expr("id div 4") + F.pmod(F.col("id"), F.lit(4)) * (suppliers // 4 + 1), F.lit(suppliers)) + 1).alias("ps_suppkey"),
            (_number("qty", 9999) + 1).alias("ps_availqty"), _money("cost", 100, 100_001).alias("ps_supplycost"), comment("ps_comment"),
        )
    at = F.pmod(F.col("id"), F.lit(sum(LINES))).cast("int")
    turn = F.get(F.array(*[F.lit(k) for k, n in enumerate(LINES) for _ in range(n)]), at)
    line = F.get(F.array(*[F.lit(i + 1) for n in LINES for i in range(n)]), at).cast("bigint")
    order = F.col("id") if table == "orders" else F.expr(f"id div {sum(LINES)}") * len(LINES) + turn
    day = F.date_add(F.lit("1992-01-01").cast("date"), F.pmod(F.xxhash64(order, F.lit("day")), F.lit(2406)).cast("int"))
    if table == "orders":
        return ids.select(
            key.alias("o_orderkey"), (_number("customer", customers) + 1).alias("o_custkey"), _pick(("F", "O", "P"), "status").alias("o_orderstatus"),
            _money("total", 100_000, 50_000_000).alias("o_totalprice"), day.alias("o_orderdate"), _pick(PRIORITIES, "priority").alias("o_orderpriority"),
            F.format_string("Clerk#%09d", _number("clerk", 1000) + 1).alias("o_clerk"), F.lit(0).cast("bigint").alias("o_shippriority"), comment("o_comment"),
        )
    if table == "lineitem":
        ship = F.date_add(day, (_number("ship", 121) + 1).cast("int"))
        return ids.select(
            (order + 1).alias("l_orderkey"), (_number("part", parts_) + 1).alias("l_partkey"), (_number("supplier", suppliers) + 1).alias("l_suppkey"),
            line.alias("l_linenumber"), (_number("quantity", 50) + 1).cast("double").alias("l_quantity"),
            _money("price", 90_000, 10_000_000).alias("l_extendedprice"), (_number("discount", 11) / 100.0).alias("l_discount"), (_number("tax", 9) / 100.0).alias("l_tax"),
            _pick(("R", "A", "N"), "flag").alias("l_returnflag"), _pick(("O", "F"), "line").alias("l_linestatus"), ship.alias("l_shipdate"),
            F.date_add(day, (_number("commit", 61) + 30).cast("int")).alias("l_commitdate"), F.date_add(ship, (_number("receipt", 30) + 1).cast("int")).alias("l_receiptdate"),
            _pick(INSTRUCTIONS, "instruct").alias("l_shipinstruct"), _pick(MODES, "mode").alias("l_shipmode"), comment("l_comment"),
        )
    raise ValueError(f"the table {table} isn't known")
