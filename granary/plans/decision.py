"""The twelve decision-support queries, each in several physical forms.

Forms of a query give the same rows: plain leaves joins to the optimizer, hash
asks for shuffled hash joins, shuffle_stage partitions both sides by the
keys in stages of their own, merge sorts and merges, local deals the rows of
scans out evenly ahead of the plan, and single gathers the result into one
partition and sorts it there. Constants fit the data at hand, which lacks some columns of the
benchmark (README).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import scalar as s
from granary.operators import relational as r
from granary.plans.registry import register
from granary.sources.catalog import PARTSUPP, load, partsupp


@dataclass(frozen=True)
class Form:
    """How a plan's physical operators are asked for."""

    strategy: str = "auto"
    local: bool = False
    single: bool = False


FORMS = {
    "": Form(), "local": Form(local=True), "hash": Form("hash"), "merge": Form("merge"),
    "shuffle_stage": Form("shuffle_stage"), "single": Form(single=True),
}


class Tables:
    """A data folder's tables, and joins in the form asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, form: Form):
        self.spark, self.sf_dir, self.form = spark, sf_dir, form

    def __getattr__(self, name: str) -> DataFrame:
        df = load(self.spark, self.sf_dir, name)
        return r.repartition(df) if self.form.local and name in ("lineitem", "orders") else df

    def join(self, probe: DataFrame, build: DataFrame, *on, how: str = "inner", residual: Column | None = None) -> DataFrame:
        """Tables of nations and regions are always left to the optimizer."""
        small = any(str(pair[0] if isinstance(pair, str) else pair[1]).startswith(("n_", "r_")) for pair in on)
        return r.join(probe, build, list(on), how, "auto" if small else self.form.strategy, residual)

    def ordered(self, df: DataFrame, *keys) -> DataFrame:
        """Rows in order; the single form gathers them first."""
        return r.gather(df, *keys) if self.form.single else r.sort(df, *keys)

    def offers(self, parts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
        """partsupp of these parts and suppliers alone: lines are cut before they are put together, as both are its keys."""
        lines = self.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        if parts is not None:
            lines = self.join(lines, parts, ("l_partkey", "p_partkey"), how="left_semi")
        if suppliers is not None:
            lines = self.join(lines, suppliers, ("l_suppkey", "s_suppkey"), how="left_semi")
        return partsupp(lines)


def day(text: str) -> Column:
    return s.date_literal(text).cast("timestamp_ntz")


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def rounded(column: Column, digits: int = 4) -> Column:
    """Sums of doubles differ in their last bits by order of rows; digits beyond the data's own are cut."""
    return F.round(column, digits)


def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(F.col("l_shipdate") <= day("1998-09-02"))
    if t.form.strategy == "shuffle_stage":
        rows = r.repartition(rows, "l_returnflag", "l_linestatus", "l_orderkey")  # the flags alone would be a few partitions
    found = rows.groupBy("l_returnflag", "l_linestatus").agg(
        rounded(F.sum("l_quantity"), 2).alias("sum_qty"), rounded(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        rounded(F.sum(revenue())).alias("sum_disc_price"), rounded(F.sum(revenue() * (1 + F.col("l_tax"))), 6).alias("sum_charge"),
        rounded(F.avg("l_quantity")).alias("avg_qty"), rounded(F.avg("l_extendedprice")).alias("avg_price"), rounded(F.avg("l_discount")).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )
    return t.ordered(found, "l_returnflag", "l_linestatus")


Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL 90 DAY
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""


def _cheapest(t: Tables) -> DataFrame:
    region = t.region.filter(F.col("r_name") == "AMERICA")
    nation = t.join(t.nation, region, ("n_regionkey", "r_regionkey"))
    supplier = t.join(t.supplier, nation, ("s_nationkey", "n_nationkey"))
    part = t.part.filter((F.col("p_size") == 30) & F.col("p_type").like("%MEDIUM%")).select("p_partkey", "p_brand")
    offers = t.join(t.join(t.offers(part), part, ("ps_partkey", "p_partkey")), supplier, ("ps_suppkey", "s_suppkey"))
    least = F.min("ps_supplycost").over(Window.partitionBy("p_partkey"))
    best = offers.withColumn("least", least).filter(F.col("ps_supplycost") == F.col("least"))
    return best.select("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand")


CHEAPEST_ORDER = (("s_acctbal", "desc"), "n_name", "s_name", "p_partkey")


def minimum_cost_supplier(t: Tables) -> DataFrame:
    return t.ordered(_cheapest(t), *CHEAPEST_ORDER)


def minimum_cost_top(t: Tables) -> DataFrame:
    return r.top_k(_cheapest(t), 100, *CHEAPEST_ORDER)


Q2 = f"""WITH {PARTSUPP}
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 30 AND p_type LIKE '%MEDIUM%'
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA'
  AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region
    WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey"""


def shipping_priority(t: Tables) -> DataFrame:
    customer = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    orders = t.join(t.orders.filter(F.col("o_orderdate") < day("1995-03-21")), customer, ("o_custkey", "c_custkey"))
    rows = t.join(t.lineitem.filter(F.col("l_shipdate") > day("1995-01-21")), orders, ("l_orderkey", "o_orderkey"))
    return t.ordered(rows.groupBy("l_orderkey", "o_orderdate").agg(rounded(F.sum(revenue())).alias("revenue")), ("revenue", "desc"), "o_orderdate", "l_orderkey")


Q3 = """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1995-03-21' AND l_shipdate > DATE '1995-01-21'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey"""


def order_priority(t: Tables) -> DataFrame:
    orders = t.orders.filter((F.col("o_orderdate") >= day("1995-03-21")) & (F.col("o_orderdate") < F.add_months(s.date_literal("1995-09-21"), 3).cast("timestamp_ntz")))
    lines = t.lineitem.select("l_orderkey", "l_shipdate")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")
    found = t.join(orders, lines, ("o_orderkey", "l_orderkey"), how="left_semi", residual=late)
    return t.ordered(found.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")), "o_orderpriority")


Q4 = """SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1995-03-21' AND o_orderdate < DATE '1995-09-21' + INTERVAL 3 MONTH
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority"""


def local_supplier_volume(t: Tables) -> DataFrame:
    nation = t.join(t.nation, t.region.filter(F.col("r_name") == "AMERICA"), ("n_regionkey", "r_regionkey")).select("n_nationkey", "n_name")
    supplier = t.join(t.supplier, nation, ("s_nationkey", "n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    dated = (F.col("o_orderdate") >= day("1995-09-21")) & (F.col("o_orderdate") < F.add_months(s.date_literal("1995-09-21"), 12).cast("timestamp_ntz"))
    orders = t.join(t.orders.filter(dated).select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_nationkey"), ("o_custkey", "c_custkey"))
    rows = t.join(t.join(t.lineitem, orders, ("l_orderkey", "o_orderkey")), supplier, ("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey"))
    return t.ordered(rows.groupBy("n_name").agg(rounded(F.sum(revenue())).alias("revenue")), ("revenue", "desc"), "n_name")


Q5 = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'AMERICA' AND o_orderdate >= DATE '1995-09-21' AND o_orderdate < DATE '1995-09-21' + INTERVAL 1 YEAR
GROUP BY n_name ORDER BY revenue DESC, n_name"""


def forecast_revenue(t: Tables) -> DataFrame:
    dated = (F.col("l_shipdate") >= day("1995-09-21")) & (F.col("l_shipdate") < F.add_months(s.date_literal("1995-09-21"), 12).cast("timestamp_ntz"))
    rows = t.lineitem.filter(dated & F.col("l_discount").between(0.0, 0.02) & (F.col("l_quantity") < 24))
    return rows.agg(rounded(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("revenue"))


Q6 = """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1995-09-21' AND l_shipdate < DATE '1995-09-21' + INTERVAL 1 YEAR
  AND l_discount BETWEEN CAST(0.0 AS DOUBLE) AND CAST(0.02 AS DOUBLE) AND l_quantity < 24"""


def volume_shipping(t: Tables) -> DataFrame:
    pair = ("NATION_1", "NATION_2")
    own = t.nation.filter(F.col("n_name").isin(*pair))
    n1 = own.select(F.col("n_nationkey").alias("n_nationkey1"), F.col("n_name").alias("supp_nation"))
    n2 = own.select(F.col("n_nationkey").alias("n_nationkey2"), F.col("n_name").alias("cust_nation"))
    supplier = t.join(t.supplier, n1, ("s_nationkey", "n_nationkey1")).select("s_suppkey", "supp_nation")
    customer = t.join(t.customer, n2, ("c_nationkey", "n_nationkey2")).select("c_custkey", "cust_nation")
    lines = t.lineitem.filter(F.col("l_shipdate").between(day("1995-01-01"), day("1996-12-31")))
    rows = t.join(t.join(lines, supplier, ("l_suppkey", "s_suppkey")), t.join(t.orders, customer, ("o_custkey", "c_custkey")), ("l_orderkey", "o_orderkey"))
    rows = rows.filter(F.col("supp_nation") != F.col("cust_nation"))
    year = F.year("l_shipdate").cast("bigint").alias("l_year")
    return t.ordered(rows.groupBy("supp_nation", "cust_nation", year).agg(rounded(F.sum(revenue())).alias("revenue")), "supp_nation", "cust_nation", "l_year")


Q7 = """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year"""


def market_share(t: Tables) -> DataFrame:
    america = t.join(t.nation, t.region.filter(F.col("r_name") == "AMERICA"), ("n_regionkey", "r_regionkey")).select(F.col("n_nationkey").alias("n_home"))
    customer = t.join(t.customer, america, ("c_nationkey", "n_home")).select("c_custkey")
    nations = t.nation.select(F.col("n_nationkey").alias("n_of"), F.col("n_name").alias("nation"))
    supplier = t.join(t.supplier, nations, ("s_nationkey", "n_of")).select("s_suppkey", "nation")
    orders = t.join(t.orders.filter(F.col("o_orderdate").between(day("1995-01-01"), day("1996-12-31"))), customer, ("o_custkey", "c_custkey"))
    lines = t.join(t.lineitem, t.part.filter(F.col("p_type") == "LARGE").select("p_partkey"), ("l_partkey", "p_partkey"))
    rows = t.join(t.join(lines, orders, ("l_orderkey", "o_orderkey")), supplier, ("l_suppkey", "s_suppkey"))
    own = s.if_(F.col("nation") == "NATION_1", revenue(), F.lit(0.0))
    return t.ordered(rows.groupBy(F.year("o_orderdate").cast("bigint").alias("o_year")).agg(rounded(F.sum(own) / F.sum(revenue()), 8).alias("mkt_share")), "o_year")


Q8 = """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
    AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'LARGE') AS all_nations
GROUP BY o_year ORDER BY o_year"""


def product_profit(t: Tables) -> DataFrame:
    part = t.part.filter(F.col("p_name").like("%widget%")).select("p_partkey")
    lines = t.join(t.lineitem, part, ("l_partkey", "p_partkey"))
    offers = t.offers(part).select("ps_partkey", "ps_suppkey", "ps_supplycost")
    rows = t.join(lines, offers, ("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey"))
    supplier = t.join(t.supplier, t.nation, ("s_nationkey", "n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    rows = t.join(t.join(rows, t.orders.select("o_orderkey", "o_orderdate"), ("l_orderkey", "o_orderkey")), supplier, ("l_suppkey", "s_suppkey"))
    amount = revenue() - F.col("ps_supplycost") * F.col("l_quantity")
    year = F.year("o_orderdate").cast("bigint").alias("o_year")
    return t.ordered(rows.groupBy("nation", year).agg(rounded(F.sum(amount)).alias("sum_profit")), "nation", ("o_year", "desc"))


Q9 = f"""WITH {PARTSUPP}
SELECT nation, o_year, round(sum(amount), 4) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part, supplier, lineitem, partsupp, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
    AND s_nationkey = n_nationkey AND p_name LIKE '%widget%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC"""


def _returned(t: Tables) -> DataFrame:
    dated = (F.col("o_orderdate") >= day("1995-01-01")) & (F.col("o_orderdate") < F.add_months(s.date_literal("1996-12-31"), 3).cast("timestamp_ntz"))
    customer = t.join(t.customer, t.nation, ("c_nationkey", "n_nationkey"))
    orders = t.join(t.orders.filter(dated).select("o_orderkey", "o_custkey"), customer, ("o_custkey", "c_custkey"))
    rows = t.join(t.lineitem.filter(F.col("l_returnflag") == "R"), orders, ("l_orderkey", "o_orderkey"))
    return rows.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(rounded(F.sum(revenue())).alias("revenue"))


def returned_items(t: Tables) -> DataFrame:
    return t.ordered(_returned(t), ("revenue", "desc"), "c_custkey")


def returned_items_top(t: Tables) -> DataFrame:
    return r.top_k(_returned(t), 100, ("revenue", "desc"), "c_custkey")


Q10 = """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-12-31' + INTERVAL 3 MONTH
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey"""


def important_stock(t: Tables) -> DataFrame:
    supplier = t.join(t.supplier, t.nation.filter(F.col("n_name") == "NATION_1"), ("s_nationkey", "n_nationkey")).select("s_suppkey")
    each = t.offers(suppliers=supplier).groupBy("ps_partkey").agg(F.sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("value"))
    least = each.agg((F.sum("value") * 0.000001).alias("least"))  # one row
    found = r.cross_join(each, F.broadcast(least)).filter("value > least").select("ps_partkey", rounded(F.col("value")).alias("value"))
    return t.ordered(found, ("value", "desc"), "ps_partkey")


Q11 = f"""WITH {PARTSUPP}, offers AS (
  SELECT ps_partkey, ps_supplycost * ps_availqty AS worth FROM partsupp, supplier, nation
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_1')
SELECT ps_partkey, round(sum(worth), 4) AS value FROM offers GROUP BY ps_partkey
HAVING sum(worth) > (SELECT sum(worth) * 0.000001 FROM offers) ORDER BY value DESC, ps_partkey"""


def priority_lines(t: Tables) -> DataFrame:
    dated = (F.col("l_shipdate") >= day("1995-03-21")) & (F.col("l_shipdate") < F.add_months(s.date_literal("1995-09-21"), 12).cast("timestamp_ntz"))
    rows = t.join(t.lineitem.filter(F.col("l_returnflag").isin("R", "A") & dated), t.orders, ("l_orderkey", "o_orderkey"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    counts = rows.groupBy("l_returnflag").agg(F.sum(s.if_(urgent, 1, 0)).alias("high_line_count"), F.sum(s.if_(urgent, 0, 1)).alias("low_line_count"))
    return t.ordered(counts, "l_returnflag")


Q12 = """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('R', 'A')
  AND l_shipdate >= DATE '1995-03-21' AND l_shipdate < DATE '1995-09-21' + INTERVAL 1 YEAR
GROUP BY l_returnflag ORDER BY l_returnflag"""

JOINED = ("", "local", "hash", "merge", "shuffle_stage", "single")
PLANS = {
    "q1_pricing_summary": (pricing_summary, Q1, ("", "local", "single", "shuffle_stage")),
    "q2_minimum_cost_supplier": (minimum_cost_supplier, Q2, JOINED),
    "q2_minimum_cost_top100": (minimum_cost_top, f"SELECT * FROM ({Q2}) LIMIT 100", ("",)),
    "q3_shipping_priority": (shipping_priority, Q3, JOINED),
    "q4_order_priority": (order_priority, Q4, JOINED),
    "q5_local_supplier_volume": (local_supplier_volume, Q5, JOINED),
    "q6_forecast_revenue": (forecast_revenue, Q6, ("", "local", "single")),
    "q7_volume_shipping": (volume_shipping, Q7, JOINED),
    "q8_market_share": (market_share, Q8, JOINED),
    "q9_product_profit": (product_profit, Q9, JOINED),
    "q10_returned_items": (returned_items, Q10, JOINED),
    "q10_returned_items_top100": (returned_items_top, f"SELECT * FROM ({Q10}) LIMIT 100", ("",)),
    "q11_important_stock": (important_stock, Q11, JOINED),
    "q12_priority_lines": (priority_lines, Q12, JOINED),
}


def _builder(plan, form: Form):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(Tables(spark, sf_dir, form))

    return build


for _name, (_plan, _sql, _forms) in PLANS.items():
    for _form in _forms:
        register(f"{_name}_{_form}".rstrip("_"), _builder(_plan, FORMS[_form]), _sql)
