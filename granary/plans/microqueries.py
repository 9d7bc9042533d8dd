"""Join counts, and one query for each operator and function."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import scalar as s
from granary.operators import relational as r
from granary.plans.registry import register
from granary.sources import catalog, generator
from granary.sources.catalog import load


def query(name: str, sql: str | None = None):
    """Register a function of a table reader t(name)."""

    def add(f):
        register(name, lambda spark, sf_dir: f(lambda table: load(spark, sf_dir, table)), sql)
        return f

    return add


def counted(df):
    return r.group(df, n="count_all")


# Counts over joins, in each physical form.
ORDERS = "SELECT count(*) AS n FROM lineitem, orders WHERE l_orderkey = o_orderkey"
SUPPLIERS = "SELECT count(*) AS n FROM lineitem, supplier WHERE l_suppkey = s_suppkey"
for _form in ("auto", "broadcast", "hash", "merge", "shuffle_stage", "probe_shuffle"):
    register(
        f"join_lineitem_orders_{_form}",
        lambda spark, sf_dir, f=_form: counted(r.join(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"), [("l_orderkey", "o_orderkey")], strategy=f)),
        ORDERS,
    )
for _form in ("auto", "shuffle_stage", "probe_shuffle"):
    register(
        f"join_lineitem_supplier_{_form}",
        lambda spark, sf_dir, f=_form: counted(r.join(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier"), [("l_suppkey", "s_suppkey")], strategy=f)),
        SUPPLIERS,
    )


for _form in ("auto", "probe_shuffle"):
    for _below in (30, 50):
        register(
            f"join_lineitem_small_orders_{_below}_{_form}",
            lambda spark, sf_dir, f=_form, b=_below: counted(
                r.join(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders").filter(F.col("o_orderkey") < b), [("l_orderkey", "o_orderkey")], strategy=f)
            ),
            f"{ORDERS} AND o_orderkey < {_below}",
        )
    register(
        f"join_orders_small_customer_{_form}",
        lambda spark, sf_dir, f=_form: counted(
            r.join(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").filter("c_custkey < 50"), [("o_custkey", "c_custkey")], strategy=f)
        ),
        "SELECT count(*) AS n FROM orders, customer WHERE o_custkey = c_custkey AND c_custkey < 50",
    )


def _renamed(df, mark: str):
    return df.toDF(*[f"{c}{mark}" for c in df.columns])


@query("join_self_count", "SELECT count(*) AS n FROM supplier s1, supplier s2 WHERE s1.s_suppkey = s2.s_suppkey")
def _(t):
    return counted(r.join(t("supplier"), _renamed(t("supplier"), "2"), [("s_suppkey", "s_suppkey2")]))


@query("join_self_rows", "SELECT s1.s_suppkey, s1.s_nationkey, s2.s_suppkey AS s_suppkey2, s2.s_nationkey AS s_nationkey2 FROM supplier s1, supplier s2 WHERE s1.s_suppkey = s2.s_suppkey")
def _(t):
    return r.join(t("supplier"), _renamed(t("supplier"), "2"), [("s_suppkey", "s_suppkey2")]).select("s_suppkey", "s_nationkey", "s_suppkey2", "s_nationkey2")


@query("join_nation_keys", "SELECT s1.s_nationkey, count(*) AS n, CAST(sum(s1.s_suppkey * s2.s_suppkey) AS BIGINT) AS product FROM supplier s1, supplier s2 WHERE s1.s_nationkey = s2.s_nationkey GROUP BY ALL")
def _(t):
    """Pairs grow with the square of suppliers: they are counted, not listed."""
    rows = r.join(t("supplier"), _renamed(t("supplier"), "2"), [("s_nationkey", "s_nationkey2")])
    return r.group(rows.withColumn("product", F.col("s_suppkey") * F.col("s_suppkey2")), ["s_nationkey"], n="count_all", product=("sum", "product"))


@query("join_nation_keys_rows", "SELECT s1.s_suppkey, s1.s_nationkey, s2.s_suppkey AS s_suppkey2, s2.s_nationkey AS s_nationkey2 FROM supplier s1, supplier s2 WHERE s1.s_nationkey = s2.s_nationkey AND s1.s_suppkey < 5")
def _(t):
    few = t("supplier").filter("s_suppkey < 5")
    return r.join(few, _renamed(t("supplier"), "2"), [("s_nationkey", "s_nationkey2")]).select("s_suppkey", "s_nationkey", "s_suppkey2", "s_nationkey2")


@query("join_two_keys", "SELECT count(*) AS n FROM lineitem a, (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem GROUP BY 1, 2) WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def _(t):
    return counted(r.join(t("lineitem"), t("partsupp"), [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")]))


@query("join_residual", "SELECT count(*) AS n FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4")
def _(t):
    return counted(r.join(t("lineitem"), t("orders"), [("l_orderkey", "o_orderkey")]).filter("l_extendedprice > o_totalprice / 4"))


for _how, _sql in (
    ("left", "SELECT count(*) AS n, count(o_orderkey) AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    ("right", "SELECT count(*) AS n, count(o_orderkey) AS matched FROM customer RIGHT JOIN orders ON c_custkey = o_custkey"),
    ("full", "SELECT count(*) AS n, count(o_orderkey) AS matched FROM customer FULL JOIN orders ON c_custkey = o_custkey"),
):
    register(
        f"join_{_how}_outer",
        lambda spark, sf_dir, h=_how: r.group(r.join(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], h), n="count_all", matched=("count", "o_orderkey")),
        _sql,
    )


@query("join_semi", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return counted(r.join(t("customer"), t("orders"), [("c_custkey", "o_custkey")], "left_semi"))


@query("join_anti", "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return counted(r.join(t("customer"), t("orders"), [("c_custkey", "o_custkey")], "left_anti"))


@query("cross_join", "SELECT n_name, r_name FROM nation, region")
def _(t):
    return r.cross_join(t("nation"), t("region")).select("n_name", "r_name")


@query("cross_join_filter", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey")
def _(t):
    nation, region = t("nation"), t("region")
    return r.cross_join(nation, region, nation.n_regionkey < region.r_regionkey).select("n_name", "r_name")


# Scans, filters and projections.
@query("scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return t("nation")


@query("filter_numeric", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 8888.0")
def _(t):
    return r.filter_rows(t("supplier"), F.col("s_acctbal") > 8888.0).select("s_suppkey", "s_acctbal")


@query("filter_and_or", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_partkey > 100 AND l_tax > 0.05 OR l_partkey < 13")
def _(t):
    kept = s.any_of(s.all_of(F.col("l_quantity") < 5, F.col("l_partkey") > 100, F.col("l_tax") > 0.05), F.col("l_partkey") < 13)
    return r.filter_rows(t("lineitem"), kept).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "project_keep_rename_compute",
    "SELECT s_acctbal, s_suppkey AS suppkey, s_suppkey * 123 AS times, s_name || '_x' AS marked, s_suppkey * s_nationkey AS product, s_suppkey - s_nationkey AS difference FROM supplier",
)
def _(t):
    c = F.col
    return r.project(
        t("supplier"), keep=["s_acctbal"], rename={"s_suppkey": "suppkey"},
        compute={"times": c("s_suppkey") * 123, "marked": s.call("concat", c("s_name"), F.lit("_x")), "product": c("s_suppkey") * c("s_nationkey"), "difference": c("s_suppkey") - c("s_nationkey")},
    )


# Scalar functions: (name, table, key columns, expression, SQL).
def _scalar(name, table, keys, expression, sql):
    register(f"fn_{name}", lambda spark, sf_dir: load(spark, sf_dir, table).select(*keys, expression().alias("x")), f"SELECT {', '.join(keys)}, {sql} AS x FROM {table}")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_c = F.col
for _name, _expression, _sql in (
    ("add_bigint", lambda: s.call("add", _c("l_partkey"), _c("l_suppkey")), "l_partkey + l_suppkey"),
    ("add_double", lambda: s.call("add", _c("l_extendedprice"), F.lit(1.3)), "l_extendedprice + CAST(1.3 AS DOUBLE)"),
    ("subtract", lambda: s.call("subtract", _c("l_partkey"), _c("l_suppkey")), "l_partkey - l_suppkey"),
    ("multiply", lambda: s.call("multiply", _c("l_quantity"), _c("l_extendedprice")), "l_quantity * l_extendedprice"),
    ("divide_double", lambda: s.call("divide", _c("l_extendedprice"), _c("l_quantity")), "l_extendedprice / l_quantity"),
    ("divide_bigint", lambda: s.call("int_div", _c("l_partkey"), _c("l_suppkey") + 1), "l_partkey // (l_suppkey + 1)"),
    ("divide_large", lambda: s.call("int_div", _c("l_partkey") + F.lit(9007199254740992), _c("l_linenumber")), "(l_partkey + 9007199254740992) // l_linenumber"),
    ("divide_negative", lambda: s.call("int_div", -_c("l_partkey"), F.lit(7)), "(-l_partkey) // 7"),
    ("mod", lambda: s.call("mod", _c("l_partkey"), F.lit(7)), "l_partkey % 7"),
    ("mixed_types", lambda: s.call("add", _c("l_partkey"), _c("l_extendedprice")), "l_partkey + l_extendedprice"),
    ("equal", lambda: s.call("equal", _c("l_linenumber"), F.lit(3)), "l_linenumber = 3"),
    ("not_equal", lambda: s.call("not_equal", _c("l_linenumber"), F.lit(3)), "l_linenumber <> 3"),
    ("less_than", lambda: s.call("less_than", _c("l_quantity"), F.lit(24.0)), "l_quantity < 24"),
    ("less_or_equal", lambda: s.call("less_than_or_equal_to", _c("l_quantity"), F.lit(24.0)), "l_quantity <= 24"),
    ("greater_than", lambda: s.call("greater_than", _c("l_quantity"), F.lit(24.0)), "l_quantity > 24"),
    ("greater_or_equal", lambda: s.call("greater_than_or_equal_to", _c("l_quantity"), F.lit(24.0)), "l_quantity >= 24"),
    ("is_distinct_from", lambda: s.call("is_distinct_from", _c("l_returnflag"), F.lit("R")), "l_returnflag IS DISTINCT FROM 'R'"),
    ("and", lambda: s.call("and", _c("l_quantity") < 24, _c("l_tax") > 0.02, _c("l_linenumber") < 4), "l_quantity < 24 AND l_tax > 0.02 AND l_linenumber < 4"),
    ("or", lambda: s.call("or", _c("l_quantity") < 4, _c("l_tax") > 0.06, _c("l_linenumber") < 2), "l_quantity < 4 OR l_tax > 0.06 OR l_linenumber < 2"),
    ("not", lambda: s.call("not", _c("l_quantity") < 24), "NOT l_quantity < 24"),
    ("if", lambda: s.call("if", _c("l_returnflag") == "R", 1, 0), "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"),
    ("case", lambda: s.case((_c("l_quantity") < 10, "small"), (_c("l_quantity") < 30, "medium"), otherwise="large"), "CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END"),
    ("in_bigint", lambda: s.call("in", _c("l_linenumber"), 1, 3, 5), "l_linenumber IN (1, 3, 5)"),
    ("in_double", lambda: s.call("in", _c("l_quantity"), 1.0, 2.0), "l_quantity IN (1.0, 2.0)"),
    ("in_string", lambda: s.call("in", _c("l_returnflag"), "R", "A"), "l_returnflag IN ('R', 'A')"),
    ("between", lambda: s.call("between", _c("l_discount"), 0.02, 0.05), "l_discount BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.05 AS DOUBLE)"),
    ("is_null", lambda: s.call("is_null", _c("l_returnflag")), "l_returnflag IS NULL"),
    ("concat", lambda: s.call("concat", _c("l_returnflag"), _c("l_linestatus")), "l_returnflag || l_linestatus"),
    ("cast_bigint", lambda: s.call("castBIGINT", _c("l_extendedprice")), "CAST(trunc(l_extendedprice) AS BIGINT)"),
    ("cast_double", lambda: s.call("castFLOAT8", _c("l_partkey")), "CAST(l_partkey AS DOUBLE)"),
    ("cast_boolean_bigint", lambda: s.call("castBIGINT", _c("l_quantity") < 24), "CAST(l_quantity < 24 AS BIGINT)"),
    ("cast_boolean_double", lambda: s.call("castFLOAT8", _c("l_quantity") < 24), "CAST(l_quantity < 24 AS DOUBLE)"),
    ("cast_date", lambda: s.call("castDATE", _c("l_shipdate")).cast("string"), "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"),
    ("date_literal", lambda: s.call("castDATE", _c("l_shipdate")) < s.date_literal("1998-09-02 00:00:00"), "CAST(l_shipdate AS DATE) < DATE '1998-09-02'"),
    ("add_months", lambda: s.call("timestampaddMonth", s.call("castDATE", _c("l_shipdate")), 1).cast("string"), "CAST(CAST(CAST(l_shipdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR)"),
    ("add_years", lambda: s.call("timestampaddYear", s.call("castDATE", _c("l_shipdate")), 1).cast("string"), "CAST(CAST(CAST(l_shipdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS VARCHAR)"),
    ("add_days", lambda: s.call("timestampaddDay", s.call("castDATE", _c("l_shipdate")), 90).cast("string"), "CAST(CAST(CAST(l_shipdate AS DATE) + INTERVAL 90 DAY AS DATE) AS VARCHAR)"),
    ("extract_year", lambda: s.call("extract_year", _c("l_shipdate")).cast("bigint"), "CAST(extract(year FROM l_shipdate) AS BIGINT)"),
):
    _scalar(_name, "lineitem", _LINE, _expression, _sql)
_scalar("like", "part", ["p_partkey"], lambda: s.call("like", _c("p_type"), "%MEDIUM%"), "p_type LIKE '%MEDIUM%'")
_scalar("like_one", "part", ["p_partkey"], lambda: s.call("like", _c("p_brand"), "Brand#_"), "p_brand LIKE 'Brand#_'")
_scalar("in_date", "orders", ["o_orderkey"], lambda: s.call("in", s.call("castDATE", _c("o_orderdate")), s.date_literal("1995-03-21"), s.date_literal("1996-01-01")), "CAST(o_orderdate AS DATE) IN (DATE '1995-03-21', DATE '1996-01-01')")


# Aggregates by name, global and grouped.
_AGGREGATES = {
    "count_all": ("count_all", "count(*)"),
    "count": (("count", "l_shipdate"), "count(l_shipdate)"),
    "count_distinct": (("count_distinct", "l_suppkey"), "count(DISTINCT l_suppkey)"),
    "sum_bigint": (("sum", "l_partkey"), "CAST(sum(l_partkey) AS BIGINT)"),
    "sum_double": (("sum", "l_quantity"), "sum(l_quantity)"),
    "min": (("min", "l_extendedprice"), "min(l_extendedprice)"),
    "max": (("max", "l_extendedprice"), "max(l_extendedprice)"),
    "min_string": (("min", "l_linestatus"), "min(l_linestatus)"),
    "max_date": (("max", "l_shipdate"), "max(l_shipdate)"),
    "mean": (("mean", "l_quantity"), "avg(l_quantity)"),
    "all": (("all", lambda: _c("l_quantity") > 0), "bool_and(l_quantity > 0)"),
    "any": (("any", lambda: _c("l_quantity") > 49), "bool_or(l_quantity > 49)"),
    "median": (("median", "l_quantity"), "median(l_quantity)"),
    "approximate_median": (("approximate_median", "l_extendedprice"), None),
}


def _made(a):
    """An aggregate whose column may be an expression, which only a running session can make."""
    return a if isinstance(a, str) or isinstance(a[1], str) else (a[0], a[1]())


for _name, (_a, _sql) in _AGGREGATES.items():
    register(f"agg_{_name}", lambda spark, sf_dir, a=_a: r.group(load(spark, sf_dir, "lineitem"), x=_made(a)), _sql and f"SELECT {_sql} AS x FROM lineitem")
    _b = f"hash_{_a}" if isinstance(_a, str) else (f"hash_{_a[0]}", _a[1])
    register(
        f"agg_hash_{_name}",
        lambda spark, sf_dir, a=_b: r.group(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], x=_made(a)),
        _sql and f"SELECT l_returnflag, l_linestatus, {_sql} AS x FROM lineitem GROUP BY ALL",
    )


@query("agg_min_max", "SELECT min(l_tax) AS low, max(l_tax) AS high FROM lineitem")
def _(t):
    return r.group(t("lineitem"), x=("min_max", "l_tax")).select(F.col("x.min").alias("low"), F.col("x.max").alias("high"))


@query("agg_distinct", "SELECT count(DISTINCT l_linenumber) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS total FROM lineitem")
def _(t):
    found = r.group(t("lineitem"), x=("distinct", "l_linenumber"))
    return found.select(F.size("x").cast("bigint").alias("n"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


def _near_middle(t, keys):
    """Whether the approximate median's rank is within a thousandth of the middle."""
    rows = t("lineitem")
    found = r.group(rows, keys, m=("approximate_median", "l_extendedprice"))
    both = rows.join(F.broadcast(found), keys) if keys else r.cross_join(rows, F.broadcast(found))  # one row for each group
    rank = r.group(both.withColumns({"below": (F.col("l_extendedprice") < F.col("m")).cast("int"), "upto": (F.col("l_extendedprice") <= F.col("m")).cast("int")}), keys, low=("mean", "below"), high=("mean", "upto"))
    return rank.select(*keys, ((F.col("low") <= 0.501) & (F.col("high") >= 0.499)).alias("near"))


@query("agg_approximate_median_rank", "SELECT true AS near")
def _(t):
    return _near_middle(t, [])


@query("agg_hash_approximate_median_rank", "SELECT DISTINCT l_returnflag, l_linestatus, true AS near FROM lineitem")
def _(t):
    return _near_middle(t, ["l_returnflag", "l_linestatus"])


@query("agg_hash_min_max", "SELECT l_returnflag, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL")
def _(t):
    return r.group(t("lineitem"), ["l_returnflag"], x=("hash_min_max", "l_tax")).select("l_returnflag", F.col("x.min").alias("low"), F.col("x.max").alias("high"))


@query("agg_hash_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_suppkey) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def _(t):
    found = r.group(t("lineitem"), ["l_returnflag"], x=("hash_distinct", "l_suppkey"))
    return found.select("l_returnflag", F.size("x").cast("bigint").alias("n"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


@query("agg_many_keys", "SELECT l_suppkey, s_suppkey, CAST(sum(l_suppkey) AS BIGINT) AS total, round(sum(l_extendedprice), 2) AS price, count(s_suppkey) AS n FROM lineitem, supplier WHERE l_suppkey = s_suppkey GROUP BY l_suppkey, s_suppkey")
def _(t):
    rows = r.join(t("lineitem"), t("supplier"), [("l_suppkey", "s_suppkey")])
    found = r.group(rows, ["l_suppkey", "s_suppkey"], total=("sum", "l_suppkey"), price=("sum", "l_extendedprice"), n=("count", "s_suppkey"))
    return found.withColumn("price", F.round("price", 2))


@query("agg_partial_final", "SELECT l_suppkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total, min(l_tax) AS low FROM lineitem GROUP BY l_suppkey")
def _(t):
    wanted = {"n": "count_all", "total": ("sum", "l_partkey"), "low": ("min", "l_tax")}
    return r.final_group(r.partial_group(t("lineitem"), ["l_suppkey"], **wanted), ["l_suppkey"], **wanted)


@query("agg_empty_global", "SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_quantity < 0")
def _(t):
    return r.group(t("lineitem").filter("l_quantity < 0"), n="count_all", total=("sum", "l_quantity"))


@query("agg_empty_grouped", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY ALL")
def _(t):
    return r.group(t("lineitem").filter("l_quantity < 0"), ["l_returnflag"], n="count_all")


@query("distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return r.group(t("lineitem"), ["l_returnflag", "l_linestatus"])


# Order, limits and exchanges.
@query("sort", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey")
def _(t):
    return r.sort(t("supplier"), ("s_nationkey", "desc"), "s_suppkey").select("s_suppkey", "s_nationkey")


@query("top_k", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def _(t):
    return r.top_k(t("supplier"), 10, ("s_acctbal", "desc"), "s_suppkey").select("s_suppkey", "s_acctbal")


@query("limit", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 100)")
def _(t):
    return counted(r.limit(t("lineitem"), 100))


@query("limit_more_than_all", "SELECT n_nationkey FROM nation LIMIT 1000")
def _(t):
    return r.limit(t("nation"), 1000).select("n_nationkey")


@query("exchange_gather", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return r.gather(t("nation")).select("n_nationkey", "n_name")


@query("exchange_repartition", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return r.group(r.repartition(t("orders"), "o_custkey"), ["o_custkey"], n="count_all")


@query("exchange_round_robin", "SELECT count(*) AS n FROM orders")
def _(t):
    return counted(r.repartition(t("orders"), parts=7))


@query("exchange_replicate", "SELECT n_name, count(*) AS n FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    return r.group(t("supplier").join(r.replicate(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")), ["n_name"], n="count_all")


@query("union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def _(t):
    return t("supplier").select(F.col("s_nationkey").alias("k")).union(t("customer").select("c_nationkey"))


@query("partsupp_derived", "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("partsupp")


# Sources: files, dictionaries and the generator.
def _written(spark, sf_dir, table, files=None):
    """A table written as delimited files, and the folder."""
    where = catalog.scratch(spark)
    catalog.write_delimited(load(spark, sf_dir, table), where, files)
    return where


def _delimited(spark, sf_dir):
    where = _written(spark, sf_dir, "supplier", 3)
    return catalog.read_delimited(spark, [where], "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double")


def _dictionary(spark, sf_dir):
    entry = {"tableName": "own", "fileType": "CSV", "distributedFilePaths": [_written(spark, sf_dir, "region")], "columnNames": ["k", "name"], "columnTypes": ["bigint(20)", "char(25)"]}
    return catalog.Catalog.of_dictionary(spark, [entry]).table("own")


register("source_delimited", _delimited, "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
register("source_dictionary", _dictionary, "SELECT r_regionkey AS k, r_name AS name FROM region")
register(
    "source_generated_nations",
    lambda spark, sf_dir: generator.generate(spark, "nation").join(generator.generate(spark, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"),
    "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', '{generator.REGIONS[k]}')" for i, (n, k) in enumerate(generator.NATIONS)) + ") AS v(n_nationkey, n_name, r_name)",
)
register(
    "source_generated_lines",
    lambda spark, sf_dir: r.group(
        r.join(generator.generate(spark, "lineitem", 0.01, parts=5), generator.generate(spark, "orders", 0.01), [("l_orderkey", "o_orderkey")]).filter("l_shipdate > o_orderdate"),
        ["l_linenumber"], n="count_all", orders=("count_distinct", "l_orderkey"),
    ),
    # 15,000 orders less the last ones, whose lines go beyond 60,000: seven orders have from one to seven lines.
    "WITH o AS (SELECT range AS k, [4, 1, 6, 3, 7, 2, 5][range % 7 + 1] AS n FROM range(15000)), l AS (SELECT k, unnest(range(1, n + 1)) AS line FROM o), "
    "f AS (SELECT *, row_number() OVER (ORDER BY k, line) AS place FROM l) SELECT line AS l_linenumber, count(*) AS n, count(DISTINCT k) AS orders FROM f WHERE place <= 60000 GROUP BY ALL",
)
for _table, _key in (("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
    register(
        f"source_generated_{_table}",
        lambda spark, sf_dir, t=_table, k=_key: r.group(generator.generate(spark, t, 0.01), n="count_all", low=("min", k), high=("max", k)),
        f"SELECT {generator.rows_of(_table, 0.01)}::BIGINT AS n, 1::BIGINT AS low, {generator.rows_of(_table, 0.01)}::BIGINT AS high",
    )
