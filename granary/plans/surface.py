"""The SQL surface: text in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.plans.registry import register
from granary.sources.catalog import views


def run_sql(spark: SparkSession, text: str, sf_dir: str | None = None) -> DataFrame:
    """The rows of one SQL statement. With a data folder, its tables are made views first.

    Errors of parsing and analysis are raised, as Spark words them.
    """
    if sf_dir is not None:
        views(spark, sf_dir)
    return spark.sql(text.rstrip().rstrip(";"))


def feedback(spark: SparkSession, text: str) -> list[str]:
    """What is wrong with a statement: one message, or none."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        run_sql(spark, text).schema  # noqa: B018
    except (AnalysisException, ParseException) as e:
        return [str(e)]
    return []


#: Statements whose text is the same for both engines.
STATEMENTS = {
    "comma_join": "SELECT count(l_shipdate) AS n, count(l_partkey) AS m FROM lineitem, nation WHERE l_suppkey = n_nationkey AND l_extendedprice + 1.3 > 3",
    "join_on": "SELECT count(*) AS n FROM supplier JOIN nation ON s_suppkey = n_nationkey",
    "nested_join": """SELECT l_suppkey, s_suppkey, CAST(sum(l_suppkey) AS BIGINT) AS total, round(sum(l_extendedprice), 2) AS price, count(s_suppkey) AS n
        FROM lineitem JOIN (nation JOIN supplier ON n_nationkey = s_nationkey) ON l_suppkey = s_suppkey
        WHERE s_acctbal + 1.2 > 10 GROUP BY l_suppkey, s_suppkey""",
    "nested_join_two_keys": """SELECT count(l_suppkey) AS n
        FROM lineitem JOIN (nation JOIN supplier ON n_nationkey = s_nationkey AND n_nationkey = s_nationkey) ON l_suppkey = s_suppkey
        WHERE s_suppkey + 1.2 > 10""",
    "or_filter_group": "SELECT l_partkey, count(l_partkey) AS n, count(l_orderkey) AS m FROM lineitem WHERE l_partkey + l_extendedprice > 3 OR l_partkey < 13 GROUP BY l_partkey",
    "three_conjuncts": "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 24 AND l_tax > 0.02 AND l_linenumber < 4",
    "alias": "SELECT n_name AS name, n_regionkey AS region FROM nation",
    "star": "SELECT * FROM region",
    "distinct": "SELECT DISTINCT o_orderstatus FROM orders",
    "count_distinct": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "left_join": "SELECT count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "using": "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders) JOIN (SELECT c_custkey AS k FROM customer) USING (k)",
    "natural_join": "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders) NATURAL JOIN (SELECT c_custkey AS k FROM customer)",
    "cross_join": "SELECT count(*) AS n FROM nation CROSS JOIN region",
    "subquery_from": "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15",
    "subquery_where": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "exists": "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_between_like": "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('SMALL', 'LARGE') AND p_name LIKE '%widget%'",
    "not_null": "SELECT count(*) AS n FROM part WHERE NOT p_size < 10 AND p_name IS NOT NULL",
    "case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part",
    "group_ordinal": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10",
    "union": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0",
    "with": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderpriority, count(*) AS n FROM big GROUP BY o_orderpriority",
    "values": "SELECT k * 2 AS twice FROM (VALUES (1), (2), (3)) AS v(k)",
    "modulus": "SELECT l_partkey % 7 AS k, count(*) AS n FROM lineitem GROUP BY l_partkey % 7",
    "distinct_from": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R'",
    "window": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS place FROM orders",
}

for _name, _text in STATEMENTS.items():
    register(f"sql_{_name}", lambda spark, sf_dir, t=_text: run_sql(spark, t, sf_dir), _text)
