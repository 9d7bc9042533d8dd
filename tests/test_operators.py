"""Operators on small tables: duplicates, nulls, empties, ties."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from granary.functions import scalar as s
from granary.operators import relational as r
from granary.plans import surface, tuning
from granary.plans.handles import FINISHED, QueryManager, draw
from granary.plans.script import Runner, ScriptError, parse
from granary.sources import catalog, generator


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def probe(spark):
    return spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "a int")


@pytest.fixture(scope="module")
def build(spark):
    return spark.createDataFrame([(2,), (2,), (3,), (4,), (None,)], "b int")


@pytest.mark.parametrize("strategy", sorted(r.STRATEGIES))
def test_join_duplicates_and_nulls(probe, build, strategy):
    assert rows(r.join(probe, build, [("a", "b")], strategy=strategy)) == [(2, 2)] * 4 + [(3, 3)]


def test_join_two_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k2 int, s2 string")
    assert rows(r.join(a, b, [("k", "k2"), ("s", "s2")])) == [(1, "x", 1, "x")]


def test_broadcast_only_when_small(probe, build, monkeypatch):
    monkeypatch.setattr(r, "BROADCAST_BYTES", 2)
    plan = r.join(probe, build, [("a", "b")], strategy="broadcast")
    assert "broadcast" not in plan._jdf.queryExecution().analyzed().toString().lower()


def test_unknown_names(probe, build):
    with pytest.raises(ValueError):
        r.join(probe, build, [("a", "b")], strategy="none")
    with pytest.raises(ValueError):
        r.group(probe, x=("none", "a"))
    with pytest.raises(ValueError):
        s.call("none")


def test_cross(spark):
    assert r.cross_join(spark.range(3), spark.range(4).toDF("j")).count() == 12


def test_empty_aggregates(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert rows(r.group(none, total=("sum", "v"), n="count_all")) == [(None, 0)]
    assert rows(r.group(none, ["k"], n="count_all")) == []


def test_partial_and_final(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    wanted = {"n": "count_all", "total": ("sum", "id"), "low": ("min", "id"), "some": ("any", F.col("id") > 97)}
    assert rows(r.final_group(r.partial_group(df, ["k"], **wanted), ["k"], **wanted)) == rows(r.group(df, ["k"], **wanted))
    with pytest.raises(ValueError):
        r.partial_group(df, ["k"], x=("mean", "id"))


def test_top_k_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 1)], "id int, v int")
    assert [x.id for x in r.top_k(df, 2, ("v", "desc"), "id").collect()] == [1, 2]
    assert [x.id for x in r.sort(df, "v", "id").collect()] == [4, 1, 2, 3]


def test_dates(spark):
    one = spark.range(1)
    jan, feb = s.date_literal("1995-01-31"), s.date_literal("1996-02-29 00:00:00")
    got = one.select(s.call("timestampaddMonth", jan, 1), s.call("timestampaddYear", feb, 1), jan < feb, jan <= jan).first()
    assert tuple(got) == (datetime.date(1995, 2, 28), datetime.date(1997, 2, 28), True, True)


def test_int_div(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (-7, 3), (9007199254740993, 1)], "a long, b long")
    assert [x[0] for x in df.select(s.int_div(F.col("a"), F.col("b"))).collect()] == [-3, -3, -2, 9007199254740993]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("k|s|d|v|\n1|x y|1995-01-31|2.5|\n2||1996-02-29||\n")
    df = catalog.read_delimited(spark, [str(tmp_path / "t.tbl")], "k bigint, s string, d date, v double")
    assert rows(df) == [(1, "x y", datetime.date(1995, 1, 31), 2.5), (2, None, datetime.date(1996, 2, 29), None)]
    catalog.write_delimited(df, str(tmp_path / "out"), 2)
    again = catalog.read_delimited(spark, [str(tmp_path / "out")], "k bigint, s string, d date, v double")
    assert rows(again) == rows(df)


def test_catalog(spark, tmp_path):
    generator.generate(spark, "nation").write.parquet(str(tmp_path / "n"))
    c = catalog.Catalog.of_dictionary(spark, [{"tableName": "t", "fileType": "CSV", "filePath": "x", "columnNames": ["a", "b"], "columnTypes": ["bigint(20)", "decimal(10,2)"]}])
    c.add(catalog.TableDef("nation", "parquet", (str(tmp_path / "n"),)))
    assert c.show_tables() == ["nation", "t"] and c.tables["t"].columns == "a bigint, b double"
    assert ("n_name", "string") in c.describe("nation")
    with pytest.raises(KeyError):
        c.table("none")
    c.add(catalog.TableDef("odd", "avro", ("x",)))
    with pytest.raises(ValueError):
        c.table("odd")


@pytest.mark.parametrize("table", ["region", "nation", *generator.ROWS])
def test_generator(spark, table):
    whole = generator.generate(spark, table, 0.001, parts=3)
    assert whole.columns == [c.split()[0] for c in catalog.SCHEMAS[table].split(", ")]
    assert [t for _, t in whole.dtypes] == [c.split()[1] for c in catalog.SCHEMAS[table].split(", ")]
    n = generator.rows_of(table, 0.001)
    assert whole.count() == n
    parts = generator.generate(spark, table, 0.001, 0, n // 2).union(generator.generate(spark, table, 0.001, n // 2))
    assert rows(parts) == rows(whole)
    assert generator.generate(spark, table, 0.001, n + 5).count() == 0


def test_generated_nations(spark):
    got = rows(generator.generate(spark, "nation").select("n_nationkey", "n_name"))
    assert len(got) == 25 and (0, "ALGERIA") in got and (24, "UNITED STATES") in got


def test_feedback(spark):
    spark.range(1).createOrReplaceTempView("one_row")
    assert surface.feedback(spark, "SELECT id FROM one_row;") == []
    assert len(surface.feedback(spark, "SELECT none FROM one_row")) == 1
    assert len(surface.feedback(spark, "SELEC id")) == 1


def test_tuning():
    f = tuning.StageFigures(1000, 10, build_seconds=20, cpu_share=0.25)
    assert tuning.remaining_seconds(f) == 100
    assert tuning.predict_seconds(f, 2) == 60 and tuning.predict_seconds(f, 8) == 40
    assert tuning.choose_parallelism(f, 50) == 3 and tuning.choose_parallelism(f, 1) == tuning.FALLBACK
    assert tuning.worth_rebuilding(f) and not tuning.worth_rebuilding(tuning.StageFigures(10, 10, 5))
    assert tuning.bottlenecks({"a": f, "b": tuning.StageFigures(1, 1, send_share=0.95)}) == {"b": "send"}
    assert tuning.choose_partitions(1 << 40, 1000) == 9000


def test_queries_in_the_background(spark):
    queries = {"three": lambda sp, d: sp.range(3), "bad": lambda sp, d: sp.sql("SELECT none")}
    m = QueryManager(spark, "", queries)
    h = m.start("three")
    assert len(h.result()) == 3 and h.state == FINISHED and h.plan() and '"id": 2' in h.result_json()
    assert [r.id for r in h.rows()] == [0, 1, 2] and h.count() == 3 and [r.id for r in h.result(1, 2)] == [2]
    assert json.loads(h.plan_json())["name"] and draw(json.loads(h.plan_json())).count("Range") == 1
    h.close()
    with pytest.raises(Exception):
        m.start("bad").result()
    with pytest.raises(KeyError):
        m.start("none")
    assert {x["name"] for x in m.list()} == {"three", "bad"}


def test_results_keep_their_order_and_names(spark):
    m = QueryManager(spark, "", {"sorted": lambda sp, d: sp.range(5000).repartition(7).orderBy(F.desc("id")).selectExpr("id", "NULL AS id")})
    h = m.start("sorted")
    assert [r[0] for r in h.rows()] == list(range(4999, -1, -1)) and h.table().columns == ["id", "id"]
    h.close()


def test_monitor(spark, tmp_path):
    m = QueryManager(spark, "", {"three": lambda sp, d: sp.range(3)})
    h = m.start("three")
    h.monitor(str(tmp_path / "log")).join(60)
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert lines[-1]["state"] == FINISHED and lines[-1]["Type"] == "TP" and lines[-1]["TimeStamp"] > 0
    h.close()


def test_tuner_manager(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    m = QueryManager(spark, "", {"slow": lambda sp, d: sp.range(1000).groupBy((F.col("id") % 7).alias("k")).count()})
    tuner = tuning.TunerManager(m, tuning.TunerPlan({"slow": 1e-6}))
    tuner.run("slow").close()
    assert tuner.chosen["slow"] == int(before) * tuning.FALLBACK and tuner.log[-1]["target"] == 1e-6
    tuner.run("slow").close()
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(int(before) * tuning.FALLBACK)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scan_size_of_one_table(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t.parquet"))
    try:
        catalog.set_scan_size("t", 100_000)
        df = catalog.load(spark, str(tmp_path), "t")
        assert df.rdd.getNumPartitions() >= 2 and df.count() == 100_000
    finally:
        catalog.set_scan_size("t", None)
    with pytest.raises(ValueError):
        catalog.set_scan_size("t", 0)


def test_forms_that_gather_are_in_order(spark):
    from granary.plans import registry

    sf = "/root/testdata/sf0.001"
    for name in ("q2_minimum_cost_supplier", "q2_minimum_cost_supplier_single"):
        got = [(-x.s_acctbal, x.n_name, x.s_name, x.p_partkey) for x in registry.queries()[name](spark, sf).collect()]
        assert got == sorted(got)
    for name in ("q3_shipping_priority_single", "q3_shipping_priority_hash"):
        got = [(-x.revenue, x.o_orderdate, x.l_orderkey) for x in registry.queries()[name](spark, sf).collect()]
        assert got == sorted(got) and len(got) > 3


def test_script(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    m = QueryManager(spark, "", {"three": lambda sp, d: sp.range(3)})
    log = Runner(m).run("BEGIN; START_AND_COLLECT three; WAIT_QUERY 10; ADD_CONCURRENCY 2; ECHO done, now; R_CONFIG table_scan_size, 1000000; ADD_PARALLELISM QUERY,3; ADD_PARALLELISM STAGE,1,2; ADD_PARALLELISM_TO_INIT QUERY,1; LISTEN BUILD,STAGE,0; PREDICT_TIME 2; PREDICT_TIME 0,2; R_CONFIG SET_TABLE_SCAN_SIZE,lineitem,1000000; R_CONFIG task_group_close_mode,true; END;")
    catalog.set_scan_size("lineitem", None)
    assert f"shuffle partitions: {2 * int(before) + 5}" in log and f"shuffle partitions: {int(before) + 1}" in log and "three: stage 0 is done" in log
    assert log[1] == "three: 3 rows" and "done, now" in log
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for bad in ("START_QUERY x;", "BEGIN; NONE; END;", "BEGIN; START_QUERY; END;", "BEGIN; END", "BEGIN; LISTEN STAGE,1,2; END;", "BEGIN; ADD_PARALLELISM STAGE,1; END;", "BEGIN; R_CONFIG SET_TABLE_SCAN_SIZE,t,x; END;"):
        with pytest.raises(ScriptError):
            parse(bad)
