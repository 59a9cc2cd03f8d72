"""The engine, the dialect shim, sources, operators and streams by hand-made cases, and the shapes of plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import dialect
from lodestone.operators import joins, relational
from lodestone.plans import catalogue
from lodestone.session import parse_size, scratch
from lodestone.sources import readers
from lodestone.streaming import events as streams

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DATA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("text", "size"), [("4 GB", 4 * 10**9), ("512MiB", 2**29), ("1.5 kb", 1500), ("7", 7), (" 2 tib ", 2 * 2**40)])
def test_sizes(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", ["", "GB", "4 XB", "-1 GB", None])
def test_sizes_that_are_none(text):
    with pytest.raises(ValueError):
        parse_size(text)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("SELECT a // 2, 'x // strlen(y)', strlen(b) -- c // d\n;", "SELECT a  div  2, 'x // strlen(y)', octet_length(b) -- c // d"),
        ("SELECT a / 2, a / b FROM t", "SELECT a / 2, (CASE WHEN b = 0 THEN a * CAST('Infinity' AS DOUBLE) ELSE a / b END) FROM t"),
        ("SELECT x ORDER BY a, b DESC NULLS FIRST", "SELECT x ORDER BY a NULLS LAST, b DESC NULLS FIRST"),
        ('SELECT "a b", \'it\'\'s\' FROM t', "SELECT `a b`, 'it\\'s' FROM t"),
        ("SELECT CAST(d AS INT), CAST(count(d / 2) AS INT), CAST(s AS INT) FROM t", "SELECT CAST(bround(d, 0) AS INT), CAST(count(d / 2) AS INT), CAST(s AS INT) FROM t"),
        ("SELECT struct_pack(k := a, v := b) FROM t", "SELECT struct(a AS k, b AS v) FROM t"),
    ],
)
def test_translation(text, wanted):
    assert dialect.to_spark(text, {"d"}) == wanted


@pytest.mark.parametrize(
    ("expression", "wanted"),
    [
        ("regexp_replace('aaa', 'a', 'b')", "baa"), ("regexp_replace('aaa', 'a', 'b', 'g')", "bbb"), ("regexp_replace('a.b.c', '\\.(\\w)', '-\\1')", "a-b.c"), ("CAST(2.7 AS INT)", 3), ("substring('hello', 0, 3)", "he"), ("CAST(1 AS DOUBLE) / 0", float("inf")),
        ("-1 / 0", float("-inf")), ("'a\\nb'", "a\\nb"), ("7 // 2", 3), ("-7 // 2", -3), ("strlen('aé')", 3), ("prefix('abc', 'ab')", True), ("TRY(CAST('abc' AS INT))", None), ("9007199254740993 // 1", 9007199254740993), ("list_sort(array(3, NULL, 1))", [1, 3, None]),
    ],
)
def test_dialect_by_value(engine, expression, wanted):
    assert engine.sql(f"SELECT {expression} AS x").first().x == wanted


def test_engine(engine):
    assert engine.supports("SELECT n_name FROM nation") and not engine.supports("SELECT nothing FROM nation") and not engine.supports("SELECT FROM WHERE") and not engine.supports("SELECT (1")
    assert engine.schema("SELECT count(*) AS n FROM nation").names == ["n"]
    assert engine.cache("nation")
    assert "InMemoryTableScan" in engine.explain("SELECT n_name FROM nation", "simple")
    engine.invalidate()
    assert "InMemoryTableScan" not in engine.explain("SELECT n_name FROM nation", "simple")


def test_cache_budget(spark):
    engine = Engine(spark, DATA, ("nation", "lineitem"), budget="20 KB")
    assert engine.cache("nation") and not engine.cache("lineitem")
    engine.invalidate()


def test_buffers(spark):
    engine = Engine(spark, DATA, ("nation", "lineitem"))
    assert engine.buffers("20 KB", "1 MB") and not engine.buffers("20 KB", "500 TB")
    assert engine.budget == 20_000 and not engine.cache("lineitem")
    with pytest.raises(ValueError):
        engine.buffers("much", "more")


def test_engines_do_not_see_each_other(spark):
    one, other = Engine(spark, DATA, ("nation",)), Engine(spark)
    other.register("nation", spark.range(3))
    assert (one.sql("SELECT * FROM nation").count(), other.sql("SELECT * FROM nation").count(), one.sql("SELECT * FROM nation").count()) == (25, 3, 25)
    counts = set()
    for n in range(30):  # whose objects Python may give one address after the other
        engine = Engine(spark)
        engine.register("nation", spark.range(n))
        counts.add((n, engine.sql("SELECT count(*) AS n FROM nation").first().n))
    assert counts == {(n, n) for n in range(30)}


def test_execute_and_verify(engine):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW nation AS SELECT * FROM '{DATA}/nation.parquet'")

    def oracle(text):
        got = duck.execute(text)
        return [d[0] for d in got.description], got.fetchall()

    assert engine.execute_and_verify("SELECT n_regionkey, avg(n_nationkey) / 3 AS a FROM nation GROUP BY n_regionkey", oracle).count() == 5
    with pytest.raises(ValueError, match="rows of one only"):
        engine.execute_and_verify("SELECT n_name FROM nation", lambda text: (["n_name"], [("nowhere",)]))


def test_coverage_over_empty_tables(spark):
    """Every registered text can be planned from schemas alone."""
    engine = Engine(spark)
    for name in readers.TABLES:
        engine.register(name, spark.createDataFrame([], spark.read.parquet(f"{DATA}/{name}.parquet").schema))
    assert all(engine.coverage(catalogue.SAME).values()) and len(catalogue.SAME) > 150


def test_no_broadcast_without_a_bound(spark):
    """With size-based broadcasts off, only comparisons of all pairs and one-row subqueries are sent to every executor."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    sent = {n for n, q in catalogue.queries().items() if not n.startswith("x_stream") and re.search("BroadcastHashJoin|null_aware", spark._jvm.PythonSQLUtils.explainString(q(spark, DATA)._jdf.queryExecution(), "simple"))}
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sent == set()


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45", r"PushedFilters: \[IsNotNull\(l_quantity\), GreaterThan\(l_quantity,45.0\)\]"),
        ("SELECT l_orderkey FROM lineitem", r"ReadSchema: struct<l_orderkey:bigint>"),
        ("SELECT count(*) FROM lineitem", r"ReadSchema: struct<>"),
        ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 5", "TakeOrderedAndProject"),
        ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "LeftSemi"),
        ("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)", r"LeftAnti"),
        ("SELECT l_returnflag, sum(l_quantity) FROM lineitem GROUP BY l_returnflag", r"partial_sum"),
    ],
)
def test_plan_shapes(engine, text, wanted):
    assert re.search(wanted, engine.explain(text))


@pytest.mark.parametrize("name", ["mixed_mark", "mixed_semi", "mixed_anti", "mixed_right_semi", "mixed_right_anti", "q04"])
def test_exists_beyond_meets_one_row_a_key(spark, name):
    """What a row is compared with are its key's extremes, not all rows of the key."""
    plan = spark._jvm.PythonSQLUtils.explainString(catalogue.queries()[name](spark, DATA)._jdf.queryExecution(), "simple")
    assert re.search(r"partial_(max|min)\(", plan) and re.search("ExistenceJoin|LeftSemi|LeftAnti", plan)


BEYOND = [
    "b.k = a.k AND b.v > a.v", "b.k = a.k AND a.v < b.v", "b.k = a.k AND b.v >= a.v + 1", "a.k = b.k AND b.v < a.v", "b.k = a.k AND a.v >= b.v AND b.w > 2", "b.v > a.v", "b.v < a.v - 4", "b.k = a.k AND b.v > a.v AND a.w > 1",
    "b.k + 1 = a.k AND b.w = a.w AND b.v <= a.v", "b.k = a.k AND b.w > a.v", "b.k = a.k AND b.v > a.v AND b.w IS NOT NULL AND b.v IN (1, 2, 'nan')", "b.k = a.k AND b.s > a.s", "b.k = a.k AND b.v > a.v AND b.w < a.w", "b.k = a.k AND b.v <> a.v",
    "b.k = a.k AND (b.v > a.v OR b.w > a.w)", "b.k = a.k AND b.v BETWEEN a.v AND a.w", "b.k = a.k AND b.v > (SELECT min(v) FROM two)", "b.k = a.k AND b.v > a.v AND b.k > 100",
]


@pytest.mark.parametrize("where", BEYOND)
def test_exists_beyond_by_value(spark, where):
    engine, duck = Engine(spark), duckdb.connect()
    values = ["NULL", "0", "1", "2.5", "'nan'", "'-inf'", "7"]
    for name, step in (("one", 1), ("two", 3)):
        cells = [f"({k}, CAST({v} AS DOUBLE), {(n * step) % 5 if n % 4 else 'NULL'}, '{n * step % 13}')" for n, (k, v) in enumerate((k, v) for k in ("1", "2", "NULL", str(3 + step)) for v in (values if k != "2" or step == 1 else values[:1]))]
        text = f"SELECT * FROM (VALUES {', '.join(cells)}) AS t(k, v, w, s)"
        duck.execute(f"CREATE TABLE {name} AS {text}")
        engine.register(name, spark.sql(text))
    for text in (
        f"SELECT a.k, a.v, a.w, a.s, EXISTS (SELECT 1 FROM two AS b WHERE {where}) AS found FROM one a",
        f"SELECT a.k, a.v, a.w, a.s FROM one a WHERE NOT EXISTS (SELECT b.* FROM two b WHERE {where}) AND a.s <> 'x'",
        f"WITH two AS (SELECT k, CAST(w AS DOUBLE) AS v, v AS w, s FROM one) SELECT count(*) AS n FROM one a WHERE EXISTS (SELECT 1 FROM two b WHERE {where})",
    ):
        wanted = [tuple(r) for r in duck.execute(text).fetchall()]
        assert sorted(map(str, map(tuple, engine.sql(text).collect()))) == sorted(map(str, wanted)), text


def test_exists_beyond_leaves_other_texts():
    types = {"t": {"k": "long", "v": "double", "s": "string", "r": "struct"}}
    for where in ("t.k = u.k AND t.v > u.v AND t.v < u.w", "k = x OR v > y", "k = x AND s > y", "k = x AND t.r.a > y", "k = x AND v > y ORDER BY 1 LIMIT 0", "k = x AND v + z > y", "k = x AND v > (SELECT 1)", "k = x AND r.a > y"):
        text = f"SELECT 1 FROM u WHERE EXISTS (SELECT 1 FROM t WHERE {where})"
        assert "__beyond" not in dialect.to_spark(text, schemas=types)
    assert "__beyond" not in dialect.to_spark("WITH t AS (SELECT 1 AS k, 'a' AS v) SELECT 1 FROM u WHERE EXISTS (SELECT 1 FROM t WHERE k = x AND v > y)", schemas=types)
    assert "__beyond" not in dialect.to_spark("SELECT 1 FROM u WHERE EXISTS (SELECT count(*) FROM t WHERE k = x AND v > y)", schemas=types)
    assert "__beyond" in dialect.to_spark("SELECT 1 FROM u WHERE EXISTS (SELECT 1 FROM t WHERE k = x AND v > y)", schemas=types)


def test_no_python_in_any_plan(spark):
    for name, query in catalogue.queries().items():
        if not name.startswith("x_stream"):
            assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMap", spark._jvm.PythonSQLUtils.explainString(query(spark, DATA)._jdf.queryExecution(), "simple")), name


@pytest.mark.parametrize("name", ["q05", "q18", "count_distinct_mixed", "full_join", "x_as_of"])
def test_any_number_of_partitions(spark, name):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(catalogue.queries()[name](spark, DATA)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1|one|\n2||\n")
    assert rows(readers.read_delimited(spark, str(tmp_path / "a.tbl"), "k int, name string")) == [(1, "one"), (2, None)]
    (tmp_path / "b.tbl").write_text("1|one\n2|two\nthree|3\n4\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_delimited(spark, str(tmp_path / "b.tbl"), "k int, name string").collect()
    assert sorted(r.bad for r in readers.read_delimited(spark, str(tmp_path / "b.tbl"), "k int, name string", malformed="bad").cache().where("bad is not null").collect()) == ["4", "three|3"]
    df = readers.values(spark, [(k, k % 3) for k in range(9)], "k int, part int")
    readers.write_parquet(df, str(tmp_path / "out"), ["part"])
    again = readers.read_parquet(spark, str(tmp_path / "out"), columns=["k", "part"])
    assert rows(again) == rows(df)
    assert "PartitionFilters: [isnotnull(part" in spark._jvm.PythonSQLUtils.explainString(again.where("part = 1")._jdf.queryExecution(), "simple")
    assert readers.one_row(spark).count() == 1 and readers.empty(spark, "a int").count() == 0


def test_dialect_functions(spark):
    df = spark.createDataFrame([(-7, 2, "a.b.c"), (7, 0, None)], "a int, b int, s string")
    got = df.select(dialect.int_div(F.col("a"), F.col("b")), dialect.divide(F.col("a"), F.col("b")), dialect.replace_first(F.col("s"), r"\.(\w)", r"-\1"), dialect.strlen(F.col("s")))
    assert [tuple(r) for r in got.collect()] == [(-3, -3.5, "a-b.c", 5), (None, None, None, None)]


def test_order_puts_nulls_last(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert [r.a for r in relational.order(df, "a").collect()] == [1, 3, None]
    assert [r.a for r in relational.order(df, "a desc").collect()] == [3, 1, None]
    assert [r.a for r in relational.order(df, "a desc nulls first").collect()] == [None, 3, 1]
    assert [r.a for r in relational.top_n(df, 1, "a desc", offset=1).collect()] == [1]


@pytest.mark.parametrize(("right", "wanted"), [([1, 2], {1: True, 3: False, None: None}), ([1, None], {1: True, 3: None, None: None}), ([], {1: False, 3: False, None: False})])
def test_mark(spark, right, wanted):
    left = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert {r.k: r.mark for r in joins.mark(left, spark.createDataFrame([(x,) for x in right], "r int"), ("k", "r")).collect()} == wanted


@pytest.mark.parametrize(("kind", "null_safe", "n"), [("inner", False, 1), ("inner", True, 2), ("left", False, 3), ("right", False, 2), ("full", False, 4), ("semi", False, 1), ("anti", False, 2), ("right_semi", False, 1), ("right_anti", False, 1)])
def test_joins_with_null_keys(spark, kind, null_safe, n):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "a int"), spark.createDataFrame([(1,), (None,)], "b int")
    assert joins.join(left, right, [("a", "b")], kind, null_safe).count() == n


def test_as_of_and_range_edges(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9), (None, 4)], "k string, t int")
    right = spark.createDataFrame([("x", 5, "same"), ("x", 3, "before"), ("y", 10, "after"), (None, 3, "null key")], "k string, t int, v string")
    assert {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()} == {("x", 5): "same", ("x", 1): None, ("y", 9): None, (None, 4): "null key"}
    many = spark.createDataFrame([("x" if k % 3 else None, (k * 37) % 200, k) for k in range(200)], "k string, t int, n int")
    some = spark.createDataFrame([("x" if k % 4 else None, k * 7 % 150, f"v{k}") for k in range(60)], "k string, t int, v string")
    assert rows(joins.as_of(many, some, ["k"], "t", ["v"])) == rows(joins.as_of(many, some, ["k"], "t", ["v"], slices=6))
    assert {(r.k, r.t): r.v for r in joins.as_of(left, right, ["k"], "t", ["v"], slices=3).collect()} == {("x", 5): "same", ("x", 1): None, ("y", 9): None, (None, 4): "null key"}
    spans = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 10.5, "b"), (9.0, 30.0, "c"), (8.0, 7.0, "backwards"), (9.4, 1e9, "wide"), (-1e300, 1e300, "all"), (None, 3.0, "none")], "lo double, hi double, v string")
    points = spark.createDataFrame([(9.5,), (10.0,), (30.0,), (None,)], "p double")
    assert sorted((r.p, r.v) for r in joins.range_join(points, spans, "p", "lo", "hi", 4.0).collect()) == sorted(
        [(9.5, "a"), (9.5, "c"), (10.0, "b"), (10.0, "c"), *[(p, v) for p in (9.5, 10.0, 30.0) for v in ("wide", "all")]]
    )


def test_theta_refuses_two_large_sides(spark):
    left, right = spark.range(100).toDF("a"), spark.range(100).toDF("b")
    assert joins.theta(left, right, F.col("a") < F.col("b")).count() == 4950
    with pytest.raises(ValueError):
        joins.theta(left, right, F.col("a") < F.col("b"), bounded=10)
    assert joins.theta(left, right, F.col("a") == F.col("b"), bounded=10).count() == 100


def test_stream_over_several_files_and_none(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet")
    schema.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    out = streams.drained(streams.windowed(streams.source(spark, str(tmp_path)), "1 hour"))
    assert out.agg(F.sum("n")).first()[0] == schema.count()
    schema.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "events.parquet"))
    assert streams.drained(streams.windowed(streams.source(spark, str(tmp_path / "none")), "1 hour")).count() == 0
    assert scratch(spark)
