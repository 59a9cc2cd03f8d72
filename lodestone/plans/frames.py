"""Queries built from DataFrame operators and streams rather than SQL text, with the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import dialect
from lodestone.operators import joins, relational
from lodestone.session import scratch
from lodestone.sources.readers import read_table
from lodestone.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]


def _stream(build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = streams.drained(build(streams.source(spark, d)))
        return out.withColumn("start", F.col("start").cast("timestamp_ntz"))

    return run


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round("v", 2))


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    buys = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return joins.as_of(buys, views, ["user_id"], "ts", ["view_id"])


def _span(spark: SparkSession, d: str) -> DataFrame:
    spans = read_table(spark, d, "nation").select(F.col("n_name"), (F.col("n_nationkey") * 300.0).alias("lo"), (F.col("n_nationkey") * 300.0 + 450).alias("hi"))
    return joins.range_join(read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), spans, "c_acctbal", "lo", "hi", 500).select("c_custkey", "n_name")


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """A table written as delimited text and loaded again."""
    path = f"{scratch(spark)}/load-{uuid.uuid4().hex}"
    read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, sep="|")
    engine = Engine(spark)
    engine.load("loaded", path, "c_custkey bigint, c_name string, c_acctbal double")
    return engine.sql("SELECT c_name, c_custkey // 10 AS tens, c_acctbal FROM loaded WHERE c_custkey % 2 = 0")


FRAMES: dict[str, tuple[Query, str]] = {
    "df_mark": (
        lambda spark, d: joins.mark(read_table(spark, d, "nation").select("n_nationkey"), read_table(spark, d, "supplier").where("s_acctbal > 8000"), ("n_nationkey", "s_nationkey")),
        "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) AS mark FROM nation",
    ),
    "df_right_anti": (
        lambda spark, d: joins.join(read_table(spark, d, "orders").where("o_totalprice > 350000"), read_table(spark, d, "customer"), [("o_custkey", "c_custkey")], "right_anti").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
    ),
    "df_right_semi": (
        lambda spark, d: joins.join(read_table(spark, d, "orders").where("o_totalprice > 350000"), read_table(spark, d, "customer"), [("o_custkey", "c_custkey")], "right_semi").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
    ),
    "df_count_distinct_tuple": (
        lambda spark, d: relational.count_distinct(read_table(spark, d, "lineitem"), ["l_returnflag"], ["l_partkey", "l_suppkey"], "n"),
        "SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "df_top_n": (
        lambda spark, d: relational.top_n(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 15, "o_totalprice desc", "o_orderkey", offset=5),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5",
    ),
    "df_aggregate_having": (
        lambda spark, d: relational.aggregate(read_table(spark, d, "orders"), ["o_custkey"], "n > 10", n="count(*)", total="round(sum(o_totalprice), 2)"),
        "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    ),
    "df_replace_first": (
        lambda spark, d: read_table(spark, d, "pages").select("page_id", dialect.replace_first(F.col("url"), "/", "|").alias("u")),
        "SELECT page_id, regexp_replace(url, '/', '|') AS u FROM pages",
    ),
    "df_int_div_large": (
        lambda spark, d: read_table(spark, d, "orders").select("o_orderkey", dialect.int_div(F.col("o_orderkey") + F.lit(9007199254740993), F.lit(7)).alias("q")),
        "SELECT o_orderkey, (o_orderkey + 9007199254740993) // 7 AS q FROM orders",
    ),
    "df_load_delimited": (_loaded, "SELECT c_name, c_custkey // 10 AS tens, c_acctbal FROM customer WHERE c_custkey % 2 = 0"),
    "x_as_of": (
        _as_of,
        "SELECT b.user_id, b.ts, b.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON b.user_id = v.user_id AND b.ts >= v.ts",
    ),
    "x_range_join": (_span, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_acctbal >= n_nationkey * 300.0 AND c_acctbal < n_nationkey * 300.0 + 450"),
    "x_stream_tumbling": (
        _stream(lambda s: _rounded(streams.windowed(s, "1 hour"))),
        "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2",
    ),
    "x_stream_sliding": (
        _stream(lambda s: _rounded(streams.windowed(s, "2 hours", "1 hour"))),
        "SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, value FROM events, (VALUES (0), (1)) AS t(k)) AS w GROUP BY 1, 2",
    ),
    "x_stream_sessions": (
        _stream(lambda s: streams.sessions(s, "30 minutes")),
        "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k",
    ),
}
