"""Sources and sinks: Parquet, delimited text, rows in memory, ranges, one-row and empty relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files as one table; only the named columns are read."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "|", header: bool = False, null: str = "", malformed: str | None = None) -> DataFrame:
    """Delimited text with a given schema. A separator at each line's end, as table generators write it, is accepted if the first line has it.

    A line whose fields don't fit is an error when they are read; with ``malformed`` it keeps what fits, and is itself in a column
    of that name, which is null for other lines.
    """
    fields = list((T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields)
    first = spark.read.text(path).first()
    whole = T.StructType([*fields, *([T.StructField("__end", T.StringType())] if first and first[0].rstrip("\r").endswith(sep) else []), *([T.StructField(malformed, T.StringType())] if malformed else [])])
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": malformed} if malformed else {"mode": "FAILFAST"}
    return spark.read.options(sep=sep, header=header, nullValue=null, **mode).schema(whole).csv(path).drop("__end")


def values(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """Rows given in the program."""
    return spark.createDataFrame(list(rows), schema)


def one_row(spark: SparkSession) -> DataFrame:
    """The relation of one row without columns."""
    return spark.sql("SELECT 1 AS one").drop("one")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A relation without rows."""
    return spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One folder of Parquet files; partition columns become folders that later reads can skip."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
