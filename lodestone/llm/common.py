"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder that all executors share: the session's ``spark.checkpoint.dir``.
shared_folder = scratch


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Part of all rows from which a key is hot. No more than 1 / HOT keys can be.
HOT = 1 / 1000


def hot_keys(rows: DataFrame, key: str, hot: float = HOT) -> DataFrame | None:
    """The keys (not null) that each hold more than the part ``hot`` of the rows, at most 1 / hot of them; None if there are none."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    found = counted.where(F.col("count") > rows.count() * hot).select(key).limit(int(1 / hot) + 1).toArrow()
    return rows.sparkSession.createDataFrame(found) if found.num_rows else None


def attached(rows: DataFrame, groups: DataFrame, key: str, hot: float = HOT) -> DataFrame:
    """rows joined with groups, which has a row a key, without moving the rows of hot keys: what groups has for these is broadcast.

    rows are read three times, so they should be written or cheap.
    """
    many = hot_keys(rows, key, hot)
    if many is None:
        return rows.join(groups, key)
    many = F.broadcast(many)
    return rows.join(F.broadcast(groups.join(many, key)), key).unionByName(rows.join(many, key, "left_anti").join(groups, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then evaluated once a row even inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as SQL has it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names: run sees and gives them as they are, Spark has them numbered in between."""
    names = df.columns

    def numbered(batches):
        for batch in run(batch.rename_columns(names) for batch in batches):
            yield batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])

    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(numbered, kinds).toDF(*schema.names)


def with_fields(df: DataFrame, **types: str) -> T.StructType:
    """The schema of df with further fields of named types."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in types.items())])
