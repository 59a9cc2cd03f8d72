"""SQL over the tables of a data folder."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.dialect import EXISTS, INTEGER_CAST, NOT_IN, to_spark
from lodestone.sources.readers import TABLES, read_delimited, read_table
from lodestone.session import parse_size


class Engine:
    """Answers read-only SQL over a folder of Parquet tables, or over tables registered by name.

    sql() is lazy: it returns a DataFrame whose plan Catalyst optimises. Texts are in the dialect of the tests' oracle, see
    ``functions.dialect`` for what of it is translated; native() takes Spark's own.

    Table names are this engine's own: engines over other folders in the same session don't change what its texts read.
    ``budget`` is how many bytes its cached tables may take, by their size on disk ("4 GB"); None sets no bound.
    """

    #: Accepted for callers that set it. Without effect: there is no other engine to fall back to.
    fallback = False
    #: Whose table a name is at the moment, in each session.
    _owners: dict[tuple[str, str], int] = {}
    _numbers = itertools.count()

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: tuple[str, ...] = TABLES, budget: str | None = None):
        self.spark = spark
        self._number, self._session = next(self._numbers), spark._jsparkSession.sessionUUID()
        self.folder = folder
        self.budget = parse_size(budget) if budget else None
        self._tables: dict[str, DataFrame] = {}
        self._cached: dict[str, tuple[DataFrame, int]] = {}
        for name in tables if folder else ():
            self._tables[name] = read_table(spark, folder, name)

    def buffers(self, cache: str, processing: str) -> bool:
        """Sets the budget of cached tables, and tells whether the executors' memory for storage and execution holds both sizes.

        What executors have is decided when the session is built or submitted.
        """
        self.budget = parse_size(cache)
        each = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
        have = 0
        while each.hasNext():
            have += each.next()._1()
        return self.budget + parse_size(processing) <= have

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self._tables[name] = df
        self._owners.pop((self._session, name), None)
        return df

    def _claim(self) -> None:
        """Gives this engine's tables their names, where another's have them."""
        for name, df in self._tables.items():
            if self._owners.get((self._session, name)) != self._number:
                df.createOrReplaceTempView(name)
                self._owners[self._session, name] = self._number

    def load(self, name: str, path: str, schema: str, sep: str = "|", header: bool = False, null: str = "") -> DataFrame:
        """COPY of delimited text into a table: a line that doesn't fit the schema is an error, not a row of nulls."""
        return self.register(name, read_delimited(self.spark, path, schema, sep, header, null))

    def sql(self, text: str) -> DataFrame:
        """A query in the oracle's dialect."""
        self._claim()
        floating = {f.name.lower() for df in self._tables.values() for f in df.schema if f.dataType.typeName() in ("double", "float")} if INTEGER_CAST.search(text) else ()
        anti, schemas = bool(NOT_IN.search(text)), {}
        if EXISTS.search(text):
            schemas = {name.lower(): {f.name.lower(): f.dataType.typeName() for f in df.schema} for name, df in self._tables.items()}
        for form in ({"anti": anti, "schemas": schemas}, {"anti": anti}) if schemas else ({"anti": anti},) if anti else ():
            try:
                return self.spark.sql(to_spark(text, floating, **form))
            except AnalysisException:  # a subquery that refers to what is around it
                pass
        return self.spark.sql(to_spark(text, floating))

    execute = sql

    def native(self, text: str) -> DataFrame:
        """A query in Spark's dialect."""
        self._claim()
        return self.spark.sql(text)

    execute = sql

    def schema(self, text: str):
        """The result's schema; nothing runs."""
        return self.sql(text).schema

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The physical plan as text."""
        return self.spark._jvm.PythonSQLUtils.explainString(self.sql(text)._jdf.queryExecution(), mode)

    def supports(self, text: str) -> bool:
        """Whether the text can be planned."""
        from pyspark.errors import PySparkException

        try:
            self.explain(text, "simple")
        except (PySparkException, ValueError):
            return False
        return True

    def coverage(self, texts: dict[str, str]) -> dict[str, bool]:
        """Which of the named texts can be planned over this engine's tables; these may be empty, as nothing runs."""
        return {name: self.supports(text) for name, text in texts.items()}

    def execute_and_verify(self, text: str, oracle: Callable[[str], tuple[list[str], Iterable[tuple]]], digits: int = 6) -> DataFrame:
        """The query's result if ``oracle``, which gives names and rows of another engine's, has the same rows in any order;
        otherwise ValueError. Floating point is compared to so many digits. All rows come to the driver: for tests."""
        df = self.sql(text)
        names, wanted = oracle(text)
        if sorted(df.columns) != sorted(names):
            raise ValueError(f"columns {df.columns} against {list(names)}")

        def plain(row, order):
            return tuple(f"{row[n]:.{digits}g}" if isinstance(row[n], float) else str(row[n]) for n in order)

        order = [names.index(c) for c in sorted(names)]
        a = Counter(plain(r, [df.columns.index(c) for c in sorted(names)]) for r in df.collect())
        b = Counter(plain(r, order) for r in wanted)
        if a != b:
            raise ValueError(f"rows of one only: {list((a - b).items())[:5]}, of the other only: {list((b - a).items())[:5]}")
        return df

    def cache(self, name: str, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> bool:
        """Keeps a table in memory, columnar, once it is read; False, and nothing is kept, if that would exceed the budget."""
        df = self._tables[name]
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if self.budget is not None and size + sum(n for _, n in self._cached.values()) > self.budget:
            return False
        self._cached[name] = df.persist(level), size
        return True

    def invalidate(self, name: str | None = None) -> None:
        """Drops one cached table, or all; tables of the folder are read anew."""
        for key in [name] if name else list(self._cached):
            if key in self._cached:
                self._cached.pop(key)[0].unpersist()
                if self.folder and key in TABLES:
                    self.register(key, read_table(self.spark, self.folder, key))
