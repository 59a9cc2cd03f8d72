"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.engine import Engine
from lodestone.plans import clickstream, core, frames, suites, tpch
from lodestone.sources.readers import TABLES

SAME = core.SAME | tpch.SAME | clickstream.SAME | suites.SAME
PAIRS = core.PAIRS | tpch.PAIRS | clickstream.PAIRS | suites.PAIRS


def _run(text: str, native: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    used = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))
    return lambda spark, folder: (engine := Engine(spark, folder, used), engine.native(text) if native else engine.sql(text))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    pairs = {k: _run(spark, native=spark != oracle) for k, (spark, oracle) in PAIRS.items()}
    return {k: _run(t) for k, t in SAME.items()} | pairs | {k: q for k, (q, _) in frames.FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return SAME | {k: oracle for k, (_, oracle) in PAIRS.items()} | {k: s for k, (_, s) in frames.FRAMES.items()}
