"""Session construction and size strings."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def parse_size(text: str) -> int:
    """Bytes of a size such as ``"4 GB"`` or ``"512MiB"``; ValueError for anything else."""
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", text or "")
    if not match or match[2].upper() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(match[1]) * _UNITS[match[2].upper()])


def build_session(app: str = "lodestone", cpus: int | None = None, memory: str = "8 GB", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster, set the same keys at submit time.

    UTC keeps timestamps equal to zone-free engines, AQE coalesces and splits shuffle partitions at run time.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", f"{parse_size(memory) // 2**20}m")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors can write and read: ``spark.checkpoint.dir``, or on one machine a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark wrote, by any path that it can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
