"""Joins that SQL spells awkwardly; the physical strategy is Spark's choice, from sizes it measures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket widths of range_join beside the whole line.
WIDTHS = 4
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], kind: str = "inner", null_safe: bool = False, residual: Column | None = None) -> DataFrame:
    """An equi-join of column pairs, with a further condition over both sides if given. Kinds: those of KINDS, and right_semi, right_anti.

    The columns of the two sides must have different names, but for semi and anti joins of the pairs.
    """
    if kind in ("right_semi", "right_anti"):
        return join(right, left, [(b, a) for a, b in on], kind.removeprefix("right_"), null_safe, residual)
    pairs = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in on]
    return left.join(right, reduce(lambda x, y: x & y, [*pairs, *([residual] if residual is not None else [])]), KINDS[kind])


def mark(left: DataFrame, right: DataFrame, on: tuple[str, str], name: str = "mark") -> DataFrame:
    """left with a boolean column that tells whether its key is among right's: SQL's IN, with its null where it can't tell."""
    keys = right.select(F.col(on[1]).alias("__key")).distinct()
    some = keys.agg(F.count("*").alias("__n"), F.count_if(F.col("__key").isNull()).alias("__nulls"))
    found = left.join(keys.where("__key is not null").withColumn("__hit", F.lit(True)), left[on[0]] == F.col("__key"), "left").crossJoin(some)
    known = F.when(F.col("__hit"), True).when((F.col("__n") > 0) & (left[on[0]].isNull() | (F.col("__nulls") > 0)), F.lit(None)).otherwise(False)
    return found.select(*[left[c] for c in left.columns], known.alias(name))


#: Bytes, as the planner estimates them, up to which a side may be compared with every row of the other.
BOUNDED = 64 << 20


def theta(left: DataFrame, right: DataFrame, condition: Column, kind: str = "inner", bounded: int = BOUNDED) -> DataFrame:
    """A join on any condition. Without an equality among its terms Spark compares all pairs, so one side must be small: ValueError
    if neither is estimated at ``bounded`` bytes or less."""
    out = left.join(right, condition, KINDS[kind])
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if min(size(left), size(right)) > bounded and re.search("NestedLoop|CartesianProduct", out._jdf.queryExecution().executedPlan().toString()):
        raise ValueError("both sides are too large to be compared pair by pair")
    return out


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], slices: int = 1) -> DataFrame:
    """For each left row the values of the last right row of the same key at or before its time; null if there is none.

    One shuffle: both sides are laid in one order per key, and a window carries the last right row forward. If a key may hold much of
    the rows, ``slices`` cuts time at quantiles of the right side, so that a key is dealt to as many tasks; the last right row of the
    slices before is then joined to each.
    """
    keys = [*by, at]
    one = left.select(*keys, F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__r"), F.lit(1).alias("__side"))
    two = right.select(*keys, F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__r"), F.lit(0).alias("__side"))
    both = one.unionByName(two)
    if slices > 1:
        cuts = F.broadcast(right.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], 100 * slices).alias("__cuts")))
        both = both.crossJoin(cuts).withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(at))), F.lit(0))).drop("__cuts")
        last = both.groupBy(*by, "__slice").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col(at))).alias("__last"))
        before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("__slice").alias("__of"), F.last("__last", ignorenulls=True).over(before).alias("__last"))
        both = both.join(last, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by], F.col("__slice") == F.col("__of")), "left")
    order = Window.partitionBy(*by, *(["__slice"] if slices > 1 else [])).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__r", ignorenulls=True).over(order)
    both = both.withColumn("__r", F.coalesce(found, F.col("__last")) if slices > 1 else found).where("__side = 1")
    return both.select("__l.*", *[F.col(f"__r.{v}").alias(v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, most: int = 64) -> DataFrame:
    """Points with the spans [start, end) that hold them, by equal buckets instead of all pairs.

    A span is filed in each bucket it touches. Those that touch more than ``most`` buckets of one width are filed by one ``most`` times
    as wide, and so on, up to WIDTHS; what is wider still has one bucket, the whole line. Empty spans hold nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.lit(WIDTHS)
    for k in reversed(range(WIDTHS)):
        level = F.when(length <= width * float(most) ** (k + 1), k).otherwise(level)
    size = lambda level: F.lit(width) * F.pow(F.lit(float(most)), level)
    bucket = lambda x, level: F.when(level == WIDTHS, 0).otherwise(F.floor(x / size(level))).cast("bigint")
    s = spans.where(length > 0).withColumn("__l", level).withColumn("__b", F.explode(F.sequence(bucket(F.col(start), F.col("__l")), bucket(F.col(end), F.col("__l")))))
    used = F.broadcast(s.select(F.col("__l").alias("__level")).distinct())
    p = points.crossJoin(used).withColumn("__b", bucket(F.col(at), F.col("__level")))
    return p.join(s, (p["__level"] == s["__l"]) & (p["__b"] == s["__b"]) & (p[at] >= s[start]) & (p[at] < s[end])).drop("__l", "__level", "__b")
