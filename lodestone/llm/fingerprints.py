"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A text is lower-cased and split at white space; each run of five consecutive words is hashed to 63 bits. The sketch keeps every
distinct hash below a fixed fraction of the hash range, FRACTION. A short text, of which that would leave little, keeps all below a
larger fraction, the largest power of a half that keeps about FEW hashes at most. A sketch carries its limit, and whatever compares
or merges two sketches goes by the lower limit, so that a hash is kept in one exactly if it is kept in the other: the union of two
sketches is a sketch of the union of their shingles, and the share of a small text's hashes that a large one holds estimates
containment, without a bias by length.

Defined cases: null text counts as empty; an empty text (no words) has a sketch without hashes, and two of these have likeness 1; a
text of one to four words is one shingle; repeated shingles count once. Containment of a text without words is 1; of one with words,
none of whose hashes lies below the common limit, it is null: the sketch is too thin to say. Likeness where neither has a hash below
the common limit is 1 for equal sketches, otherwise 0. Rows that share a doc_id, or have none, are next to each other by their texts,
and are in one range of the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, partitions

WORDS = 5
FRACTION = 1 / 8
FEW = 48
_WHOLE = 2**63 - 1


def _limit(fraction: float) -> int:
    return min(_WHOLE, int(fraction * 2**63))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The 63-bit hashes of the text's shingles, repeats included: array<bigint>."""
    spoken = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(spoken, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(words)]), 1))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        return F.when(n >= words, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, shingles)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION, few: int = FEW) -> Column:
    """The sketch of a text: struct<limit: bigint, hashes: array<bigint>>, the hashes ascending."""

    def keep(h: Column) -> Column:
        limit = F.when(F.size(h) <= few, F.lit(_WHOLE))
        part = 1 / 2
        while part > fraction:
            limit = limit.when(F.size(h) * part <= few, F.lit(_limit(part)))
            part /= 2
        return let(limit.otherwise(F.lit(_limit(fraction))), lambda top: F.struct(top.alias("limit"), F.array_sort(F.filter(h, lambda x: x <= top)).alias("hashes")))

    return let(F.array_distinct(shingle_hashes(text, words)), keep)


def _below(a: Column, limit: Column) -> Column:
    return F.when(a["limit"] == limit, a["hashes"]).otherwise(F.filter(a["hashes"], lambda x: x <= limit))


def _at_one_limit(a: Column, b: Column, body) -> Column:
    """body of the hashes of two sketches below the lower of their limits."""
    return let(F.least(a["limit"], b["limit"]), lambda top: let(F.struct(_below(a, top).alias("a"), _below(b, top).alias("b")), lambda both: body(both["a"], both["b"])))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, at the lower limit."""
    return F.struct(F.least(a["limit"], b["limit"]).alias("limit"), _at_one_limit(a, b, lambda x, y: F.array_sort(F.array_union(x, y))).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches, 0 to 1."""

    def share(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, (a == b).cast("double")).otherwise(n / (F.size(x) + F.size(y) - n)))

    return _at_one_limit(a, b, share)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an a without words, null where a's sketch is too thin to say."""
    return F.when(F.size(a["hashes"]) == 0, F.lit(1.0)).otherwise(_at_one_limit(a, b, lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))))


def to_string(a: Column) -> Column:
    """The sketch as text: the eight bytes of its limit and of each hash, ascending, in base 64."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(F.concat(F.array(a["limit"]), a["hashes"]), lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def _bucket(value: Column, splits: Column) -> Column:
    """The number of splits (array<bigint>, ascending) below value, by binary search."""
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(22))])
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump <= F.size(splits)) & (F.get(splits, at + jump - 1) < value), at + jump).otherwise(at))


def with_successor(df: DataFrame, key: str, tie: str, columns: list[str], **derived: Column) -> DataFrame:
    """df's rows with further columns ``derived`` and a struct ``successor`` of the given columns of the next row by descending key,
    after the last the first.

    A distributed lead(): keys are split at approximate quantiles into four ranges a shuffle partition; the rows of each range's
    largest key are also sent to the range above, behind its own rows, so that every range sees its successor in one shuffle
    of the table. Derived columns are computed behind that shuffle. Null keys come last; equal keys are ordered by the tie column. A
    single row succeeds itself.
    """
    n = 4 * partitions(df.sparkSession)
    quantiles = F.coalesce(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n), F.array().cast("array<bigint>"))
    known = df.agg(F.array_sort(F.array_distinct(F.filter(F.array_append(quantiles, F.max(key)), lambda x: x.isNotNull()))).alias("__splits"))
    splits, at = F.col("__splits"), F.col("__at")
    above = F.when(at >= F.size(splits) - 1, 0).otherwise(at + 1)
    own, guest = (F.struct(c.alias("range"), F.lit(g).alias("guest")) for c, g in ((at, False), (above, True)))
    is_last = F.coalesce(F.get(splits, at) == F.col(key), F.lit(False))
    df = df.crossJoin(F.broadcast(known)).withColumn("__at", F.coalesce(_bucket(F.col(key), splits), F.lit(0)))
    df = df.withColumn("__place", F.explode(F.when(is_last, F.array(own, guest)).otherwise(F.array(own)))).drop("__splits", "__at")
    df = df.withColumns({"__range": F.col("__place.range"), "__guest": F.col("__place.guest")}).drop("__place")
    df = df.repartition(partitions(df.sparkSession), "__range").withColumns(derived)
    order = Window.partitionBy("__range").orderBy("__guest", F.col(key).desc_nulls_last(), F.col(tie))
    value = F.struct(*columns)
    return df.withColumn("successor", F.coalesce(F.lead(value).over(order), F.first(value).over(order))).where(~F.col("__guest")).drop("__range", "__guest")


def edited_pairs(documents: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Each document's sketch, that of its edited text and that of the next document; see the contract of op1.

    Only doc_id and text are read. Rows that repeat a doc_id each keep a result of their own.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_successor(rows, "doc_id", "text", ["text", "own"], own=sketch(F.col("text"), words, fraction))
    n = F.char_length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - part), F.substr(F.col("successor.text"), F.lit(1), part))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "own", F.col("successor.own").alias("other"), edited.alias("edited"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "other", sketch(F.col("edited"), words, fraction).alias("changed"))


def op1(documents: DataFrame) -> DataFrame:
    """The columns of the op1 contract, and the containments beside them."""
    own, changed, other = map(F.col, ("own", "changed", "other"))
    return edited_pairs(documents).select(
        "doc_id", "n_chars", "edited_sha256", to_string(own).alias("fingerprint"), to_string(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, other).alias("near_next"),
        containment(own, changed).alias("held_by_edited"), containment(own, other).alias("held_by_next"), F.size(own["hashes"]).cast("bigint").alias("n_hashes"),
    )


def merge_all(sketches: list[Column]) -> Column:
    return reduce(merge, sketches)
