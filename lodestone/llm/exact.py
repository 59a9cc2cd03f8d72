"""Exact dedup by content sort.

Texts are normalised (A-Z to lower case) and sorted by their bytes over the whole cluster: splitters from a sample, weighted by bytes,
cut the order of (normalised bytes, doc_id) into ranges, one a shuffle partition; each partition is sorted externally, which places
equal texts side by side; each row is compared in full with the one before it. The doc_id in the order lets a group of copies
that holds much of the table spread over many partitions. Runs that touch a partition's border are joined across it, again by
comparing texts, so the driver only sees counts and ids for each border. A splitter is the first PREFIX bytes of a text if these tell it from
the sampled text before it, and the whole text if not; there are fewer of these than ranges.

Defined cases: null text counts as empty, and all empty texts are equal; repeated rows are copies of each other and equal doc_ids
are kept or dropped together; null doc_ids sort below all others, and such a row stays only if its whole group has none; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, partitions

PREFIX = 64
#: Sampled rows a range.
SAMPLE = 60
LOWEST = -(2**63)

SORTED = "doc_id bigint, part int, digest binary, norm binary"
RUNS = "doc_id bigint, digest binary, part int, run int, size bigint, least bigint, most bigint, border binary, first boolean, last boolean"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return (text or "").encode().lower()


def _id(doc_id: int | None) -> int:
    return LOWEST if doc_id is None else doc_id


def splitters(documents: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """At most ranges - 1 places in the order that cut the table's bytes evenly; SAMPLE short keys a range reach the driver."""
    if ranges < 2:
        return []
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    whole = documents.agg(F.sum(size)).first()[0]
    if not whole:
        return []

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normalise(t) for t in batch.column("text").to_pylist()]
            columns = [[n[:PREFIX] for n in norms], [hashlib.sha256(n).digest() for n in norms], [_id(d) for d in batch.column("doc_id").to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()))], names=["p", "d", "i"])

    some = documents.where(F.rand(7) * whole < size * (ranges * SAMPLE)).mapInArrow(keys, "p binary, d binary, i bigint")
    found = sorted((bytes(r.p), bytes(r.d), r.i) for r in some.collect())
    cuts = sorted({i * len(found) // ranges for i in range(1, ranges)} - {0}) if found else []
    short = [(found[k][0], LOWEST) for k in cuts if found[k][0] != found[k - 1][0]]
    deep = [found[k] for k in cuts if found[k][0] == found[k - 1][0]]
    if not deep:
        return sorted(set(short))
    wanted = {d for _, d, _ in deep}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = {d: n for n in map(normalise, batch.column("text").to_pylist()) if (d := hashlib.sha256(n).digest()) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(list(norms), pa.binary()), pa.array(list(norms.values()), pa.binary())], names=["d", "norm"])

    norm = {bytes(r.d): bytes(r.norm) for r in documents.mapInArrow(texts, "d binary, norm binary").groupBy("d").agg(F.min("norm").alias("norm")).collect()}
    return sorted({*short, *((norm[d], i) for _, d, i in deep)})


def _dealt(splits: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            norms = [normalise(t) for t in batch.column("text").to_pylist()]
            parts = [bisect.bisect_right(splits, (n, _id(d))) for n, d in zip(norms, ids)]
            columns = [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array([hashlib.sha256(n).digest() for n in norms], pa.binary()), pa.array(norms, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "norm"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the size and the extreme doc_ids of their run of equal texts; a run's ids are held, its text once."""
    ids: list = []
    text = digest = part = None
    run, out = 0, []

    def close(last: bool) -> None:
        some = [i for i in ids if i is not None]
        low, high = (min(some), max(some)) if some else (None, None)
        edge = text if run == 0 or last else None
        for k, i in enumerate(ids):
            out.append((i, digest, part, run, len(ids), low, high, edge if k == 0 else None, run == 0, last))

    def batch_of(rows: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
        names = ("doc_id", "digest", "part", "run", "size", "least", "most", "border", "first", "last")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    for batch in batches:
        norm = batch.column("norm")
        digests, parts = batch.column("digest").to_pylist(), batch.column("part")
        for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            here = norm[k].as_py()
            if text is None:
                text, digest, part = here, digests[k], parts[k].as_py()
            elif here != text:
                close(False)
                ids, text, digest, run = [], here, digests[k], run + 1
            ids.append(doc_id)
        if out:
            yield batch_of(out)
            out = []
    if text is not None:
        close(True)
        yield batch_of(out)


def _joined(borders: list, equal: set[int]) -> list[tuple[int, int, int, int | None, int | None]]:
    """(part, run, size, least, most) of runs that continue across borders; equal: parts whose first text is the last of the part before."""
    out, chain = [], []

    def close() -> None:
        if len(chain) > 1:
            low = [r.least for r in chain if r.least is not None]
            high = [r.most for r in chain if r.most is not None]
            out.extend((r.part, r.run, sum(x.size for x in chain), min(low, default=None), max(high, default=None)) for r in chain)

    for r in sorted(borders, key=lambda r: (r.part, r.run)):
        if not (chain and r.first and r.part in equal):
            close()
            chain = []
        chain.append(r)
    close()
    return out


def copies(documents: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text), size of its group of equal texts, and the least and the most doc_id of it."""
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    splits = splitters(rows, partitions(spark))
    laid = rows.mapInArrow(_dealt(splits), SORTED).repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("norm", "doc_id")
    runs = checkpointed(laid.mapInArrow(_compared, RUNS))
    edges = runs.where("border is not null")
    # Empty ranges hold no runs: the parts that have rows are numbered by the driver, which sees at most two short rows a part.
    borders = edges.select("part", "run", "size", "least", "most", "first", "last").collect()
    parts = sorted({r.part for r in borders})
    if len(parts) > 1:
        before = spark.createDataFrame(list(zip(parts[1:], parts)), "part int, prior int")
        first = edges.where("first").join(F.broadcast(before), "part").select("part", "prior", F.col("border").alias("here"))
        last = edges.where("last").select(F.col("part").alias("prior"), F.col("border").alias("there"))
        equal = {r.part for r in first.join(last, "prior").where("here = there").select("part").collect()}
        if fixed := _joined(borders, equal):
            mended = spark.createDataFrame(fixed, "part int, run int, n bigint, low bigint, high bigint")  # at most two rows a part
            runs = runs.join(F.broadcast(mended), ["part", "run"], "left").withColumns({"size": F.coalesce("n", "size"), "least": F.coalesce("low", "least"), "most": F.coalesce("high", "most")})
    return runs.select("doc_id", "digest", "size", "least", "most")


def deduplicate(documents: DataFrame, keep: str = "least") -> DataFrame:
    """One row for each document: doc_id, keep_id (the least, or else the most, of its group), group_size, kept, text_sha256."""
    keep_id = F.col("least" if keep == "least" else "most")
    return copies(documents).select("doc_id", keep_id.alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10(documents: DataFrame) -> DataFrame:
    """The columns of the op10 contract, in which the largest doc_id stays."""
    return deduplicate(documents, keep="most")
