"""Near-duplicate groups by SimHash, with pigeonring filtering of the candidates.

A text's fingerprint has a bit for each of 64 places: 1 if more than half of the hashes of its word shingles have it set. Equal
fingerprints are one from the start. Of the others, two link at four or fewer differing bits.

Candidates: the 64 bits are a ring of eight segments of eight bits. Of any two fingerprints with at most four differing bits, the
pigeonring principle gives a start from which each run of consecutive segments differs in at most half a bit a segment: none in
the first segment, one in the first two, one in the first three. So for every start the first three segments make a key of 24
bits; each fingerprint is filed under its own key, and under those with one of its zero bits in the second or third segment set.
Two that link share a key: the one with the zero finds the other. Those that share a key are compared in full, and a run of
equal keys is reduced to a spanning forest of its links, so that dense groups give no more rows than they have members. Keys with
very many rows are dealt to several tasks in pairs of blocks.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; repeated rows and equal texts share a component; a null doc_id never names a component unless all its
members are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attached, checkpointed, free_name, partitions
from lodestone.llm.components import components

WORDS = 4
DIFFER = 4
SEGMENTS, BITS, CHAIN = 8, 8, 3
#: Rows of a key from which it is dealt out in blocks, and the rows of a block.
HOT = 12_000
#: Part of the blocks of all hot keys from which a key's are broadcast.
HOTTEST = 1 / 1000
#: Members of a run of equal keys up to which its links are listed singly.
SMALL = 12


def fingerprint(text: str, words: int = WORDS, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned 64-bit number."""
    spoken = text.encode().lower().split()
    if not spoken:
        return 0
    joined, digest = b" ".join(spoken), xxhash.xxh64_intdigest
    if len(spoken) < words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, spoken), np.int64, len(spoken)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(spoken) - words + 1].tolist()
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed 64-bit number, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t or "", words) for t in batch.column("text").to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(got)], names=["doc_id", "th", "fp"])

    return documents.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def _own_keys(fp, start: int):
    turned = F.shiftleft(fp, BITS * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - BITS * start)) if start else fp
    return F.shiftrightunsigned(turned, 64 - BITS * CHAIN).bitwiseOR(F.lit(start << (BITS * CHAIN))).cast("int")


def filed(distinct: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its own eight keys and those with one more bit in the second or third segment."""
    own = distinct.select("fp", F.explode(F.array(*[_own_keys(F.col("fp"), s) for s in range(SEGMENTS)])).alias("own"))
    flips = F.array(*[F.lit(1 << i) for i in range(BITS * (CHAIN - 1))])
    more = F.transform(F.filter(flips, lambda bit: F.col("own").bitwiseAND(bit) == 0), lambda bit: F.col("own").bitwiseOR(bit))
    return own.select(F.explode(F.concat(F.array("own"), more)).alias("key"), "fp")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, differ: int = DIFFER) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: member and root, without the roots."""
    n = len(fps)
    label = np.arange(n)
    block = max(1, 4_000_000 // n)
    while True:
        before = label.copy()
        for i in range(0, n, block):
            near = popcount(fps[i : i + block, None] ^ fps[None, :]) <= differ
            least = np.where(near, label[None, :], n).min(axis=1)
            np.minimum.at(label, label[i : i + block].copy(), least)
            label[i : i + block] = np.minimum(label[i : i + block], least)
        label = label[label]
        if (label == before).all():
            break
    member = label != np.arange(n)
    return fps[member], fps[label[member]]


def linked(keys: np.ndarray, fps: np.ndarray, differ: int = DIFFER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among rows that are sorted by key, as (member, member) arrays."""
    out = []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    length = np.repeat(lengths, lengths)
    few = (length > 1) & (length <= SMALL)
    k, f = keys[few], fps[few]
    for d in range(1, SMALL):
        if len(k) <= d:
            break
        hit = (k[d:] == k[:-d]) & (f[d:] != f[:-d])
        hit[hit] = popcount(f[d:][hit] ^ f[:-d][hit]) <= differ
        if hit.any():
            out.append((f[d:][hit], f[:-d][hit]))
    for i in np.flatnonzero(lengths > SMALL):
        run = np.unique(fps[starts[i] : starts[i] + lengths[i]])
        if len(run) > 1:
            out.append(forest(run, differ))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys over a partition sorted by key; a run may span batches."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def emit(keys, fps):
        for a, b in linked(keys, fps):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)))
        fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(keys):
            last = np.searchsorted(keys, keys[-1])
            yield from emit(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    yield from emit(keys, fps)


def dealt(rows: DataFrame, distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """The filed rows with hot keys dealt to pairs of blocks, each pair under a key of its own.

    A key holds its own fingerprints and those of up to sixteen keys beside it, so a bound on the first, counted over eight rows
    a fingerprint, bounds the second. The hot keys are at most 17 * 17 / hot of all rows and are joined like any table, but for
    those that hold so many rows that there can only be few of them; these are broadcast.
    """
    own = distinct.select(F.explode(F.array(*[_own_keys(F.col("fp"), s) for s in range(SEGMENTS)])).alias("key"))
    many = own.groupBy("key").count().where(F.col("count") > hot // 17)
    beside = F.concat(F.array("key"), *[F.array(F.col("key").bitwiseXOR(F.lit(1 << i))) for i in range(BITS * (CHAIN - 1))])
    many = many.select(F.explode(beside).alias("key"), "count").groupBy("key").agg((F.sum("count") / hot + 1).cast("int").alias("blocks"))
    many = checkpointed(many.select(F.col("key").cast("bigint").alias("key"), "blocks"))
    rows = rows.select(F.col("key").cast("bigint").alias("key"), "fp")
    if many.isEmpty():
        return rows
    n, own_block = F.col("blocks"), F.pmod(F.xxhash64("fp"), F.col("blocks").cast("bigint"))
    # A row of the table has as many blocks as hot rows, so a part of all blocks is a part of all rows of hot keys.
    most = many.agg(F.sum("blocks")).first()[0] * HOTTEST
    few = F.broadcast(many.where(n > most))
    joined = rows.join(few, "key").unionByName(rows.join(few, "key", "left_anti").join(many.where(n <= most), "key", "left"))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own_block, j.cast("bigint")) * n + F.greatest(own_block, j.cast("bigint")))
    places = F.when(n.isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)
    return joined.select("key", "fp", F.explode(places).alias("place")).select((F.col("key") * F.lit(2**32) + F.col("place")).alias("key"), "fp")


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the fingerprints of distinct (column fp, each once)."""
    n = partitions(distinct.sparkSession)
    rows = dealt(filed(distinct), distinct, hot).repartition(n, "key").sortWithinPartitions("key")
    return rows.mapInArrow(_runs, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (a hash of the text), fp, root (a fingerprint that names the component) and component_id (the smallest doc_id
    reachable by links) of every row."""
    rows = checkpointed(fingerprints(documents, words))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    linked = checkpointed(roots.union(roots.select("root", "root").distinct()).toDF("fp", "root").join(distinct, "fp"))
    named = attached(linked, linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return attached(rows, named.union(alone), "fp").select("doc_id", "th", "fp", "root", "component_id")


def op8(documents: DataFrame) -> DataFrame:
    """The columns of the op8 contract."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay when one row of each component does: the one that names it, by its doc_id.

    Of several rows with that doc_id, one of the least text hash stays; rows without doc_id stay only where their component has
    no other.
    """
    doc_id, th = free_name(documents, "kept"), free_name(documents, "th")
    named = near_duplicates(documents).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    kept = checkpointed(named.groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("k")).select(F.col("k.doc_id").alias(doc_id), F.col("k.th").alias(th), "k.n"))
    stay = documents.join(kept.drop("n"), F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(th)), "left_semi")
    if kept.where("n > 1").isEmpty():
        return stay
    return stay.withColumn(th, F.xxhash64("text")).dropDuplicates(["doc_id", th]).drop(th)
