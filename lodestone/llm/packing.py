"""Packing documents into token sequences: first-fit decreasing with a tournament tree, in randomised groups.

Each document's ids, with a separator behind them, are cut at multiples of the capacity. Full pieces are sequences of their own;
what remains of a document is packed with other remainders, longest first, each into the first sequence of its group that has
room, which a tournament tree over the free capacities finds in logarithmic time. Groups are random and of bounded size, so that
one task never holds more than a group, whatever keys repeat; the padding lost to grouping is at most one sequence a group.

Defined cases: null text counts as empty, and an empty text is its separator alone; repeated rows and equal doc_ids are packed
row by row; an empty table gives no rows; the text of the special token inside a document is that token's id, as the tokenizer
itself would have it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import codec
from lodestone.llm.common import checkpointed, texts

CAPACITY = 1024
#: Documents a group; bounds a task's memory.
GROUP = 10_000
SEED = 20240229

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Tournament:
    """Free capacities of bins in a complete binary tree whose nodes hold the larger of their children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the first bin with room; returns the bin and the room it had. There is always room in the last bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        had = best[at]
        best[at] = had - size
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return leaf, had


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """The bin and the offset in it of each size; equal sizes keep their order."""
    tree, out = Tournament(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        leaf, had = tree.place(sizes[i])
        out[i] = leaf, capacity - had
    return out


def tokenised(documents: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...], separator: int, capacity: int) -> DataFrame:
    """doc_id, number of ids with the separator, and the CRC-32 of each piece's ids."""
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern, special)
        for batch in batches:
            n, crcs = [], []
            for text in texts(batch, "text"):
                ids = c.encode(text) + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "crcs"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, crcs array<bigint>")


def pack_group(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The pieces of one group's documents; sequence ids count from the group's own range of 2**31."""
    frame = frame.sort_values("row", kind="stable")
    base = int(frame["grp"].iloc[0]) << 31
    docs, n, crcs = frame["doc_id"].tolist(), frame["n"].tolist(), frame["crcs"].tolist()
    rest = [x % capacity for x in n]
    some = [i for i, r in enumerate(rest) if r]
    placed = dict(zip(some, first_fit_decreasing([rest[i] for i in some], capacity), strict=True))
    alone = 1 + max((b for b, _ in placed.values()), default=-1)
    out = []
    for i, tokens in enumerate(n):
        for k in range(tokens // capacity):
            out.append((docs[i], k * capacity, capacity, int(crcs[i][k]), tokens, base + alone, 0))
            alone += 1
        if i in placed:
            leaf, offset = placed[i]
            out.append((docs[i], tokens - rest[i], rest[i], int(crcs[i][-1]), tokens, base + leaf, offset))
    got = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return got.astype({"doc_id": "Int64"})


def pack(documents: DataFrame, path: str, pattern: str, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),), separator: int = 0, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence of at most capacity ids."""
    rows = checkpointed(tokenised(documents, path, pattern, special, separator, capacity))
    groups = max(1, -(-rows.count() // group))
    row = rows.withColumn("row", F.monotonically_increasing_id())  # the checkpoint fixes it
    return row.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(groups))).groupBy("grp").applyInPandas(lambda frame: pack_group(frame, capacity), PIECES)


def op7(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of the op7 contract."""
    return pack(documents, path, pattern)
