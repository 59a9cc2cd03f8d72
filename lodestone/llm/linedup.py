"""Line dedup by content-defined chunks of lines.

A text is cut into lines and the lines into chunks: a chunk ends behind a line where a rolling hash over the last two line hashes
falls into one half of its range, but not before it has two lines. Where MOST lines come without such an end, it is where the rolling
hash is greatest. Where chunks end thus depends on the lines around, not on where they stand, and a passage moved to another place is cut
as before. A text is cut in CUTS ways at once, each with halves of its own, so that short passages have a whole chunk in one or another.
Chunks of two lines or more that occur again anywhere in the table are removed but for their first occurrence (the smallest doc_id,
then the smallest text hash and place).

Of a repeated passage the lines before its first and behind its last end are not a whole chunk. They go as well: where a removed chunk
has the same lines before or behind it as its first occurrence has, byte for byte, up to MOST lines and REACH characters a side and to a
line that is a chunk of its own, these are removed with it (unless a whole chunk is there in both, which goes by itself). A line that
goes always has an equal one at an earlier place, so one copy of each stays.

Beside the method, a line of WORDS words or more is a chunk of its own (None: no line is), because passages of over fifty words are to
be found however many lines they have. A text none of whose chunks is removed stays byte for byte.

Repeats are found by 128-bit hashes, counted with partial sums. Texts of possible repeats (a fixed-size bitmap of the repeated
hashes finds them in further scans; what it lets through besides only costs rows) are then grouped as they are, which compares
their bytes: only if all chunks of a hash are one text are they removed. Rows of very frequent chunks are not moved to meet what is
proven of these.

Defined cases: null text stays null and takes no part; empty lines count as lines, but chunks without any word are never removed;
rows that repeat both doc_id and text share their decisions, so a chunk's first occurrence stays in all of them; null doc_ids
sort before others. A text all of whose lines are removed becomes empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import attached, checkpointed, free_name, mapped, quoted

MOST = 16
CUTS = 3
WORDS: int | None = 50
REACH = 4096
BITMAP = 26
_M = (1 << 64) - 1
_PLACE = "doc_id bigint, th bigint, start int, stop int, h bigint, g bigint, above bigint, below bigint"
_TEXT = ", chunk string, before array<string>, after array<string>"


def _line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def is_long(line: str) -> bool:
    """Whether a line has WORDS words or more."""
    return WORDS is not None and len(line) >= 2 * WORDS - 1 and len(line.split(None, WORDS)) >= WORDS


def rolling(lines: list[str]) -> list[int]:
    """The hash of each line and the one before it."""
    out, before = [], 0
    for line in lines:
        here = _line_hash(line)
        mixed = (before * 0x9E3779B97F4A7C15 + here) & _M
        out.append((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 & _M)
        before = here
    return out


def chunks(hashes: list[int], long: list[bool], cut: int = 0) -> Iterator[tuple[int, int]]:
    """The first line of each chunk and the one behind its last, in one of the ways to cut."""
    start, bit = 0, 1 << (40 + cut)
    for i, alone in enumerate(long):
        if alone:
            if start < i:
                yield start, i
            yield i, i + 1
            start = i + 1
            continue
        stop = i + 1 if i > start and hashes[i] & bit else 0
        if not stop and i + 1 - start >= MOST:
            stop = max(range(start + 1, i + 1), key=lambda j: (hashes[j], j)) + 1
        if stop:
            yield start, stop
            start = stop
    if start < len(long):
        yield start, len(long)


def candidates(lines: list[str], long: list[bool] | None = None) -> dict[tuple[int, int], tuple]:
    """The chunks of all ways to cut that may be removed, with those above and below them (None for none)."""
    long = [is_long(line) for line in lines] if long is None else long
    hashes, out = rolling(lines), {}
    said = [bool(line) and not line.isspace() for line in lines]
    for cut in range(CUTS):
        spans = [x if (x[1] - x[0] >= 2 or long[x[0]]) and True in said[x[0] : x[1]] else None for x in chunks(hashes, long, cut)]
        for above, here, below in zip([None, *spans], spans, [*spans[1:], None]):
            if here and here not in out:
                out[here] = (above, below)
    return out


def _near(lines: list[str], long: list[bool], numbers: range) -> list[str]:
    """The lines of these numbers, REACH characters at most, before one that is long."""
    out, size = [], 0
    for k in numbers:
        size += len(lines[k]) + 1
        if size > REACH or long[k]:
            break
        out.append(lines[k])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashed(text: str | None) -> tuple[list[str], list[bool], dict, dict]:
    """The lines of a text, whether each is long, its candidates, and two hashes of each of these."""
    lines = (text or "").split("\n")
    long = [is_long(line) for line in lines]
    found = candidates(lines, long)
    data, hashes = memoryview((text or "").encode("utf-8", "surrogatepass")), {}
    ends = list(itertools.accumulate((len(line.encode("utf-8", "surrogatepass")) + 1 for line in lines), initial=0))
    for start, stop in found:
        both = xxhash.xxh3_128_intdigest(data[ends[start] : ends[stop] - 1])
        hashes[start, stop] = _signed(both >> 64), _signed(both & _M)
    return lines, long, found, hashes


def hashes_of(documents: DataFrame) -> DataFrame:
    """The hashes h and g of every candidate chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for text in batch.column("text").to_pylist() if text for x in _hashed(text)[3].values()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["h", "g"])

    return documents.select("text").mapInArrow(run, "h bigint, g bigint")


def places(documents: DataFrame, bitmap, texts: bool) -> DataFrame:
    """A row for each candidate chunk that the bitmap has: its document, lines and hashes, the first hashes of the candidates above and
    below it (0 for none) and, if asked for, its text and the lines next to it, nearest first."""
    fields = T._parse_datatype_string(_PLACE + (_TEXT if texts else ""))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.string())] * 2][: len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            rows = []
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text"))):
                lines, long, found, hashes = _hashed(text)
                for (start, stop), (h, g) in hashes.items():
                    if bits[(h & _M) >> (64 - BITMAP + 3)] >> ((h >> (64 - BITMAP)) & 7) & 1:
                        above, below = (hashes[x][0] if x else 0 for x in found[start, stop])
                        row = (doc_id, th, start, stop, h, g, above, below)
                        if texts:
                            row += ("\n".join(lines[start:stop]), _near(lines, long, range(start - 1, max(-1, start - 1 - MOST), -1)), _near(lines, long, range(stop, min(len(lines), stop + MOST))))
                        rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=fields.names)

    return documents.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, fields)


def bitmap_of(repeated: DataFrame):
    """A broadcast bitmap of 2**BITMAP bits, with those of the hashes h set; at most 2**BITMAP / 32 words reach the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP)
    words = repeated.select(F.shiftrightunsigned(bit, 5).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP}) & 31 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 5), "<u4")
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype("<u4")
    return repeated.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and the chunks to remove, with the lines next to their first occurrences, for each text that has any."""
    repeated = checkpointed(hashes_of(documents).groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"))
    bitmap = bitmap_of(repeated)
    first = F.min(F.struct("doc_id", "th", "start", "above", "below", "before", "after")).alias("first")
    texts = places(documents, bitmap, True).groupBy("h", "g", "chunk").agg(first, F.count("*").alias("n"))
    proven = texts.groupBy("h", "g").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")).where("texts = 1 and n > 1")
    proven = checkpointed(proven.select("h", F.col("g").alias("of"), "first"))
    rows = checkpointed(places(documents, bitmap, False))
    same = F.struct("doc_id", "th", "start").eqNullSafe(F.struct("first.doc_id", "first.th", "first.start"))
    gone = attached(rows, proven, "h").where((F.col("g") == F.col("of")) & ~same)
    # Equal candidates next to equal chunks go by themselves.
    lines = [F.when((F.col(own) == 0) | (F.col(own) != F.col(f"first.{own}")), F.col(f"first.{side}")).alias(side) for own, side in (("above", "before"), ("below", "after"))]
    return gone.select("doc_id", "th", F.struct("start", "stop", *lines).alias("gone")).groupBy("doc_id", "th").agg(F.collect_set("gone").alias("gone"))


def without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int]:
    """The text without the chunks and the lines next to them that are as those next to their first occurrences, and the number of lines gone."""
    if text is None or not gone:
        return text, 0
    lines = text.split("\n")
    stay = [True] * len(lines)
    for one in gone:
        start, stop = one["start"], one["stop"]
        for other in one["before"] or ():
            if not start or lines[start - 1] != other:
                break
            start -= 1
        for other in one["after"] or ():
            if stop == len(lines) or lines[stop] != other:
                break
            stop += 1
        stay[start:stop] = [False] * (stop - start)
    return "\n".join(itertools.compress(lines, stay)), len(lines) - sum(stay)


def remove_repeats(documents: DataFrame, counter: str | None = None) -> DataFrame:
    """documents with repeated chunks removed from text, and, if named, the number of lines removed in another column."""
    left = documents.columns
    th, gone, of, on = (free_name(documents, x) for x in ("th", "gone", "of", "on"))
    found = removals(documents).select(F.col("doc_id").alias(of), F.col("th").alias(on), F.col("gone").alias(gone))
    rows = documents.withColumn(th, F.xxhash64("text"))
    rows = rows.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(th) == F.col(on)), "left").select(*[quoted(c) for c in left], gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = left.index("text")
        for batch in batches:
            got = [without(t, g) for t, g in zip(batch.column(at).to_pylist(), batch.column(len(left)).to_pylist())]
            columns = [pa.array([g[0] for g in got], pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(left)])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([g[1] for g in got], pa.int64())] if counter else []), names=left + ([counter] if counter else []))

    return mapped(rows, run, T.StructType(documents.schema.fields + ([T.StructField(counter, T.LongType())] if counter else [])))


def op4(documents: DataFrame) -> DataFrame:
    """doc_id, the text without repeated chunks, and how many lines were removed, of every document."""
    return remove_repeats(documents.select("doc_id", "text"), "removed")


def with_fresh_lines(documents: DataFrame) -> DataFrame:
    """documents with repeats removed from text and, where it has a column n_chars, that brought up to date."""
    out = remove_repeats(documents)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
