"""Byte-level BPE encoding and decoding with a local rank file.

The library encodes each match of the splitting pattern separately. Long texts are cut beforehand at places where no match can
cross: before a blank that is followed by something other than white space. (A match holds a blank only at its start or in a run
of white space, and a run that ends in such a blank leaves it to the next match.) The ids of the parts, joined, are those of the
text, and memory stays bounded. Parts without adjoining white space take an equivalent pattern without look-ahead, which the
library runs faster. Very long runs of white space, at which the library's matching would overflow its stack, are cut out as the
one match that they are: the whole run at the end of a text, or else all of it but the last character.

Defined cases: null text counts as empty; an empty text has no ids and decodes to no bytes. Text that looks like a special token
is ordinary text unless that token is passed in. Decoding concatenates raw bytes and never repairs invalid UTF-8.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import appended, texts

#: Characters of a long text that are encoded at once.
PART = 1_000_000
SAFE = re.compile(r" (?=\S)")
PAIR = re.compile(r"\s\s")
#: White space as the library has it (the Unicode property), in runs too long to be left to its matching.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: The alternatives that treat runs of white space; where no two white-space characters adjoin, they match single ones.
RUNS = r"|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file (base64 token and rank a line), or of a tokenizer's JSON file with a byte-level vocabulary."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about the given number of characters, cut at safe places only; a stretch without any stays whole."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        ranks = read_ranks(path)
        self.special = dict(special)
        make = lambda pattern: tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = self.simple = make(pattern)
        self.whole = functools.cache(lambda: make(r"(?s:.+)"))
        self.runs = pattern.endswith(RUNS)
        if self.runs:
            self.simple = make(pattern.removesuffix(RUNS) + r"|\s")
        self.token = [b""] * (1 + max([*ranks.values(), *self.special.values()], default=-1))
        for token, rank in ranks.items():
            self.token[rank] = token
        for token, rank in self.special.items():
            self.token[rank] = token.encode()

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if not any(s in text for s in self.special):
            return b"".join(self._ordinary(text))
        parts = re.split(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})", text)
        return b"".join(x for k, part in enumerate(parts) for x in ([np.uint32(self.special[part]).tobytes()] if k % 2 else self._ordinary(part)))

    def _ordinary(self, text: str) -> Iterator[bytes]:
        """The ids of a text without special tokens, in parts."""
        at, blanks = 0, BLANK.finditer(text) if self.runs else ()
        for m in blanks:
            end = m.end() if m.end() == len(text) else m.end() - 1
            yield from self._matched(text[at : m.start()])
            yield np.array(self.whole().encode_ordinary(text[m.start() : end]), dtype="<u4").tobytes()
            at = end
        yield from self._matched(text[at:])

    def _matched(self, text: str) -> Iterator[bytes]:
        for part in safe_parts(text):
            ids = (self.full if PAIR.search(part) else self.simple).encode_ordinary(part)
            yield np.array(ids, dtype="<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return Codec(path, pattern, special)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its text column as array<int>; path must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            got = [c.encode(t) for t in texts(batch, text)]
            ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype("int32")
            yield appended(batch, **{ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), dtype="<i4")))})

    return df.mapInArrow(run, _with(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """df with the bytes of its id lists as a binary column; null lists decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column(ids)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            yield appended(batch, **{raw: pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.binary())})

    return df.mapInArrow(run, _with(df, raw, T.BinaryType()))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's schema with a further column; ValueError if it has one of that name."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {name}")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def op2(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of the op2 contract: each text is encoded, its ids are decoded, and only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, encoded, decoded = [], [], []
            for x in batch.column("text"):
                ids = np.frombuffer(c.encode(x.as_py() or ""), "<u4").tolist()
                n.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
