"""op2 against the tokenizer library on whole texts, and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import bpe
from lodestone.llm.queries import MULTI, PATTERN

from .conftest import CASES


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2(df, MULTI, PATTERN).collect()), key=str)


def test_whole_table(library, whole):
    assert got(whole[1]) == expected(library, whole[0])


def test_cases(library, cases):
    assert got(cases) == expected(library, CASES)


def test_empty_table(documents):
    assert got(documents([])) == []


def test_safe_parts_keep_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 7)
    rng, codec = random.Random(5), bpe.Codec(MULTI, PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bé", " ", "  ", "\n", " \n", "'ll", "12", "!?", " ", "\x1c", "東", "́", "\U0001f600"]) for _ in range(40))
        assert "".join(bpe.safe_parts(text, 7)) == text
        parts = [codec.encode(p) for p in bpe.safe_parts(text, 7)]
        assert b"".join(parts) == b"".join(int(x).to_bytes(4, "little") for x in library.encode_ordinary(text))


def test_long_runs_of_white_space(library, monkeypatch):
    """Cut out as one match, they give the library's ids; runs at which the library breaks are encoded too."""
    rng, codec = random.Random(6), bpe.Codec(MULTI, PATTERN)
    monkeypatch.setattr(bpe, "BLANK", bpe.re.compile(bpe.BLANK.pattern.replace("10000", "3")))
    for _ in range(600):
        text = "".join(rng.choice(["a", "é1", "!", " ", "   ", "\n", "\n\n\n", "\t \u3000\x85", "\x1c", "\u2028"]) for _ in range(14))
        assert codec.encode(text) == b"".join(int(x).to_bytes(4, "little") for x in library.encode_ordinary(text))
    monkeypatch.undo()
    text = "a" + " " * 3_000_000 + "b"
    assert codec.decode(np.frombuffer(codec.encode(text), "<u4").tolist()) == text.encode()


def test_decodes_raw_bytes(spark):
    df = spark.createDataFrame([([0, 255, 128],), ([],), (None,)], "ids array<int>")
    codec = bpe.Codec(MULTI, PATTERN)
    assert [bytes(r.decoded) for r in bpe.decode(df.coalesce(1), MULTI, PATTERN).collect()] == [codec.decode([0, 255, 128]), b"", b""]


def test_column_names(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([("x", 1)], "text string, IDS int"), MULTI, PATTERN)


def test_rank_file_and_json_agree():
    a, b = (bpe.read_ranks(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    assert a == b
