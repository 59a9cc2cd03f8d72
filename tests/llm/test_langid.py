"""op3: the forward sums against all segmentations, and held-out accuracy."""

import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid
from lodestone.llm.queries import PIECES

from .conftest import CASES


@pytest.fixture(scope="module")
def small():
    v = langid.Vocabulary(["▁", "▁a", "a", "b", "ab", "▁ab", "abc", "c", "bc"])
    rng = np.random.default_rng(1)
    p = rng.random((len(v.pieces) + 2, 2))
    p[-1] = 0
    return v, p / p.sum(axis=0)


def segmentations(v, word):
    """All ways to cut a word, as lists of piece numbers; an unknown character is a piece of its own."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        piece = word[:n]
        number = v.pieces.index(piece) if piece in v.pieces else v.unknown if n == 1 else None
        if number is not None:
            for rest in segmentations(v, word[n:]):
                yield [number, *rest]


WORDS = ["▁abc", "▁cab", "▁z", "▁abzab", "▁", "▁aabbcc"]


def test_sums_over_all_segmentations(small):
    v, p = small
    index, table = langid.log_likelihoods(v, WORDS, p)
    for w in WORDS:
        for k in range(2):
            assert table[index[w], k] == pytest.approx(math.log(sum(math.prod(p[x, k] for x in s) for s in segmentations(v, w))))


def test_expected_counts(small):
    v, p = small
    words = Counter({w: n for n, w in enumerate(WORDS, 1)})
    wanted = np.zeros(len(v.pieces) + 2)
    for w, n in words.items():
        every = [(math.prod(p[x, 0] for x in s), s) for s in segmentations(v, w)]
        for chance, s in every:
            for x in s:
                wanted[x] += n * chance / sum(c for c, _ in every)
    assert langid.expected(v, words, p[:, 0]) == pytest.approx(wanted)


def test_vocabulary_finds_its_pieces(monkeypatch):
    v = langid.vocabulary(PIECES)
    assert v.longest == max(len(p) for p in v.pieces) >= 16
    for stretch in (3, 4096):
        for word in ("▁the", "▁Straße", "été", "▁representativesrelationship"):
            codes = langid._codes([word])
            for a in range(0, len(word), stretch):
                for end, ids in enumerate(v.endings(codes, a, min(len(word), a + stretch)), a + 1):
                    for length, number in enumerate(ids[:, 0], 1):
                        piece = word[end - length : end] if length <= end else None
                        assert number == (v.pieces.index(piece) if piece in v.pieces else v.unknown if length == 1 else v.absent)


def whole_sum(v, word, p):
    """Logarithm of the sum over all segmentations, in fractions of integers, which don't run out of range."""
    number = {x: k for k, x in enumerate(v.pieces)}
    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        sums.append(sum((sums[i] * Fraction(p[number.get(word[i:j], v.unknown if j - i == 1 else v.absent)]) for i in range(max(0, j - v.longest), j)), Fraction(0)))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator), sums


LONG = ["▁representatives", "▁" + "donaudampfschifffahrtsgesellschaft" * 6, "▁" + "東京都は" * 20, "▁" + "x" * 130]


@pytest.mark.parametrize("stretch", [7, 4096])
def test_long_words_over_the_whole_vocabulary(monkeypatch, stretch):
    """Pieces of 16 characters and words of 200 count in full, also where a stretch or a rescaling cuts them."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    v = langid.vocabulary(PIECES)
    assert "▁representatives" in v.pieces and len("▁representatives") == 16
    p = np.random.default_rng(3).random((len(v.pieces) + 2, 2))
    p[-1] = 0
    p /= p.sum(axis=0)
    p[v.pieces.index("▁representatives"), 0] = 0.01
    index, table = langid.log_likelihoods(v, LONG, p)
    for w in LONG:
        for k in range(2):
            assert table[index[w], k] == pytest.approx(whole_sum(v, w, p[:, k])[0], rel=1e-9)
    word = LONG[1]
    forwards, backwards = (whole_sum(v, word, p[:, 0])[1], [whole_sum(v, word[i:], p[:, 0])[1][-1] for i in range(len(word) + 1)])
    wanted = np.zeros(len(v.pieces) + 2)
    number = {x: k for k, x in enumerate(v.pieces)}
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + v.longest) + 1):
            piece = number.get(word[i:j], v.unknown if j - i == 1 else None)
            if piece is not None:
                wanted[piece] += float(2 * forwards[i] * Fraction(p[piece, 0]) * backwards[j] / forwards[-1])
    assert langid.expected(v, Counter({word: 2}), p[:, 0]) == pytest.approx(wanted, rel=1e-6, abs=1e-9)


def test_whole_query_by_brute_force(spark, documents):
    """Language and posterior of every row from lists of segmentation sums, with the labelled rows and steps of the docstring."""
    dice = np.random.default_rng(5)
    vocabulary = {"a": ["der", "schnelle", "Fuchs", "springt"], "b": ["the", "quick", "fox", "jumps", "representatives"]}
    texts = [(k, " ".join(dice.choice(vocabulary["ab"[k % 2]], 5)), "ab"[k % 2]) for k in range(24)] + [(50, "der fox", None), (51, None, "a"), (52, "12 ?", "b")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op3(rows, PIECES).collect()}
    v = langid.vocabulary(PIECES)
    number = {x: k for k, x in enumerate(v.pieces)}
    p = {x: np.append(np.ones(len(v.pieces) + 1), 0) / (len(v.pieces) + 1) for x in "ab"}
    for _ in range(langid.ITERATIONS):
        for lang in "ab":
            counts = np.zeros(len(v.pieces) + 2)
            for i, t, own in texts:
                if own == lang and t is not None and zlib.crc32(str(i).encode()) % 5 != 0:
                    for w in langid.words_of(t):
                        ahead = whole_sum(v, w, p[lang])[1]
                        for i0 in range(len(w)):
                            for j in range(i0 + 1, len(w) + 1):
                                piece = number.get(w[i0:j], v.unknown if j - i0 == 1 else None)
                                if piece is not None:
                                    rest = whole_sum(v, w[j:], p[lang])[1][-1]
                                    counts[piece] += float(ahead[i0] * Fraction(p[lang][piece]) * rest / ahead[-1])
            p[lang] = langid.normalised(counts)
    for i, t, _ in texts:
        if t is None or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        logs = [sum(whole_sum(v, w, p[x])[0] for w in langid.words_of(t)) for x in "ab"]
        assert got[i][0] == "ab"[int(logs[1] > logs[0])]
        assert got[i][1] == pytest.approx(1 / (1 + math.exp(-abs(logs[1] - logs[0]))), abs=1e-6)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op3(df, PIECES).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_only_text_is_an_input(spark):
    """Other labels on held-out rows, other ids order or sources change no prediction."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "en").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.op3(x, PIECES).collect()} for x in (df, changed))
    assert a == b


def test_cases(cases):
    out = langid.op3(cases, PIECES).collect()
    assert len(out) == len(CASES)
    for r in out:
        texts = [t for i, t in CASES if i == r.doc_id]
        if all(t is None or not langid.has_letter(t) for t in texts):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif all(t and langid.has_letter(t) for t in texts):
            assert r.lang_pred == "en"


def test_letters():
    assert [langid.has_letter(t) for t in ("½ ²", "12_", "", "½ a", "東", "́")] == [False, False, False, True, True, False]


def test_nothing_to_learn(documents, spark):
    assert langid.op3(documents([]), PIECES).collect() == []
    rows = langid.op3(documents([(None, "some words"), (2, "two")]), PIECES).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_stage_keeps_columns(cases):
    out = langid.determined_only(cases, PIECES)
    assert out.columns == cases.columns
    ids = [r.doc_id for r in out.collect()]
    assert 11 in ids and 1 not in ids and 13 not in ids
