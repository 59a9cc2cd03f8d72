"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all ways
to cut it into pieces, of the product of the pieces' probabilities, which a forward algorithm adds up; a text's is the product
over its words. No piece of the vocabulary reaches over a blank, so words can be scored apart and each distinct word of a batch
once. The probabilities are learned by expectation maximisation over the same segmentations: expected piece counts of the labelled
texts by forward and backward sums, starting from equal probabilities.

Words of any length are summed whole: the sums of the last positions, as many as the longest piece has characters, are brought back
into range every RESCALE characters. Of the vocabulary only runs of blanks are left out, as no word can have one.

The model is fitted on at most about LANGUAGE_ROWS labelled rows of each language, chosen by a hash of the doc_id, whole texts;
every row is scored whole.

Defined cases: null text, and text without any letter, is ``und`` with score 0; so is every text if nothing could be learned.
Ties go to the language that sorts first. Repeated rows are scored alike. Rows without language or doc_id are never learned from.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import appended, free_name, mapped, with_fields

LANGUAGE_ROWS = 4_000
ITERATIONS = 2
#: Characters after which sums are rescaled, and those whose pieces are looked up at once.
RESCALE, STRETCH = 32, 4096
#: Texts whose distinct words are held at once.
TEXTS = 4_000
#: Characters of words of one length that are scored at once, and words up to which all piece lengths are added in one step.
CELLS, FEW = 300_000, 24
UNDETERMINED = "und"
#: Keeps products of probabilities within range: each character of a piece counts so many times its probability.
_SCALE = 1000.0
_BASE = np.uint64(0x100000001B3)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_WORDY = re.compile(r"[^\W\d_]")
_START = "▁"


class Vocabulary:
    """Pieces by a hash of their characters, in as many tables as collisions take."""

    def __init__(self, pieces: Iterable[str], bits: int = 18):
        self.pieces = sorted({p for p in pieces if p and _START not in p[1:]})
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown, self.absent = len(self.pieces), len(self.pieces) + 1
        self.bits, self.tables = bits, []
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        left = np.arange(len(hashes))
        for mix in _MIX:
            at = self._slot(hashes[left], mix)
            _, first = np.unique(at, return_index=True)
            keys, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.absent, np.int32)
            keys[at[first]], ids[at[first]] = hashes[left[first]], left[first]
            self.tables.append((mix, keys, ids))
            left = np.delete(left, first)
            if not len(left):
                break
        else:
            raise ValueError("the vocabulary's hashes collide")

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _slot(self, hashes: np.ndarray, mix: np.uint64) -> np.ndarray:
        return ((hashes * mix) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, self.absent, np.int32)
        for mix, keys, ids in self.tables:
            at = self._slot(hashes, mix)
            hit = keys[at] == hashes
            out[hit] = ids[at[hit]]
        return out

    def endings(self, codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """The pieces that end at each place from a to b of words given as codes (words x characters): places x lengths, from 1, x words."""
        n, low = len(codes), max(0, a - self.longest + 1)
        prefix = np.zeros((n, b - low + 1), np.uint64)
        for j in range(low, b):
            prefix[:, j - low + 1] = prefix[:, j - low] * _BASE + codes[:, j]
        out, power = np.full((b - a, self.longest, n), self.absent, np.int32), np.uint64(1)
        for length in range(1, min(self.longest, b) + 1):
            power = np.uint64((int(power) * int(_BASE)) & (2**64 - 1))
            first = max(a, length - 1)
            if first < b:
                ends = prefix[:, first - low + 1 :]
                out[first - a :, length - 1] = self.find(ends - prefix[:, first - low + 1 - length : b - low + 1 - length] * power).T
        out[:, 0][out[:, 0] == self.absent] = self.unknown
        return out


def _codes(words: list[str]) -> np.ndarray:
    """The characters of words of one length, counted from 1."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary(m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)))


def words_of(text: str) -> list[str]:
    """The text's words, lower-cased, each with the mark of a word's start."""
    return [_START + w for w in text.lower().split()]


def has_letter(text: str) -> bool:
    """Whether the text has a character of Unicode's letter categories."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def _by_length(words: Iterable[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _added(v: Vocabulary, sums: np.ndarray, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sum over piece lengths (of sums and ids, from 1) of the sums a piece goes on from, times its probability."""
    if sums.shape[1] <= FEW:
        return (sums * p[ids]).sum(axis=0)
    total = np.zeros(sums.shape[1:])
    for before, pieces in zip(sums, ids):
        some = np.flatnonzero(pieces != v.absent)
        if len(some):
            total[some] += before[some] * p[pieces[some]]
    return total


def _rescaled(sums: np.ndarray, logs: np.ndarray) -> None:
    """Brings sums into range, in place, and keeps the logarithms of what they were divided by."""
    top = sums.max(axis=0)
    sums /= top
    logs += np.log(top)


def forward(v: Vocabulary, words: list[str], p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By stretches of words of one length: the pieces that end there, the sums over the segmentations of each beginning that ends
    there, and the logarithms to add to theirs (places x words x languages); p: pieces x languages. The first place of a stretch is
    that of the last one's end, or the words' beginning."""
    codes, most = _codes(words), v.longest
    n, size = codes.shape
    tail, behind = np.ones((1, n, p.shape[1])), np.zeros((1, n, p.shape[1]))
    for a in range(0, size, STRETCH):
        ids, kept = v.endings(codes, a, min(size, a + STRETCH)), len(tail)
        sums = np.concatenate((tail, np.empty((len(ids), *tail.shape[1:]))))
        logs = np.concatenate((behind, np.empty((len(ids), *tail.shape[1:]))))
        for t in range(len(ids)):
            at = kept + t
            k = min(most, at)
            sums[at] = _added(v, sums[at - k : at][::-1], ids[t, :k], p)
            logs[at] = logs[at - 1]
            if (a + t + 1) % RESCALE == 0:
                _rescaled(sums[at - k + 1 : at + 1], logs[at - k + 1 : at + 1])
        yield ids, sums[kept - 1 :], logs[kept - 1 :]
        tail, behind = sums[-most:], logs[-most:]


def _scaled(v: Vocabulary, p: np.ndarray) -> np.ndarray:
    return p * (_SCALE ** np.array([*map(len, v.pieces), 1, 0]))[:, None]


def _parts(words: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """Words of one length, as many as are scored at once, with their length."""
    for size, some in _by_length(words).items():
        step = max(1, CELLS // size)
        for i in range(0, len(some), step):
            yield size, some[i : i + step]


def log_likelihoods(v: Vocabulary, words: Iterable[str], p: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Where each distinct word stands, and the log-likelihoods (words x languages) there."""
    order, out, scaled = [], [np.zeros((0, p.shape[1]))], _scaled(v, p)
    for size, part in _parts(words):
        for _, sums, logs in forward(v, part, scaled):
            last = sums[-1], logs[-1]
        out.append(np.log(np.maximum(last[0], 1e-300)) + last[1] - size * np.log(_SCALE))
        order += part
    return dict(zip(order, range(len(order)))), np.concatenate(out)


def expected(v: Vocabulary, words: Counter, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of the counted words; p: one probability a piece."""
    out, scaled = np.zeros(len(v.pieces) + 2), _scaled(v, p[:, None])
    for size, part in _parts(words):
        stretches = list(forward(v, part, scaled))
        ids = np.concatenate([s[0] for s in stretches])
        alpha, logs = (np.concatenate([stretches[0][k][:1], *(s[k][1:] for s in stretches)])[:, :, 0] for k in (1, 2))
        beta, behind = np.zeros((size + 1, len(part))), np.zeros((size + 1, len(part)))
        beta[size] = 1
        weight, whole = np.array([words[w] for w in part], float) / np.maximum(alpha[-1], 1e-300), logs[-1]
        for start in range(size - 1, -1, -1):
            k = min(v.longest, size - start)
            for length in range(1, k + 1):
                pieces = ids[start + length - 1, length - 1]
                on = np.flatnonzero(pieces != v.absent)
                if len(on):
                    flow = scaled[pieces[on], 0] * beta[start + length][on]
                    beta[start][on] += flow
                    flow = alpha[start][on] * flow * weight[on]
                    if size >= RESCALE:
                        flow *= np.exp(logs[start][on] + behind[start + length][on] - whole[on])
                    np.add.at(out, pieces[on], flow)
            behind[start] = behind[start + 1]
            if (size - start) % RESCALE == 0:
                _rescaled(beta[start : start + k], behind[start : start + k])
    return out


@dataclass
class Model:
    """Languages and, for each piece, the unknown character and the absent piece, a probability in each language."""

    path: str
    languages: list[str]
    p: np.ndarray

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and posterior of each text; each distinct word of the list is scored once."""
        v, some, number = vocabulary(self.path), [], {}
        for text in texts:
            words = words_of(text) if text and self.languages and has_letter(text) else ()
            some.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        index, table = log_likelihoods(v, number, self.p)
        table = table[np.fromiter(map(index.__getitem__, number), np.int64, len(number))]
        for words in some:
            if not len(words):
                yield UNDETERMINED, 0.0
                continue
            total = table[words].sum(axis=0)
            chance = np.exp(total - total.max())
            best = int(total.argmax())
            yield self.languages[best], float(chance[best] / chance.sum())


def normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts; pieces never expected keep a little, as do unknown characters; the absent piece none."""
    out = counts + 1e-3
    out[-2] = counts[-2] + 0.1
    out[-1] = 0
    return out / out.sum()


def learned(doc_id):
    """Whether a document's language may be learned: CRC-32 of its id modulo 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(documents: DataFrame, path: str, rows: int = LANGUAGE_ROWS, iterations: int = ITERATIONS) -> Model:
    """The model of the documents whose language may be learned."""
    may = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in may.groupBy("lang").count().collect()}
    languages = sorted(counts)
    v = vocabulary(path)
    if not languages:
        return Model(path, [], np.zeros((len(v.pieces) + 2, 0)))
    limit = functools.reduce(lambda at, x: F.when(F.col("lang") == x, int(min(1.0, rows / counts[x]) * (1 << 20))).otherwise(at), languages, F.lit(0))
    some = may.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < limit).select("lang", "text")
    start = np.ones(len(v.pieces) + 2)
    start[-1] = 0
    p = {x: start / start.sum() for x in languages}
    for _ in range(iterations):
        sent = documents.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, words = vocabulary(path), {}
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    words.setdefault(lang, Counter()).update(words_of(text))
                for lang, counted in words.items():  # words are held for one batch only
                    got = expected(v, counted, sent.value[lang])
                    on = np.flatnonzero(got)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on.astype(np.int32)), pa.array(got[on])], names=["lang", "piece", "n"])
                words.clear()

        summed = some.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        totals = {x: np.zeros(len(v.pieces) + 2) for x in languages}
        for lang, piece, n in zip(*(summed.column(c).to_pylist() for c in ("lang", "piece", "n"))):
            totals[lang][piece] = n
        p = {x: normalised(t) for x, t in totals.items()}
    return Model(path, languages, np.column_stack([p[x] for x in languages]))


def predict(documents: DataFrame, model: Model, language: str = "lang_pred", score: str = "lang_score", text: str = "text") -> DataFrame:
    """documents with the predicted language and its posterior."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                got = list(sent.value.predict(part.column(text).to_pylist()))
                yield appended(part, **{language: pa.array([g[0] for g in got], pa.string()), score: pa.array([g[1] for g in got], pa.float64())})

    return mapped(documents, run, with_fields(documents, **{language: "string", score: "double"}))


def op3(documents: DataFrame, path: str) -> DataFrame:
    """The columns of the op3 contract."""
    found = predict(documents.select("doc_id", "text"), fit(documents, path), "lang_pred", "score")
    return found.select("doc_id", F.coalesce(~learned(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def determined_only(documents: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """The documents whose language is determined with at least the given posterior, with their own columns."""
    language, score = free_name(documents, "language"), free_name(documents, "certainty")
    found = predict(documents, fit(documents, path), language, score)
    return found.where((F.col(language) != UNDETERMINED) & (F.col(score) >= least)).drop(language, score)
