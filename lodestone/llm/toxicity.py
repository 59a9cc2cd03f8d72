"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

A word (a run of letters and digits, lower-cased, in UTF-8) is a sequence of bytes and an end mark, each predicted from up to seven
bytes before it within the word, so that characters of every script are told apart. The toxic and the ordinary model have eight-gram
counts of their own and share every lower order: its Kneser-Ney continuation counts are pooled over both classes. Beside Kneser-Ney's
own interpolation weight the shared estimate counts as PULL occurrences in each class, so an expression that a class has hardly seen
falls back to the same estimate in both and says little, however rare it is. A byte's evidence is the difference of its
log-likelihoods under the two models. A text's is normalised by length: the mean over all its bytes, and the means over passages of
STRONGEST words of WORD bytes, made of its strongest words, so that long texts and short ones compare. A logistic curve over these,
fitted on labelled rows that the counts leave out, turns evidence into a score. Expressions of several words that are ordinary one by
one have no evidence of their own.

Every labelled row that may be learned is counted, whole, but for the curve's, which are a bounded sample (CURVE rows, a fifth at
most). Counts are dealt by the BASE bytes before the predicted one, so that each partition holds all that the orders above BASE need;
the orders up to BASE are summed over the partitions. The executors get the seen eight-grams and contexts whose evidence differs by
LEAST or more from what would stand in for them (a context's for an eight-gram, none for a context), so no byte's evidence is moved by
more than twice that; how many these are grows with the corpus.

Defined cases: null text counts as empty; a text without words has no evidence and gets the score of evidence zero; a doc_id with
several labels is toxic if any of them says so; labels that are null, or of documents that are absent, are not used; if either
class has no rows, every text scores the share of toxic rows (0 without labels). Repeated rows are scored alike and count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import appended, checkpointed, free_name, mapped, partitions, with_fields

CURVE = 20_000
#: Bits of a symbol in a key, and symbols of a key.
STEP, ORDER = 8, 8
#: Symbols before the predicted one by which counts are dealt, and the order up to which the driver has the shared estimate.
BASE = 3
#: Occurrences that the shared estimate counts as in each context of a class.
PULL = 12
#: Words, and bytes of each, of the passages of strongest words that a text is judged by.
STRONGEST, WORD = (1, 3, 10), 8
#: Evidence that must be between a gram and what stands in for it.
LEAST = 0.1
#: The mark behind a word; before one stands zero. Neither is a byte of a letter.
_END = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: No key: no byte of UTF-8 has all bits set.
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LETTER = np.zeros(128, bool)
_LETTER[[*range(48, 58), *range(97, 123)]] = True


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams of a text's words (STEP bits a byte, the predicted one lowest) and the position of each in its word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    wide = codes >= 128
    letter = _LETTER[np.where(wide, 0, codes)] | (wide & (codes >= 0xAA) & ((codes < 0x2000) | (codes > 0x206F)) & (codes != 0x3000))
    stay = letter | np.concatenate(([False], letter[:-1]))
    spelt = np.where(letter, codes, _END)[stay].astype("<u4")
    code = np.frombuffer(spelt.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") + (b"\x01" if len(letter) and letter[-1] else b""), np.uint8).astype(np.uint64)
    n = len(code)
    if n == 0:
        return code, np.empty(0, np.int64)
    ends = np.flatnonzero(code == _END)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(n) - np.repeat(starts, ends - starts + 1)
    keys = code.copy()
    for k in range(1, ORDER):
        keys[k:] |= np.where(place[k:] >= k, code[:-k], np.uint64(0)) << np.uint64(STEP * k)
    return keys, place


def _home(keys: np.ndarray, size: int) -> np.ndarray:
    return ((((keys * _MIX) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def laid_out(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A hash table: every distinct key, in the first free place from its home on, and its value; half of the places stay empty."""
    size = 2 * len(keys) + 1
    home = _home(keys, size)
    order, step = np.argsort(home, kind="stable"), np.arange(len(keys))
    at = np.maximum.accumulate(home[order] - step) + step
    places = max(size, int(at.max(initial=0)) + 1) + 1
    own, held = np.full(places, _EMPTY), np.zeros(places, values.dtype)
    own[at], held[at] = keys[order], values[order]
    return own, held, size


def look_up(table: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the keys, and whether each is in the table."""
    own, held, size = table
    at = _home(keys, size)
    there = own[at]
    found = there == keys
    left = np.flatnonzero(~found & (there != _EMPTY))
    while len(left):
        at[left] += 1
        there = own[at[left]]
        found[left] = there == keys[left]
        left = left[(there != keys[left]) & (there != _EMPTY)]
    return held[at], found


def _sum_by(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct groups, where each row's group is among them, and the sums of values."""
    distinct, at = np.unique(groups, return_inverse=True)
    return distinct, at, np.bincount(at, values, len(distinct))


def _used(grams: np.ndarray, types: np.ndarray, occurrences: np.ndarray, order: int) -> np.ndarray:
    """The counts that an order's estimate rests on."""
    # Nothing stands before a word, so n-grams at its start are weighed by occurrences, as is usual.
    start = (grams >> np.uint64(STEP * (order - 1))) == 0
    return np.where(start & (order > 1), occurrences, types)


def _interpolated(grams: np.ndarray, n: np.ndarray, discount: float, below: np.ndarray) -> np.ndarray:
    _, at, total = _sum_by(grams >> np.uint64(STEP), n)
    types = np.bincount(at, minlength=len(total))
    return np.maximum(n - discount, 0) / total[at] + discount * types[at] / total[at] * below


def _lower(grams: np.ndarray, occurrences: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """The n-grams of an order that end those of the order above: their types above, occurrences, and where each of those above is among them."""
    distinct, at, total = _sum_by(grams & np.uint64((1 << STEP * order) - 1), occurrences)
    return distinct, np.bincount(at, minlength=len(distinct)).astype(float), total, at


def _shared(keys: np.ndarray, counts: np.ndarray, discount: float, order: int = ORDER, base: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Pooled Kneser-Ney probability of the last byte of each n-gram of an order, from the orders below; from base (BASE-grams, sorted, and their probabilities) on if it is given."""
    levels, grams, occurrences = [], keys, counts
    for k in range(order - 1, BASE if base else 0, -1):
        distinct, types, total, at = _lower(grams, occurrences, k)
        levels.append((distinct, _used(distinct, types, total, k), at))
        grams, occurrences = distinct, total
    p = base[1][np.searchsorted(base[0], grams & np.uint64((1 << STEP * BASE) - 1))] if base else None
    for distinct, n, at in reversed(levels):
        p = (n / n.sum() if p is None else _interpolated(distinct, n, discount, p))[at]
    return p


@dataclass
class Model:
    """Log-likelihood ratios of seen ORDER-grams and, for unseen ones, of seen contexts; and the curve.

    Only telling keys are stored and sent; each worker lays them out in hash tables when it first needs them.
    """

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    curve: np.ndarray
    prior: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "laid"}

    def tables(self) -> tuple:
        """The hash tables of ORDER-grams and of contexts."""
        if "laid" not in self.__dict__:
            self.laid = laid_out(self.keys, self.ratio), laid_out(self.contexts, self.backoff)
        return self.laid

    def evidence(self, text: str) -> tuple[float, ...]:
        """Mean ratio of all bytes, and of the passages of strongest words."""
        keys, place = symbols(text) if len(self.keys) or len(self.contexts) else ((), ())
        if not len(keys):
            return (0.0,) * (1 + len(STRONGEST))
        grams, contexts = self.tables()
        ratio, seen = look_up(grams, keys)
        out, unseen = ratio.astype(np.float64), ~seen
        backoff, known = look_up(contexts, keys[unseen] >> np.uint64(STEP))
        out[unseen] = np.where(known, backoff, 0)
        words = np.add.reduceat(out, np.flatnonzero(place == 0))
        most = max(STRONGEST)
        top = np.sort(np.partition(words, -most)[-most:] if len(words) > most else words)[::-1]
        return (float(out.mean()), *(float(top[:k].sum()) / (k * WORD) for k in STRONGEST))

    def score(self, text: str) -> float:
        if not len(self.curve):
            return self.prior
        z = float(np.dot(self.curve, (1.0, *self.evidence(text))))
        return float(1 / (1 + np.exp(-min(max(z, -60), 60))))


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))


def ratios(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float, base: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """The ratio of each ORDER-gram, the contexts and the ratio of each, from all ORDER-grams of these contexts."""
    shared = _shared(keys, toxic + ordinary, discount, base=base)
    contexts, at = np.unique(keys >> np.uint64(STEP), return_inverse=True)
    chance, left = [], []
    for n in (toxic, ordinary):
        total, types = np.bincount(at, n, len(contexts)), np.bincount(at, n > 0, len(contexts))
        rest = (discount * types + PULL) / (total + PULL)
        chance.append(np.maximum(n - discount, 0) / (total + PULL)[at] + rest[at] * shared)
        left.append(rest)
    return np.log(chance[0] / chance[1]).astype(np.float32), contexts, np.log(left[0] / left[1]).astype(np.float32)


def telling(keys: np.ndarray, ratio: np.ndarray, contexts: np.ndarray, backoff: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, ...]:
    """Those of the ORDER-grams and contexts of ratios() whose evidence differs enough from what stands in for them."""
    far = np.abs(backoff) >= least
    stand_in = np.where(far, backoff, 0)[np.searchsorted(contexts, keys >> np.uint64(STEP))]
    own = np.abs(ratio - stand_in) >= least
    return keys[own], ratio[own], contexts[far], backoff[far]


def empty(prior: float) -> Model:
    none = np.empty(0)
    return Model(none, none, none, none, none, prior)


def estimate(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, prior: float) -> Model:
    """The model, still without its curve, from the counts of all distinct ORDER-grams in one place."""
    if not (toxic.sum() and ordinary.sum()):
        return empty(prior)
    pooled = toxic + ordinary
    return Model(*telling(keys, *ratios(keys, toxic, ordinary, discount_of((pooled == 1).sum(), (pooled == 2).sum()))), np.empty(0), prior)


def fit_curve(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    if not len(labels) or labels.min() == labels.max():
        return np.array([float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))] + [0.0] * features.shape[1]) if len(labels) else np.empty(0)
    x, w = np.column_stack((np.ones(len(labels)), features)), np.zeros(features.shape[1] + 1)
    ridge = np.diag([0.0] + [1e-2] * features.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Distinct keys of the batches (key, toxic, ordinary), sorted, and their counts."""
    held, rows = [], 0

    def merged() -> tuple[np.ndarray, ...]:
        every = [np.concatenate([h[k] for h in held]) if held else np.empty(0, t) for k, t in enumerate((np.uint64, float, float))]
        distinct, at, toxic = _sum_by(every[0], every[1])
        return distinct, toxic, np.bincount(at, every[2], len(distinct))

    for batch in batches:
        held.append((batch.column("key").to_numpy().view(np.uint64), *(batch.column(c).to_numpy().astype(float) for c in ("toxic", "ordinary"))))
        rows += batch.num_rows
        if rows > 1 << 21:
            held, rows = [merged()], 0
    return merged()


def count_grams(rows: DataFrame) -> DataFrame:
    """key, toxic, ordinary: every ORDER-gram over all rows (text, toxic), those with the same BASE characters before the last in one partition.

    Each batch is summed before it is sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("toxic").to_pylist()
            parts = [[], []]
            for text, mark in zip(batch.column("text").to_pylist(), marks):
                parts[1 if mark else 0].append(symbols(text or "")[0])
            both = [np.concatenate(p) if p else np.empty(0, np.uint64) for p in parts]
            keys, at = np.unique(np.concatenate(both), return_inverse=True)
            n = len(both[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at[n:], minlength=len(keys))), pa.array(np.bincount(at[:n], minlength=len(keys)))], names=["key", "toxic", "ordinary"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *counts = _summed(batches)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["key", "toxic", "ordinary"])

    kind = "key bigint, toxic bigint, ordinary bigint"
    dealt = F.shiftright("key", STEP).bitwiseAND(F.lit((1 << STEP * BASE) - 1))
    return rows.select("text", "toxic").mapInArrow(run, kind).repartition(partitions(rows.sparkSession), dealt).mapInArrow(whole, kind)


def modelled(grams: DataFrame, prior: float) -> Model:
    """The model that estimate gives, from the counts as count_grams deals them."""
    grams = checkpointed(grams)
    pooled = F.col("toxic") + F.col("ordinary")
    known = grams.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count_if(pooled == 1).alias("ones"), F.count_if(pooled == 2).alias("twos")).first()
    if not (known["toxic"] and known["ordinary"]):
        return empty(prior)
    discount = discount_of(known["ones"], known["twos"])

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, toxic, ordinary = _summed(batches)
        found, total = keys, toxic + ordinary
        for order in range(ORDER - 1, BASE - 1, -1):
            found, types, total, _ = _lower(found, total, order)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(types), pa.array(total)], names=["gram", "types", "total"])

    below = grams.mapInArrow(lower, "gram bigint, types double, total double").groupBy("gram").agg(F.sum("types").alias("types"), F.sum("total").alias("total")).orderBy("gram").toArrow()
    found, types, total = below["gram"].to_numpy().astype(np.uint64), below["types"].to_numpy(), below["total"].to_numpy()
    base = found, _interpolated(found, _used(found, types, total, BASE), discount, _shared(found, total, discount, BASE))
    sent = grams.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, toxic, ordinary = _summed(batches)
        if len(keys):
            # All grams of a context are in its partition.
            grams, ratio, contexts, backoff = telling(keys, *ratios(keys, toxic, ordinary, discount, sent.value))
            for k, r, of in ((grams, ratio, False), (contexts, backoff, True)):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(r), pa.array(np.full(len(k), of))], names=["key", "ratio", "context"])

    out = grams.mapInArrow(run, "key bigint, ratio float, context boolean").toArrow()
    sent.destroy()
    keys, ratio, context = out["key"].to_numpy().view(np.uint64), out["ratio"].to_numpy(), out["context"].to_numpy()
    return Model(keys[~context], ratio[~context], keys[context], ratio[context], np.empty(0), prior)


def learned(doc_id):
    """Whether labels of a document may be learned: CRC-32 of its id modulo 3 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(documents: DataFrame, labels: DataFrame, curve_rows: int = CURVE) -> Model:
    """The model of all labelled documents that may be learned."""
    marks = labels.where(F.col("toxic").isNotNull() & learned(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.select("doc_id", "text").where(learned(F.col("doc_id"))).join(marks.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "toxic")
    known = documents.select("doc_id").join(marks, "doc_id").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    prior = float(known["t"] or 0) / max(1, known["n"])
    share = min(1 / 5, curve_rows / max(1, known["n"]))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))
    model = modelled(count_grams(rows.where(~aside)), prior)
    if not (len(model.keys) or len(model.contexts)):
        return model
    some = rows.where(aside)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.evidence(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column("toxic").cast(pa.float64())], names=["features", "toxic"])

    seen = some.mapInArrow(run, "features array<double>, toxic double").toArrow()
    sent.destroy()
    model.curve = fit_curve(np.array(seen.column("features").to_pylist()).reshape(seen.num_rows, -1), seen.column("toxic").to_numpy())
    return model


def score(documents: DataFrame, model: Model, column: str = "toxicity", text: str = "text") -> DataFrame:
    """documents with a column of scores from 0 to 1."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield appended(batch, **{column: pa.array([sent.value.score(t or "") for t in batch.column(text).to_pylist()], pa.float64())})

    return mapped(documents, run, with_fields(documents, **{column: "double"}))


def op5(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the op5 contract."""
    found = score(documents.select("doc_id", "text"), fit(documents, labels), "score")
    return found.select("doc_id", F.coalesce(~learned(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def ordinary_only(documents: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The documents that score below the limit, with their own columns."""
    name = free_name(documents, "toxicity")
    return score(documents, fit(documents, labels), name).where(F.col(name) < limit).drop(name)
