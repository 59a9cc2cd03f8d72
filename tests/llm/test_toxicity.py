"""op5: the models against a direct computation, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import toxicity

from .conftest import CASES


def grams(text):
    """Grams of the text's words as tuples: ORDER symbols, zero before the word, one behind it."""
    out = []
    for word in text.lower().split():
        codes = [0] * (toxicity.ORDER - 1) + [*word.encode(), 1]
        out += [tuple(codes[i : i + toxicity.ORDER]) for i in range(len(word.encode()) + 1)]
    return out


def unpacked(key):
    return tuple(int(key) >> (toxicity.STEP * k) & 255 for k in reversed(range(toxicity.ORDER)))


def test_symbols():
    keys, place = toxicity.symbols("Trash, été x1\n\nwonderfully")
    assert [unpacked(k) for k in keys] == grams("trash été x1 wonderfully")
    assert list(place[:6]) == [0, 1, 2, 3, 4, 5] and place[6] == 0
    assert len({tuple(toxicity.symbols(w)[0]) for w in ("трэш", "τραυ", "東京都", "京東都")}) == 4
    assert len(toxicity.symbols(" ,.")[0]) == len(toxicity.symbols("")[0]) == 0


def direct(counts, discount):
    """Pooled probability by the recursion as it is written down, for each gram of the highest order."""
    levels = {toxicity.ORDER - 1: Counter()}
    raw, types = Counter(), Counter()
    for g, n in counts.items():
        raw[g[1:]] += n
        types[g[1:]] += 1
    used = {}
    for order in range(toxicity.ORDER - 1, 0, -1):
        used[order] = {g: (raw[g] if g[0] == 0 and order > 1 else types[g]) for g in raw}
        above, raw, types = raw, Counter(), Counter()
        for g, n in above.items():
            raw[g[1:]] += n
            types[g[1:]] += 1
    del levels

    def p(g):
        order = len(g)
        if order == 1:
            return used[1][g] / sum(used[1].values())
        same = {x: n for x, n in used[order].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        return max(used[order][g] - discount, 0) / total + discount * len(same) / total * p(g[1:])

    return {g: p(g[1:]) for g in counts}


def packed(g):
    return sum(c << (toxicity.STEP * k) for k, c in enumerate(reversed(g)))


def test_shared_estimate():
    counts = Counter(grams("the thing that they then said was the worst thing then and there trash"))
    keys = np.array([packed(g) for g in counts], np.uint64)
    got = toxicity._shared(keys, np.array(list(counts.values()), float), 0.7)
    wanted = direct(counts, 0.7)
    assert got == pytest.approx([wanted[g] for g in counts])


def test_estimate_sums_to_one_in_each_class():
    a, b = Counter(grams("trash scum trash losers")), Counter(grams("nice trees and nicer stones are nice"))
    every = sorted(a.keys() | b.keys())
    keys = np.array([packed(g) for g in every], np.uint64)
    toxic, ordinary = (np.array([c[g] for g in every], float) for c in (a, b))
    m = toxicity.estimate(keys, toxic, ordinary, 0.5)
    ratio = toxicity.ratios(keys, toxic, ordinary, 0.7)[0]
    assert ratio[every.index(grams("scum")[0])] > 0 > ratio[every.index(grams("nice")[0])]
    assert m.evidence("trash") > m.evidence("unseen") > m.evidence("nice trees")


def test_rare_expressions_say_less():
    def evidence(n):
        a, b = Counter(grams("trash queen " * 50 + "quux " * n)), Counter(grams("stones queen " * 50))
        every = sorted(a.keys() | b.keys())
        return toxicity.estimate(np.array([packed(g) for g in every], np.uint64), *(np.array([c[g] for g in every], float) for c in (a, b)), 0.5).evidence("quux")[0]

    assert 0 < evidence(1) < evidence(5) < evidence(50)


def test_hash_table_keeps_every_key():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 62, 50_000).astype(np.uint64), np.arange(300, dtype=np.uint64))))
    table = toxicity.laid_out(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    values, found = toxicity.look_up(table, keys)
    assert found[::2].all() and not found[1::2].any()
    assert list(values[::2]) == list(range(len(keys[::2])))
    assert not toxicity.look_up(toxicity.laid_out(keys[:0], np.empty(0)), keys)[1].any()


def test_every_gram_stays(spark):
    """Of thousands of distinct grams none is lost, and the model is that of all counts in one place."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijé東"), rng.integers(1, 12))) for _ in range(1500)]
    texts = [(" ".join(rng.choice(words, 60)), int(k % 3 == 0)) for k in range(300)]
    a, b = (Counter(g for t, mark in texts if mark == m for g in grams(t)) for m in (1, 0))
    every = sorted(a.keys() | b.keys())
    keys = np.array([packed(g) for g in every], np.uint64)
    wanted = toxicity.estimate(keys, *(np.array([c[g] for g in every], float) for c in (a, b)), 0.5)
    counts = toxicity.count_grams(spark.createDataFrame(texts, "text string, toxic int").repartition(4))
    assert {(r.key % (1 << 64), r.toxic, r.ordinary) for r in counts.collect()} == {(packed(g), a[g], b[g]) for g in every}
    got = toxicity.modelled(counts, 0.5)
    for k, v in (("keys", "ratio"), ("contexts", "backoff")):
        order = np.argsort(getattr(got, k))
        assert list(getattr(got, k)[order]) == list(np.sort(getattr(wanted, k)))
        assert getattr(got, v)[order] == pytest.approx(getattr(wanted, v)[np.argsort(getattr(wanted, k))], abs=1e-5)


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(larger):
    rows = {r.doc_id: r for r in toxicity.op5(*larger).collect()}
    assert len(rows) == larger[0].count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(rows[x.doc_id].predicted, x.toxic) for x in larger[1].collect() if x.doc_id in rows and rows[x.doc_id].held_out]
    hits, alarms = sum(p for p, t in held if t), sum(p for p, t in held if not t)
    assert hits / sum(t for _, t in held) > 0.75  # a part of the labels is noise
    assert alarms <= 0.005 * len(held)


def written_out(counts, discount):
    """Log-likelihood ratio of any gram from {gram: (toxic, ordinary)}, by the formulas as they stand in the docstring."""
    shared = direct(Counter({g: sum(n) for g, n in counts.items()}), discount)
    contexts = {g[:-1] for g in counts}
    below = {}

    def ratio(g):
        inside = [n for x, n in counts.items() if x[:-1] == g[:-1]]
        if not inside:
            return 0.0
        got = []
        for c in (0, 1):
            total, types = sum(n[c] for n in inside), sum(n[c] > 0 for n in inside)
            rest = (discount * types + toxicity.PULL) / (total + toxicity.PULL)
            got.append(max(counts[g][c] - discount, 0) / (total + toxicity.PULL) + rest * shared[g] if g in counts else rest)
        return np.log(got[0] / got[1])

    def known(g):
        context = g[:-1]
        if context not in below:
            far = ratio((*context, 255)) if context in contexts else 0.0
            below[context] = far if abs(far) >= toxicity.LEAST else 0.0
        own = ratio(g) if g in counts else below[context]
        return own if abs(own - below[context]) >= toxicity.LEAST else below[context]

    return known


def test_whole_query_by_brute_force(spark, documents):
    """Scores of all rows from dictionaries of tuples, with the curve's rows chosen by the same hash and its weights by plain gradient steps."""
    dice = np.random.default_rng(7)
    plain, foul = ["stone", "river", "été", "東京都", "walk", "green"], ["trash", "scum", "дрянь"]
    rows = [(k, " ".join(dice.choice(plain + (foul if k % 3 == 0 else []), 6))) for k in range(90)] + [(200, None), (201, "?!")]
    marks = [(k, int(k % 3 == 0)) for k in range(80)] + [(900 + k, 1) for k in range(50)]
    docs = documents(rows)
    got = {r.doc_id: r.score for r in toxicity.op5(docs, labels_of(spark, marks)).collect()}
    may = [(i, t, m) for i, t in rows for j, m in marks if i == j and zlib.crc32(str(i).encode()) % 3 != 1]
    aside = {r.doc_id for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 5), {1 << 20}) < {int(0.2 * (1 << 20))} AS a").where("a").collect()}
    counts = {}
    for i, t, m in may:
        for g in grams(t) if i not in aside else ():
            n = counts.setdefault(g, [0, 0])
            n[1 - m] += 1
    pooled = [sum(n) for n in counts.values()]
    ratio = written_out(counts, toxicity.discount_of(pooled.count(1), pooled.count(2)))

    def evidence(t):
        words = [[ratio(g) for g in grams(w)] for w in (t or "").replace("?!", "").split()]
        if not words:
            return [0.0] * 4
        top = sorted((sum(w) for w in words), reverse=True)
        return [sum(map(sum, words)) / sum(map(len, words)), *(sum(top[:k]) / (k * toxicity.WORD) for k in toxicity.STRONGEST)]

    x = np.array([[1.0, *evidence(t)] for i, t, _ in may if i in aside])
    y = np.array([m for i, _, m in may if i in aside], float)
    assert 0 < y.sum() < len(y)
    w = np.zeros(5)
    for _ in range(400_000):
        step = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-2 * np.array([0, *w[1:]])
        w += 0.02 * step
        if np.abs(step).max() < 1e-7:
            break
    wanted = {i: 1 / (1 + np.exp(-np.dot(w, [1.0, *evidence(t)]))) for i, t in rows}
    assert got == pytest.approx(wanted, abs=2e-3)


def test_labels_of_absent_documents_say_nothing(spark, documents):
    rows = [(1, "you are kind"), (2, "so are they")]
    assert {r.score for r in toxicity.op5(documents(rows), labels_of(spark, [(k, 1) for k in range(100, 200)])).collect()} == {0.0}


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, toxic int, text string, score string")


def test_cases(spark, documents):
    rows = [*CASES, *[(100 + k, "you are trash and scum" if k % 2 else "you are kind and good") for k in range(200)]]
    marks = [*[(100 + k, k % 2) for k in range(200)], (100, None), (None, 1), (5, 0), (5, 1), (999_999, 1)]
    out = toxicity.op5(documents(rows), labels_of(spark, marks)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in rows), key=str)
    assert {r.predicted for r in out if r.doc_id and r.doc_id >= 100 and r.doc_id % 2} == {1}
    assert {r.predicted for r in out if r.doc_id and r.doc_id >= 100 and r.doc_id % 2 == 0} == {0}
    empty = {r.score for r in out if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1


def test_without_labels_or_rows(spark, documents):
    assert {r.score for r in toxicity.op5(documents(CASES), labels_of(spark, [])).collect()} == {0.0}
    assert {r.score for r in toxicity.op5(documents(CASES), labels_of(spark, [(i, 0) for i in range(20)])).collect()} == {0.0}
    assert toxicity.op5(documents([]), labels_of(spark, [(1, 1)])).collect() == []


def test_stage_keeps_columns(spark, documents):
    rows = [(k, "you are trash and scum" if k % 2 else "you are kind and good") for k in range(200)]
    docs = documents(rows)
    out = toxicity.ordinary_only(docs, labels_of(spark, [(k, k % 2) for k in range(200)]))
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 200, 2))
