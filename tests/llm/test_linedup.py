"""op4 against a dictionary of chunks."""

import random

import pytest
import xxhash

from lodestone.llm import linedup

from .conftest import CASES


M = 2**64


def own_chunks(text):
    """Lines, and the chunks (first line, line behind the last) of all ways to cut, by their definition."""
    lines = text.split("\n")
    hashes = [xxhash.xxh3_64_intdigest(line.encode()) for line in lines]
    rolling = [((hashes[i - 1] if i else 0) * 0x9E3779B97F4A7C15 + h) % M for i, h in enumerate(hashes)]
    rolling = [(r ^ r >> 29) * 0xBF58476D1CE4E5B9 % M for r in rolling]
    long = [len(line.split()) >= 50 for line in lines]
    cuts = []
    for cut in range(3):
        out, start = [], 0
        while start < len(lines):
            stop = next((j for j in range(start, min(len(lines), start + 16)) if long[j]), None)
            if stop == start:
                end = start + 1
            else:
                natural = next((j + 1 for j in range(start + 1, min(len(lines), start + 16) if stop is None else stop) if rolling[j] >> (40 + cut) & 1), None)
                forced = start + 16 if stop is None and start + 16 <= len(lines) else None
                if forced:
                    forced = max(range(start + 1, forced), key=lambda j: (rolling[j], j)) + 1
                end = natural or stop or forced or len(lines)
            out.append((start, end))
            start = end
        cuts.append(out)
    return lines, cuts, long


def signed_hash(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect()
    return {r.t: r.h for r in rows}


def candidates(text):
    """Lines, and each chunk that may go with the lines of those above and below it in the first cut that has it."""
    lines, cuts, long = own_chunks(text)
    may = lambda a, b: any(x.strip() for x in lines[a:b]) and (b - a >= 2 or long[a])
    out = {}
    for spans in cuts:
        for no, (a, b) in enumerate(spans):
            if may(a, b):
                around = [lines[slice(*spans[n])] if 0 <= n < len(spans) and may(*spans[n]) else None for n in (no - 1, no + 1)]
                out.setdefault((a, b), around)
    return lines, out


def expected(spark, rows):
    hashed = signed_hash(spark, {t for _, t in rows})
    cut, where = [candidates(t or "") for _, t in rows], {}
    for k, ((i, t), (lines, found)) in enumerate(zip(rows, cut)):
        for (a, b), around in found.items():
            where.setdefault(tuple(lines[a:b]), []).append(((i is not None, i or 0, hashed[t], a), k, b, around))
    gone = [set() for _ in rows]
    for found in where.values():
        at, k, last, first = min(found, key=lambda f: f[0])
        for place, j, b, around in found:
            if place == at:
                continue
            gone[j].update(range(place[3], b))
            for side, step in ((0, -1), (1, 1)):
                if around[side] and around[side] == first[side]:
                    continue
                size = 0
                for d in range(16):
                    q, r = (place[3] - 1 - d, at[3] - 1 - d) if step < 0 else (b + d, last + d)
                    if not (0 <= q < len(cut[j][0]) and 0 <= r < len(cut[k][0])) or cut[j][0][q] != cut[k][0][r]:
                        break
                    size += len(cut[k][0][r]) + 1
                    if size > 4096 or len(cut[k][0][r].split()) >= 50:
                        break
                    gone[j].add(q)
    out = [(i, t if t is None or not gone[k] else "\n".join(x for n, x in enumerate(cut[k][0]) if n not in gone[k]), len(gone[k])) for k, (i, t) in enumerate(rows)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in linedup.op4(df).collect()), key=str)


def test_whole_table(spark, whole):
    assert got(whole[1]) == expected(spark, whole[0])


def test_cases(spark, cases):
    assert got(cases) == expected(spark, CASES)


def test_empty_table(documents):
    assert got(documents([])) == []


@pytest.mark.parametrize("cut", range(linedup.CUTS))
def test_chunks_resist_shifts(cut):
    lines = [f"line {k} says {k * k}" for k in range(200)] + ["the same"] * 40 + [f"more {k}" for k in range(60)]
    moved = ["something else", "in front", *lines[:100], "in between", *lines[100:]]
    a, b = ([x[slice(*c)] for c in linedup.chunks(linedup.rolling(x), [False] * len(x), cut)] for x in (lines, moved))
    same = {tuple(x) for x in a} & {tuple(x) for x in b}
    assert len({tuple(x) for x in a} - same) <= 6
    assert [line for x in a for line in x] == lines
    assert max(map(len, a)) <= linedup.MOST


PASSAGE = "\n".join(f"{w} shared words of a passage that many documents hold" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"))
LONG = "said " * 55 + "at the end"


@pytest.mark.parametrize("passage", [PASSAGE, LONG])
def test_passages_go_but_once(documents, passage):
    rows = [(k, "\n".join([*[f"own line {k} {j}" for j in range(k % 5 + 1)], passage, f"closing line of {k}"])) for k in range(30)]
    out = dict((i, t) for i, t, _ in got(documents(rows)))
    kept = [line for line in passage.split("\n") if sum(line in t.split("\n") for t in out.values()) > 1]
    assert not kept
    for line in passage.split("\n"):
        assert any(line in t.split("\n") for t in out.values())
    for i, t in rows:
        assert f"closing line of {i}" in out[i] and f"own line {i} 0" in out[i]


#: Least part of the lines of repeated passages (all but the first occurrence) that go, by the number of short lines of a passage.
RECALL = {3: 0.5, 4: 0.7, 5: 0.9, 6: 0.9, 8: 0.95, 10: 0.98, 12: 0.98, 20: 0.99}


@pytest.mark.parametrize("n", RECALL)
def test_recall_by_lines_of_a_passage(documents, n):
    dice = random.Random(n)
    say = lambda: " ".join(dice.choice("river stone tall green words under over bird cloud".split()) + str(dice.randint(0, 99)) for _ in range(10))
    passages = [[say() for _ in range(n)] for _ in range(60)]
    rows = [(k, "\n".join([*[say() for _ in range(dice.randint(0, 9))], *passages[k % 60], *[say() for _ in range(dice.randint(0, 9))]])) for k in range(180)]
    out = {i: set(t.split("\n")) for i, t, _ in got(documents(rows))}
    left = sum(line in out[k] for k in range(60, 180) for line in passages[k % 60])
    print(n, "lines:", round(1 - left / (120 * n), 3))
    assert 1 - left / (120 * n) >= RECALL[n]
    for k in range(180):
        assert set(rows[k][1].split("\n")) - out[k] <= set(passages[k % 60])
    for p in passages:
        assert all(any(line in t for t in out.values()) for line in p)


def test_single_short_lines_stay(documents):
    rows = [(k, f"common line\nown {k} text\ncommon line two\nown {k} more") for k in range(20)]
    assert got(documents(rows)) == sorted(((i, t, 0) for i, t in rows), key=str)


def test_single_lines_of_any_length_stay_if_asked(monkeypatch):
    assert list(linedup.candidates([LONG, "own", LONG])) == [(0, 1), (2, 3)]
    monkeypatch.setattr(linedup, "WORDS", None)
    assert list(linedup.candidates([LONG])) == []
    assert all(b - a >= 2 for a, b in linedup.candidates([LONG, "own", LONG] * 5))


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", ("y",)), (2, "a\nb", "x", ("y",))], "doc_id bigint, text string, `a``b.c` string, s struct<`in side`: string>")
    out = linedup.with_fresh_lines(df)
    assert out.columns == df.columns and sorted(r["a`b.c"] for r in out.collect()) == ["x", "x"]


def test_very_frequent_chunks(documents):
    """A passage of half of all rows, and hot keys by the thousand."""
    passage = [f"shared {k} of all" for k in range(9)]
    rows = [(k, "\n".join([f"own {k}", *passage, f"end {k}"] if k % 2 else [f"line {k} {j}" for j in range(5)])) for k in range(400)]
    out = {i: t for i, t, _ in got(documents(rows))}
    assert sum("shared 4 of all" in t for t in out.values()) == 1
    assert got(documents(rows, partitions=7)) == sorted(((i, t, n) for i, t, n in got(documents(rows))), key=str)


def test_columns_stay(cases):
    out = linedup.with_fresh_lines(cases)
    assert out.columns == cases.columns and out.schema["n_chars"].dataType == cases.schema["n_chars"].dataType
    assert {r["own"] for r in out.collect()} == {"own own"}
