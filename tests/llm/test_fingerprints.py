"""op1 against sketches made in Python."""

import base64
import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fingerprints as fps

from .conftest import CASES


def signed(x):
    return x - 2**64 if x >> 63 else x


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h >> 1


def hashes(text):
    spoken = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if not spoken:
        return set()
    return {chained(spoken[i : i + 5]) for i in range(len(spoken) - 4)} if len(spoken) >= 5 else {chained(spoken)}


def sketch(text):
    """Limit and hashes."""
    h = hashes(text)
    limit = next((min(2**63 - 1, 2**63 >> k) for k in range(3) if len(h) / 2**k <= 48), 2**60)
    return limit, {x for x in h if x <= limit}


def likeness(a, b):
    limit = min(a[0], b[0])
    x, y = ({h for h in s if h <= limit} for _, s in (a, b))
    return len(x & y) / len(x | y) if x | y else float(a == b)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, other = text or "", rows[(k + 1) % len(rows)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + other[:part]
        a, b, c = sketch(text), sketch(edited), sketch(other)
        join = lambda s: base64.b64encode(b"".join(x.to_bytes(8) for x in [s[0], *sorted(s[1])])).decode()
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), join(a), join(b), round(likeness(a, b), 12), round(likeness(a, c), 12)))
    return sorted(out, key=str)


def got(df):
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted(((*(r[n] for n in names[:5]), round(r.near_edited, 12), round(r.near_next, 12)) for r in fps.op1(df).collect()), key=str)


def test_whole_table(whole):
    assert got(whole[1]) == expected(whole[0])


def test_cases(cases):
    # Java and Python lower-case and space alike in these texts.
    assert got(cases) == expected(CASES)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(documents, n):
    rows = [(k, f"text number {k} of a few") for k in range(n)]
    assert got(documents(rows)) == expected(rows)


def test_merge_is_sketch_of_both(spark):
    a, b = " ".join(f"a{k}" for k in range(300)), "b c"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fps.merge(fps.sketch(F.col("a")), fps.sketch(F.col("b"))).alias("m"), fps.containment(fps.sketch(F.col("a")), fps.sketch(F.concat_ws(" ", "a", "a"))).alias("c")).first()
    both = hashes(a) | hashes(b)
    assert (row.m.limit, set(row.m.hashes)) == (2**60, {x for x in both if x <= 2**60})
    assert row.m.hashes == sorted(row.m.hashes)
    assert row.c == 1.0


def test_contained_short_texts(spark):
    """None of 100 short texts that a long one holds is said to be outside of it, and of those that it doesn't hold none to be inside."""
    words = [f"w{k * k % 9973}x{k}" for k in range(4000)]
    rows = [(" ".join(words[k * 40 : k * 40 + 8]), " ".join(words), " ".join(f"o{k}y{j}" for j in range(8))) for k in range(100)]
    df = spark.createDataFrame(rows, "s string, l string, o string").select(*[fps.sketch(F.col(c)).alias(c) for c in "slo"])
    found = df.select(fps.containment(F.col("s"), F.col("l")).alias("inside"), fps.containment(F.col("o"), F.col("l")).alias("outside"), fps.containment(F.col("s"), fps.merge(F.col("s"), F.col("o"))).alias("merged")).collect()
    assert {r.inside for r in found} == {1.0, None} and {r.outside for r in found} == {0.0, None} and {r.merged for r in found} == {1.0}
    assert sum(r.inside == 1.0 for r in found) > 20


@pytest.mark.parametrize("n", [10, 40, 60, 150, 250, 450, 600, 2000])
def test_error_by_length(spark, n):
    """Root mean square error of the likeness of a text and its edited text, by number of words: no more than 0.12 at any length."""
    rows = [(" ".join(f"a{k}b{i}" for i in range(n)), " ".join([f"a{k}b{i}" for i in range(n * 2 // 3)] + [f"c{k}d{i}" for i in range(n - n * 2 // 3)])) for k in range(60)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(fps.likeness(fps.sketch(F.col("a")), fps.sketch(F.col("b")))).collect()]
    true = [len(hashes(a) & hashes(b)) / len(hashes(a) | hashes(b)) for a, b in rows]
    assert (sum((x - y) ** 2 for x, y in zip(got, true)) / len(rows)) ** 0.5 <= (0.12 if n > 48 else 1e-12)


def test_estimates_containment_of_unequal_texts(spark):
    small = " ".join(f"w{k * k}" for k in range(400))
    large = small + " " + " ".join(f"v{k}" for k in range(40_000))
    half = " ".join(small.split()[:200] + [f"z{k}" for k in range(200)])
    df = spark.createDataFrame([(small, large, half)], "s string, l string, h string")
    s, l, h = (fps.sketch(F.col(c)) for c in "slh")
    r = df.select(fps.containment(s, l).alias("all"), fps.containment(h, l).alias("half")).first()
    assert r["all"] == 1.0 and 0.3 < r["half"] < 0.7


def test_no_python_in_the_plan(spark, whole):
    plan = spark._jvm.PythonSQLUtils.explainString(fps.op1(whole[1])._jdf.queryExecution(), "simple")
    assert not re.search("Python|Pandas|Arrow", plan)
