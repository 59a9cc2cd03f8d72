"""op10 against a dictionary of texts."""

import bisect
import hashlib
import random
from collections import defaultdict

import pytest

from lodestone.llm import exact

from .conftest import CASES

LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, pick=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = pick((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def got(df, keep="most"):
    return sorted((tuple(r) for r in exact.deduplicate(df, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_whole_table(whole):
    assert got(whole[1]) == expected(whole[0])
    assert got(whole[1], "least") == expected(whole[0], min)


def test_cases(cases):
    assert got(cases) == expected(CASES)


def test_empty_table(documents):
    assert got(documents([])) == []


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_groups_over_many_ranges(spark, documents, ranges):
    """Most rows are copies of one text, so runs cross the borders of ranges."""
    rows = [(k, "The same text, Again" if k % 3 else f"Text {k % 17}") for k in range(600)] + [(1000 + k, "a beginning that they share " * 9 + str(k % 23 if k % 2 else 7)) for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert got(documents(rows, partitions=7)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_hold_even_parts_of_the_bytes_in_order(documents):
    dice = random.Random(2)
    rows = [(k, "".join(dice.choice("abC é") for _ in range(dice.randint(0, 60))) * (60 if k % 50 == 0 else 1)) for k in range(4000)]
    splits = exact.splitters(documents(rows).select("doc_id", "text"), 8)
    size = [0] * 8
    for i, t in rows:
        size[bisect.bisect_right(splits, (exact.normalise(t), i))] += len(exact.normalise(t)) + 64
    assert splits == sorted(splits) and len(splits) == 7 and max(size) < 2 * sum(size) / 8
