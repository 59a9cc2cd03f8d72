import pytest

#: doc_id and text of the cases that every operator on documents has to take.
CASES = [
    (1, None), (2, ""), (3, " \n\t  \n"), (4, "one two"), (5, "One TWO"), (5, "One TWO"), (None, "x y z"), (None, None), (6, "word " * 60_000), (7, "ÀÉß ÄÖ 東京都    \U0001f600é́"), (8, "<|endoftext|> <|im_start|>a"),
    (9, "x" * 20_000), (10, "\n".join(["a line that is said again"] * 40)), (11, "one two three four five six"), (12, "one two three four five six"), (13, "9 8 7 !?"), (14, "\x00\x1c\x85  end"), (-3, "one two three four five seven"),
]
#: Columns that clash with names that operators use inside.
CLASHING = ("own", "successor", "__at", "__place", "fp", "h", "g", "part", "row", "grp", "th", "__th", "__gone", "__of", "__on", "__kept", "score", "Lang_Pred", "__language", "__certainty", "__toxicity", "ids", "crcs", "component_id", "kept", "size")


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables from (doc_id, text) rows, with clashing columns unless told otherwise."""

    def make(rows, clashing=True, partitions=3):
        names = CLASHING if clashing else ()
        schema = ", ".join(["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *(f"`{c}` string" for c in names)])
        full = [(i, t, "en" if (i or 0) % 2 else None, None, None if t is None else len(t), *(f"own {c}" for c in names)) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def cases(documents):
    return documents(CASES)


@pytest.fixture(scope="session")
def whole(spark):
    """doc_id and text of a whole fixture table, and the table."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df
