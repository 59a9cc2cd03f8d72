"""Every registered query of the subpackage runs on a fixture and gives the columns of its contract."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op2": "doc_id n_tokens ids_sha256 decoded_sha256", "op3": "doc_id held_out lang_pred score", "op4": "doc_id text", "op5": "doc_id held_out score predicted",
    "op6": "page_id url text n_chars", "op7": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op8": "doc_id fingerprint component_id", "op9": "conv_id perspective segment", "op10": "doc_id keep_id group_size kept text_sha256",
}


@pytest.mark.parametrize("op", COLUMNS)
def test_columns(spark, op):
    (name,) = [k for k in __spark_entry__.queries() if k.startswith(f"{op}_")]
    df = __spark_entry__.queries()[name](spark, SF)
    assert set(COLUMNS[op].split()) <= set(df.columns)
    assert df.count() >= spark.read.parquet(f"{SF}/{'pages' if op == 'op6' else 'conversations' if op == 'op9' else 'documents'}.parquet").count()


def test_sql(spark):
    from lodestone.llm import queries

    c = duckdb.connect()
    for name in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, text in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = ", ".join(df.columns)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(c.execute(f"SELECT {columns} FROM ({text})").fetchall(), key=str)
