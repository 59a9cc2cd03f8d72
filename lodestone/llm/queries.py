"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, chat, exact, fingerprints, html, langid, linedup, packing, simhash, toxicity
from lodestone.llm.common import table

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACKED = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN

EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, g.text_sha256 FROM n JOIN g USING (norm)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_fingerprints": lambda spark, d: fingerprints.op1(documents(spark, d)),
        "op2_byte_bpe": lambda spark, d: bpe.op2(documents(spark, d), MULTI, PATTERN),
        "op3_language": lambda spark, d: langid.op3(documents(spark, d), PIECES),
        "op4_line_dedup": lambda spark, d: linedup.op4(documents(spark, d)),
        "op5_toxicity": lambda spark, d: toxicity.op5(documents(spark, d), table(spark, d, "labels")),
        "op6_html": lambda spark, d: html.op6(table(spark, d, "pages")),
        "op7_packing": lambda spark, d: packing.op7(documents(spark, d), PACKED, PATTERN),
        "op8_simhash": lambda spark, d: simhash.op8(documents(spark, d)),
        "op9_rotations": lambda spark, d: chat.op9(table(spark, d, "conversations")),
        "op10_exact_dedup": lambda spark, d: exact.op10(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_rotations": chat.SQL, "op10_exact_dedup": EXACT_SQL}
