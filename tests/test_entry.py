"""The entry module with and without what the text operators need."""

import subprocess
import sys

from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import sys
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
queries, sql = e.queries(), e.oracle_sql()
assert len(queries) >= 240 and set(sql) <= set(queries)
assert not {missing!r} or not any(n.startswith("op") or n == "pipeline" for n in queries)
"""


def test_entry_stands_alone():
    for missing in ((), ("tiktoken",), ("lodestone.llm",), ("corpus_pipeline",)):
        subprocess.run([sys.executable, "-W", "ignore", "-c", CODE.format(missing=missing)], cwd=ROOT, check=True, timeout=300)
