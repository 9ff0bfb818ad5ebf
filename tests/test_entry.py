"""The entry module without the optional corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

# Makes the import of one module fail, then asks the entry for its queries.
SCRIPT = """
import sys
class Refusing:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Refusing())
import __spark_entry__ as entry
from farepath.registry import ORACLE_SQL, QUERIES
assert set(entry.queries()) == set(QUERIES), set(entry.queries()) ^ set(QUERIES)
assert set(entry.oracle_sql()) == set(ORACLE_SQL)
"""


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "farepath.llm"])
def test_other_queries_stay_when_an_import_fails(missing):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
