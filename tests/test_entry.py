"""The entry point without what the corpus operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).parents[1]
PROBE = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
from matchlake import plans
assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.SQL) <= set(entry.oracle_sql())
print(sorted(set(entry.queries()) - set(plans.QUERIES) - {{"pipeline"}}))
"""


@pytest.mark.parametrize("name", ["matchlake.llm", "ahocorasick", "xxhash", "zstandard"])
def test_the_catalog_stays(name):
    """With a package or the folder hidden, all queries of the catalog are there, and none of the operators (the pipeline may do without what it doesn't use)."""
    out = subprocess.run([sys.executable, "-c", PROBE.format(name=name)], cwd=TOP, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[]"
