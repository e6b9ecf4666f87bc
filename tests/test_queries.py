import subprocess
import sys

import pytest

from evigraph.plans import assembly, code, domains, extraction, layers, manifests, nested, overlays, reports, scalars, snapshots, stores, traces  # noqa: F401  register their queries
from tests.conftest import ROOT, SF


@pytest.mark.parametrize("name", sorted(extraction.oracle_sql()))
def test_query_equals_sql(spark, duck, same_rows, name):
    same_rows(extraction.queries()[name](spark, SF), duck.sql(extraction.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_needs_no_session_to_be_imported():
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 200)"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert told.stdout.strip() == "True", told.stderr
