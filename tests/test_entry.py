"""Every registered query of the core beside its SQL, and the shape of the plans."""

import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from seqloom.plans import analytics, generic, ingest, problems
from tests.compare import compare, connect

CORE = {k: f for m in (problems, analytics, ingest, generic) for k, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.fixture(scope="module", autouse=True)
def one_sequence():
    """The panels' queries read one written sequence for each set of columns instead of writing it anew."""
    real, known = analytics.canonical, {}
    patch = pytest.MonkeyPatch()
    for module in (analytics, ingest):
        patch.setattr(module, "canonical", lambda spark, d, *extra: known[d, extra] if (d, extra) in known else known.setdefault((d, extra), real(spark, d, *extra)))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, con, name):
    ok, text = compare(spark, data, name, CORE[name], entry.oracle_sql().get(name), con)
    assert ok, text


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_training_data_package():
    code = "import sys; sys.modules['seqloom.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


@pytest.mark.parametrize("name", ["p1_found", "header_stats", "hook_lift", "survival_curve", "relay_events"])
def test_no_cartesian_products_and_narrow_scans(spark, data, name):
    plan = CORE[name](spark, data)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    # a frame may be the whole partition, but none may move at its start and end at unboundedFollowing
    assert not re.search(r"frame,(?!unboundedpreceding)[^,]*,unboundedfollowing", plan.lower().replace(" ", ""))
    assert not any("response_size" in schema for schema in re.findall(r"ReadSchema: (struct<.*?>)", plan))
