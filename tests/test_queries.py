"""Every registered query of the page engine against its SQL."""

import pytest

from pagevault.plans import registry

from conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    theirs = sorted(repr(r) for r in want.select(", ".join(columns)).fetchall())
    assert mine == theirs and mine


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())


def test_without_the_optional_subpackage():
    """Nothing else imports it: the rest works where it is missing."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('pagevault.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from pagevault.plans import registry
assert set(e.queries()) == set(registry.QUERIES)
import pagevault.collect, pagevault.sources, pagevault.sinks, pagevault.streaming
"""
    from conftest import ROOT

    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_metadata_plan_reads_only_what_it_needs(spark):
    plan = registry.QUERIES["target_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "Exchange" not in plan
    plan = registry.QUERIES["last_write_wins"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and plan.count("Exchange hash") == 1
