"""Every registered query against its SQL, and the driver's contract."""

import __spark_entry__ as entry
import pytest

from wardline.plans.check import compare
from wardline.plans.registry import QUERIES, double_literals

SLOW = {"bake_off", "hyper_search", "seed_sweep", "permutation_importance", "leakage_audit", "grouped_oof", "gbt_scores", "serving_risk"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, sf, name):
    result = compare(spark, sf, [name], verbose=False)[name]
    assert not result.startswith("FAIL"), result


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert len(entry.oracle_sql()) > 80


def test_double_literals():
    assert double_literals("select 0.5, 'a 0.5 b', 1e-9, t1.x") == "select 0.5e0, 'a 0.5 b', 1e-9, t1.x"
