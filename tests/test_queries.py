"""Every registered query equals its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from choicemill.oracles import ORACLES
from choicemill.queries import QUERIES
from tests.conftest import SF
from tests.oracle import compare

# No SQL counterpart: fitted by iterative or matrix methods, tested on their own.
ROWS_ONLY = {"ridge_coefficients", "ridge_errors", "ridge_test_results", "ridge_ablation", "ridge_ablation_errors",
             "boosted_fits", "boosted_results"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_equals_sql(spark, con, name):
    out = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert out["equal"], out["note"]


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
