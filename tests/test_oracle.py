"""Every registered query against its DuckDB SQL at sf0.001."""

import os

import pytest

from ledgerlens.plans.registry import all_oracles, all_queries

from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(all_oracles())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = all_queries()[name](spark, SF)
    reason = compare(df, con, all_oracles()[name])
    assert reason is None, reason


def test_every_query_registered_with_docstring():
    qs = all_queries()
    for name, fn in qs.items():
        assert (fn.__doc__ or "").strip(), name
