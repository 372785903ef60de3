"""Every registered query with an oracle gives the oracle's rows on the small files."""

import pytest
from oracle import SMALL, compare, connect

from strandline.plans.registry import load_all


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(load_all()))
def test_matches_oracle(name, spark, con):
    ok, note = compare(load_all()[name], spark, con, SMALL)
    assert ok, note
