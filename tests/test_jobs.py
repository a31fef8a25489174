"""Every registered job against its SQL twin on the smallest tables."""

import os

import pytest
from compare import compare, duck

from demandloom.plans.registry import load

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    message = compare(QUERIES[name](spark, SF_DIR), con, TWINS[name])
    assert message.startswith("ok"), message
    assert "TYPES" not in message, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
