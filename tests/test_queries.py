"""Every registered reference query against its SQL, and that the others run."""

import os

import pytest
from conftest import SF, compare

from veilsight.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(5).collect() is not None
