"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

from tools.check_oracle import compare, duck
from workload import load

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no given tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, detail, _, _ = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert status in ("ok", "ROWS"), detail
