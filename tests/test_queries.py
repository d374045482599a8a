"""Every raster query against its SQL; those without SQL must give rows."""

import pytest

from tests.conftest import SMALL
from tileforge.jobs import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, same):
    if name in queries.SQL:
        same(queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, SMALL).count() > 0
