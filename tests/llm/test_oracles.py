"""Training-data queries against their DuckDB oracles on the smallest tables."""

import pytest

from pitchline.llm import catalog
from tests.check_oracles import canonical, connect
from tests.llm.helpers import SF_DIR


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    got = catalog.QUERIES[name](spark, SF_DIR).toPandas()
    want = connect(SF_DIR).execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
