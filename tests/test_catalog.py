"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.compare import differences
from wordtide.plans import catalog  # importing the package registers all

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert differences(df, catalog.SQL[name], SF) == ""
    else:
        assert df.columns and df.collect() is not None
