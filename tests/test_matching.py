"""Both sources of product matching are matched whole."""
import os

import pytest

from tagloom.plans import load

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_every_product_of_the_sources_is_matched(spark):
    n = spark.read.parquet(f"{SMALL}/part.parquet").count()
    found = load().QUERIES["product_matches"](spark, SMALL).collect()
    assert len({r.left_id for r in found}) == len(found) == n
