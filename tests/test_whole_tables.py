from __future__ import annotations

import os

import pytest

from semspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_tables(spark):
    n, events = catalog.table(spark, SF, "embeddings").count(), catalog.table(spark, SF, "events").count()
    averaged = catalog.QUERIES["average_files"](spark, SF)
    assert averaged.select("elem_id").distinct().count() == -(-n // 40)
    assert catalog.QUERIES["probe_series_round_trip"](spark, SF).count() == n
    assert catalog.QUERIES["index_round_trip"](spark, SF).count() == events
