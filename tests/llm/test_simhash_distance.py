from __future__ import annotations

import pytest

from semspark.llm import simhash


@pytest.mark.parametrize("distance", [-1, 64])
def test_unsupported_distance(spark, distance):
    with pytest.raises(ValueError, match="bits"):
        simhash.links(spark.createDataFrame([(7,), (0,)], "fp long"), distance)


def test_rows_of_one_id_and_text(spark, monkeypatch):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "w"), (2, "a b c d e f", "y"), (3, "q r s t u", None), (3, "q r s t u", None), (None, "lone words here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(tuple, simhash.deduplicate(df.repartition(n)).collect()), key=str) for n in (1, 3)]
    assert got[0] == got[1] and sorted(str(r[0]) for r in got[0]) == ["1", "3", "None"]
    from semspark.llm import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, simhash.deduplicate(df).collect()), key=str) == got[0]
