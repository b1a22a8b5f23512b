"""Comparisons within groups of any size, dealt to tasks in pairs of blocks so that no task ever holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one block; a task compares two of them at a time.
BLOCK = 1024


def by_blocks(rows: DataFrame, keys: list[str], node: str, compare: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, block: int | None = None) -> DataFrame:
    """compare(left, right, same) for all pairs of blocks of the rows of a key; same tells that both are one block.

    A group of n rows makes n / block blocks, and each row travels once for each of them.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias("blocks"))
    dealt = rows.join(counts, keys).withColumn("block", F.pmod(F.xxhash64(node), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")

    def work(table: pa.Table) -> pa.Table:
        own = table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = table.filter(pa.array(own == i)), table.filter(pa.array(own == j))
        return compare(left, right, i == j)

    return dealt.groupBy(*keys, "i", "j").applyInArrow(work, schema)


def forest(near: np.ndarray) -> np.ndarray:
    """The least member of each one's component, from a symmetric matrix that says who is near whom."""
    label = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        least = np.where(near, label[None, :], len(label)).min(1, initial=len(label))
        least = np.minimum(least, least[np.minimum(least, len(label) - 1)])
        if (least == label).all():
            return label
        label = least
