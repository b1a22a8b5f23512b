"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semspark.llm.scratch import cut, opened

#: Queries and candidates that a task holds at once, candidates in a vertical block, dimensions between two compactions.
QUERIES, ROWS, CANDIDATES, DIMENSIONS = 2048, 1 << 16, 4096, 16
SCALE = 256


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) with x as double, in 64-bit integers."""
    return np.floor(SCALE * values.astype(np.float64)).astype(np.int64)


def valid(batch: pa.Array) -> np.ndarray:
    """Which vectors are neither null nor empty nor hold a null or non-finite component."""
    out = np.array(batch.is_valid())
    flat = batch.flatten()
    bad = np.concatenate(([0], np.cumsum(~(np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64)) & np.array(flat.is_valid()))))) if len(flat) else np.zeros(1, int)
    sizes = batch.value_lengths().fill_null(0).to_numpy()
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return out & (sizes > 0) & (bad[ends[1:]] == bad[ends[:-1]])


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows of integers) of the valid vectors with an id, by length."""
    ok = valid(vectors) & np.array(ids.is_valid())
    ids, vectors = ids.filter(pa.array(ok)), vectors.filter(pa.array(ok))
    sizes = vectors.value_lengths().to_numpy() if len(vectors) else np.zeros(0, int)
    for size in np.unique(sizes):
        some = pa.array(sizes == size)
        yield ids.filter(some).to_numpy(), quantised(vectors.filter(some).flatten().to_numpy()).reshape(-1, size)


class Search:
    """The best k of all candidates seen so far for each query of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        order = np.argsort(-np.abs(rows).sum(0), kind="stable")  # dimensions of most mass first
        self.order, self.vertical = order, rows[:, order]
        self.rest = self._rest(self.vertical)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.evaluated = 0

    @staticmethod
    def _rest(rows: np.ndarray) -> np.ndarray:
        """By block, the length of what remains of each row from that block on, rounded up."""
        starts = range(0, rows.shape[1], DIMENSIONS)
        return np.stack([np.sqrt((rows[:, d:].astype(np.float64) ** 2).sum(1)) * (1 + 1e-12) + 1e-9 for d in starts])

    def found(self) -> pa.RecordBatch:
        n = [len(ids) for ids, _ in self.best]
        columns = [np.repeat(self.ids, n), np.concatenate([i for i, _ in self.best]), np.concatenate([x for _, x in self.best])]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "id", "score"])

    def feed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(ids), CANDIDATES):
            part = rows[at : at + CANDIDATES][:, self.order]
            self._block(ids[at : at + CANDIDATES], np.ascontiguousarray(part.T), self._rest(part))

    def _block(self, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray) -> None:
        wide = columns.astype(np.float64)
        exact = max(1.0, float(np.abs(wide).max(initial=0))) * max(1.0, float(np.abs(self.vertical).max(initial=0))) * len(columns) < 2.0**52
        first = self.vertical[:, :DIMENSIONS].astype(np.float64) @ wide[:DIMENSIONS] if exact else None
        for q in range(len(self.ids)):
            own_ids, own = self.best[q]
            row, worst = self.vertical[q], own[-1] if len(own) >= self.k else None
            left = np.flatnonzero(ids != self.ids[q])
            sums = None
            for b, d in enumerate(range(0, len(columns), DIMENSIONS)):
                if b == 0 and exact:
                    sums = first[q, left]
                else:
                    block = wide if exact else columns
                    part = block[d : d + DIMENSIONS] if len(left) == len(ids) else block[d : d + DIMENSIONS, left]
                    more = row[d : d + DIMENSIONS].astype(block.dtype) @ part
                    sums = more if sums is None else sums + more
                if worst is not None and d + DIMENSIONS < len(columns):
                    keep = sums + self.rest[b + 1, q] * rest[b + 1, left] >= worst
                    left, sums = left[keep], sums[keep]
                    if not len(left):
                        break
            self.evaluated += len(left)
            if len(left):
                score = sums.astype(np.int64)
                all_ids, all_scores = np.concatenate((own_ids, ids[left])), np.concatenate((own, score))
                if len(all_scores) > 4 * self.k:
                    some = np.argpartition(-all_scores, self.k - 1)[: self.k]
                    at = np.flatnonzero(all_scores >= all_scores[some].min())
                    all_ids, all_scores = all_ids[at], all_scores[at]
                top = np.lexsort((all_ids, -all_scores))[: self.k]
                self.best[q] = all_ids[top], all_scores[top]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score: each query's k highest integer inner products, ties to smaller ids.

    Components become floor(256 x). Candidates are all rows but those of the query's own id, of the query's length. Vectors
    null, empty, or holding null or non-finite components take no part, nor do null ids. Repeated candidates count each,
    repeated queries once (the greatest vector). Products must fit 64 bits. An empty table gives no rows; other columns,
    whatever their names, are not read.

    Queries are written to the shared folder and never pass the driver. Candidates stay where they are: a task makes a
    vertical block of up to ROWS of them, streams the queries past it, QUERIES at a time, and sends on k rows for each
    query and block. Inner products accumulate DIMENSIONS at a time; a candidate is dropped once its sum and the product of
    the remaining lengths fall below the k-th best so far. The work is queries times candidates less what the bounds drop.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    queries = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = queries.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    files = sorted(cut(queries.groupBy("id").agg(F.max("v").alias("v")).where("v IS NOT NULL")).inputFiles())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, ids, candidates in chunks(batches):
            for file in files:
                with opened(file) as source:
                    for batch in pq.ParquetFile(source).iter_batches(QUERIES):
                        for own, m in matrices(batch.column(0), batch.column(1)):
                            if m.shape[1] == size:
                                search = Search(own, m, k)
                                search.feed(ids, candidates)
                                yield search.found()

    found = rows.mapInArrow(work, "query_id long, id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, rows of integers) of the valid vectors, up to about ROWS of a length at a time."""
    held: dict[int, list] = {}
    for batch in batches:
        for ids, m in matrices(batch.column("id"), batch.column("v")):
            held.setdefault(m.shape[1], []).append((ids, m))
            if sum(len(x) for x, _ in held[m.shape[1]]) >= ROWS:
                some = held.pop(m.shape[1])
                yield m.shape[1], np.concatenate([x for x, _ in some]), np.concatenate([y for _, y in some])
    for size, some in held.items():
        yield size, np.concatenate([x for x, _ in some]), np.concatenate([y for _, y in some])
