"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.llm.scratch import cut, text_batches
from semspark.llm.text import slices, word_sizes

#: Rows that one flight gets; each leaves two undecided ones at most, so that levels shrink a thousandfold.
BLOCK = 2000
#: Source tables of at most so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000
EPS = 1e-9


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: share x all words by weight, at most ``most`` x its own, the excess reshared by weight."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    active = [i for i, w in enumerate(weights) if w > 0]
    while active:
        total = sum(weights[i] for i in active)
        full = {i for i in active if left * weights[i] / total > most * sizes[i]}
        if not full:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        active = [i for i in active if i not in full]
    return out


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities p to 0 or 1 along the null space of the totals (documents, words), three rows at a time.

    Both totals stay as they are and each row's expectation too. At most two rows stay between 0 and 1: the last in
    order, so that callers give large documents first.
    """
    p = [float(x) for x in p]
    size = [float(x) for x in size]
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    held: list[int] = []
    draws: list[float] = []
    while True:
        while len(held) < 3 and (i := next(waiting, None)) is not None:
            held.append(i)
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u, strict=True) if x)
        if not draws:
            draws = rng.random(256).tolist()
        step = up if draws.pop() * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0 < p[i] < 1]
    return np.array([float(round(x)) if x < EPS or x > 1 - EPS else x for x in p])


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the few probabilities left (the first 12 by all choices, any beyond by themselves) to the nearest totals."""
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
    left = np.flatnonzero((p > 0) & (p < 1))
    p[left[12:]] = np.round(p[left[12:]])
    left = left[:12]
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(choices @ size[left] - p[left] @ size[left])
        docs = np.abs(choices.sum(1) - p[left].sum())
        p[left] = choices[np.lexsort((np.arange(len(choices)), docs, words))[0]]
    return p


def exchange(size: np.ndarray, p: np.ndarray, x: np.ndarray, words: float, most: int = 64) -> np.ndarray:
    """Bring the words of the choice x (0 or 1 where p lies between) near a total: rows in and out, one for one.

    Each step makes the one exchange, or else the one addition or removal, that leaves the least error, as long as there
    is one that lessens it. Rows that aren't up to chance stay.
    """
    x, free = x.copy(), (p > EPS) & (p < 1 - EPS)
    for _ in range(most):
        error = words - float(size @ x)
        inside, outside = np.flatnonzero(free & (x > 0.5)), np.flatnonzero(free & (x < 0.5))
        outside = outside[np.argsort(size[outside], kind="stable")]
        found = [(abs(error), -1, -1)]
        if len(outside):
            leave = np.concatenate((inside, [-1]))
            want = error + np.where(leave >= 0, size[leave], 0.0)
            right = np.searchsorted(size[outside], want)
            for at in (np.minimum(right, len(outside) - 1), np.maximum(right - 1, 0)):
                miss = np.abs(want - size[outside[at]])
                k = int(np.argmin(miss))
                found.append((float(miss[k]), int(leave[k]), int(outside[at[k]])))
        if len(inside):
            miss = np.abs(error + size[inside])
            k = int(np.argmin(miss))
            found.append((float(miss[k]), int(inside[k]), -1))
        best, out, into = min(found)
        if best >= abs(error) - 1e-6 or out == into == -1:
            break
        x[[i for i in (out,) if i >= 0]] = 0.0
        x[[i for i in (into,) if i >= 0]] = 1.0
    return x


def mix(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: id, source, size, source_size, target, copies, taken (words).

    A document of a source with target t and s words is taken floor(t / s) times, and once more with probability
    frac(t / s), by a sample that is balanced on documents and words within each source. Sizes are counts of words
    between ASCII blanks, 0 for a null text; sources are ordered by code point, null last, and the weights repeat. Sources
    without words have target 0. Repeated rows are sampled each. Choices come from hashes of ids and texts: reruns agree.

    The flight runs in blocks of about BLOCK rows per source, whatever a source's size; its undecided rows (two for each
    block at most) go through the next level's blocks, until one block is left for each source, which is landed; exchanges
    within that block then make up for what the last rounding missed. An empty table gives no rows, a very long text is
    counted whole, and other columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    text_batches(spark)
    docs = documents.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, texts = batch.column("id"), batch.column("text")
            key = [xxhash.xxh64_intdigest(f"{i}\0{t}".encode(), 5) >> 1 for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, batch.column("source"), pa.array(key, pa.int64()), pa.array(word_sizes(texts))], names=["id", "source", "key", "size"])

    sized = cut(docs.mapInArrow(measure, f"id {kind}, source string, key long, size long"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row per source
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share, most)
    rows = [(r["source"], i, r["size"], float(t), t / r["size"] if r["size"] else 0.0, math.ceil(r["n"] / BLOCK)) for i, (r, t) in enumerate(zip(sums, aims, strict=True))]
    table = spark.createDataFrame(rows, "name string, rank int, source_size long, target double, ratio double, blocks int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    units = sized.join(table, sized["source"].eqNullSafe(table["name"])).drop("name")
    units = units.withColumn("x", F.col("ratio") - F.floor("ratio"))

    def fly(last: bool, level: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
            seed = [level, int(group["rank"].iloc[0]), int(group["block"].iloc[0])]
            size = group["size"].to_numpy(np.float64)
            p = group["x"].to_numpy()
            x = flight(size, p, np.random.default_rng(seed))
            group["x"] = exchange(size, p, landing(size, x), float(size @ p)) if last else x
            return group

        return run

    blocks, level, done = max([1, *(r[5] for r in rows)]), 0, None
    while True:
        shrink = F.greatest(F.col("blocks"), F.lit(1))
        open_ = units if level == 0 else units.where("x > 0 AND x < 1")
        if level:
            settled = units.where("x = 0 OR x = 1")
            done = settled if done is None else done.unionByName(settled)
        open_ = open_.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), shrink.cast("long")).cast("int"))
        flown = open_.groupBy("rank", "block").applyInPandas(fly(blocks <= 1, level), open_.schema).drop("block")
        if blocks <= 1:
            break
        units = cut(flown.withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK).cast("int")))
        blocks, level = math.ceil(blocks * 2 / BLOCK), level + 1
    out = flown if done is None else done.unionByName(flown)
    copies = (F.floor("ratio") + F.col("x")).cast("int")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies.cast("long") * F.col("size")).alias("taken"))
