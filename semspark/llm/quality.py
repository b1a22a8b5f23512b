"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.llm.scratch import cut, share, text_batches
from semspark.llm.text import BLANKS_KEEP_CASE, fields, slices

#: Share of the pooled diagonal in each class's covariance, and what is added to the variances of unit scale.
SHRINKAGE, RIDGE = 0.1, 0.3
#: Discriminants beyond this say no more.
CLIP = 30.0

NAMES = ["words", "word_bytes", "line_bytes", "upper", "digits", "marks", "stops", "beyond_ascii", "bare_marks", "distinct_words", "distinct_lines", "distinct_sentences", "longest_word", "top_word"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_ALPHA = bytes(range(65, 91)) + bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOP = b".,;:?!'\"()-"
_MARK = bytes(c for c in range(33, 127) if c not in _ALPHA + _DIGIT + b".,;:?'\"()-")
CLASSES = np.stack([_class(bytes(range(65, 91))), _class(_DIGIT), _class(_MARK), _class(b".,;:?"), _class(bytes(range(128, 256)))], 1)
_NO_WORD = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_SENTENCE = re.compile(rb"[.?!]\s")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics: logarithms of sizes, square roots of shares. A text without words has zeros but for the distinct shares."""
    raw = (text or "").encode()
    words = raw.translate(BLANKS_KEEP_CASE).split()
    if not words:
        return [0.0] * 9 + [1.0, 1.0, 1.0, 0.0, 0.0]
    n, size = len(words), sum(map(len, words))
    upper, digits, marks, stops, beyond = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = [x for x in _SENTENCE.split(raw) if x.strip()] or [raw]
    bare = sum(1 for w in words if w[0] in _NO_WORD and not w.strip(_NO_WORD))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(n)), float(np.log(size / n)), float(np.log(len(raw) / len(lines))),
        root(upper / size), root(digits / size), root(marks / size), root(stops / size), root(beyond / size), root(bare / n),
        # a long text repeats words by nature: its distinct words against the square root of all
        float(np.log(len(seen) / n**0.75)), root(len(set(lines)) / len(lines)), root(len(set(sentences)) / len(sentences)),
        float(np.log(max(map(len, words)))), root(max(seen.values()) / n),
    ]


class Discriminant(NamedTuple):
    """Cached for each class: the mean, the inverse Cholesky factor of its covariance, and the constant terms."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(label 1): the logistic of the difference of log densities, Mahalanobis distances included, and priors."""
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -CLIP, CLIP)))


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> Discriminant | float:
    """From each label's count, sums and sums of products; with one label only, that label's share."""
    n = {k: m[0] for k, m in moments.items() if m[0] > 0}
    if len(n) < 2:
        return float(next(iter(n), 0.5))
    total = sum(n.values())
    centre = sum(moments[k][1] for k in n) / total
    means = {k: moments[k][1] / n[k] for k in n}
    cov = {k: moments[k][2] / n[k] - np.outer(means[k], means[k]) for k in n}
    pooled = sum(cov[k] * n[k] for k in n) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    whiten, constants, mid = [], [], []
    for k in (0, 1):
        c = cov[k] / np.outer(scale, scale)
        weight = SHRINKAGE + (1 - SHRINKAGE) * len(scale) / (len(scale) + n[k])
        c = (1 - weight) * c + weight * np.diag(np.diag(pooled) / scale**2) + RIDGE * np.eye(len(scale))
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low))
        mid.append((means[k] - centre) / scale)
        constants.append(np.log(n[k] / total) - np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, np.array(mid), np.array(whiten), np.array(constants))


def features(docs: DataFrame) -> DataFrame:
    """(row, x) from rows (row, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), x], names=["row", "x"])

    return docs.mapInArrow(work, fields("x array<double>", row=docs.schema["row"].dataType))


def moments(table: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of x by label, over all rows, aggregated where they lie."""
    k = len(NAMES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col("x")[i] for i in range(k)]
    got = table.groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("p")).collect()
    out = {}
    for r in got:
        p = np.zeros((k, k))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            p[i, j] = p[j, i] = v
        out[r["label"]] = (r["n"], np.array(r["s"]), p)
    return out


def score(documents: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: bool = False) -> DataFrame:
    """Per row: id (if carry, instead a struct ``row`` of all columns), held_out, score and predicted.

    ``learns`` is a condition on id_col that says whose labels may be learned; all of them count, through sums by label.
    A document with both labels counts as 1; null ids and labels teach nothing. Empty and null texts have the statistics of
    no words. With one label only every score is that label's, without any 0.5. Repeated rows are scored each, an empty
    table gives none; a very long text is measured whole, its words held as one list; other columns are never read.
    """
    text_batches(documents.sparkSession)
    learn = F.coalesce(learns, F.lit(False)).alias("learn")
    if carry:
        whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
        docs = documents.select(F.struct(whole.alias("whole"), F.col(id_col).alias("id"), learn).alias("row"), F.col(text_col).cast("string").alias("text"))
    else:
        docs = documents.select(F.struct(F.col(id_col).alias("id"), learn).alias("row"), F.col(text_col).cast("string").alias("text"))
    table = cut(features(docs).select("row.*", "x"))  # the statistics are made once, for fitting and for scoring
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    model = share(documents.sparkSession, fit(moments(table.where("learn").select("id", "x").join(known, "id"))))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            p = np.full(len(x), m) if isinstance(m, float) else m.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    table = table.select(F.col("whole").alias("row") if carry else F.struct("id", "learn").alias("row"), "x")
    out = table.mapInArrow(rate, fields("score double, predicted int", row=table.schema["row"].dataType))
    if carry:
        return out.select("row", "score", "predicted")
    return out.select(F.col("row.id").alias(id_col), (~F.col("row.learn")).alias("held_out"), "score", "predicted")
