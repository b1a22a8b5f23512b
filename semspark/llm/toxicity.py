"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Every word of the examples is a term. A term weighs (1 + ln tf) x idf x (FLOOR + what it tells about the labels): the phi
coefficient between having the word and label 1, less the level that chance reaches. So words that don't tell the labels
apart count too, but less than those that do, and no list of words is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from semspark.llm.scratch import bounded_sample, cut, packed, share_packed, text_batches
from semspark.llm.text import ALNUM, fields, release, slices, tokenize, with_text

#: Bounds: labelled rows learned from (those of the least hash) and the bytes of their texts, examples in a block, neighbours.
EXAMPLES, EXAMPLE_BYTES, BLOCK, NEIGHBOURS = 8000, 64 << 20, 64, 40
#: Blocks evaluated before the first comparison of bounds; each further round takes twice as many.
FIRST = 8
#: A term is heavy from this share of a query's squared length on.
HEAVY = 0.2
#: Postings of terms that more than one example in so many has also lie as rows of a matrix, the most frequent first, within
#: these bytes; and queries multiplied with it together. That changes the order of additions only.
FREQUENT, MATRIX_BYTES, TOGETHER = 16, 32 << 20, 32
#: Postings whose weights are made at a time.
PIECE = 1 << 18
#: Weight of words that tell nothing, and the squared phi times examples that chance reaches (chi-squared, p of 0.001).
FLOOR, CHANCE = 0.01, 10.83
#: Weight of the prior among the votes, and levels of the calibration.
PRIOR, LEVELS = 1.0, 20


class Index(NamedTuple):
    """Examples in blocks; postings run by term, then by example."""

    terms: pa.StringArray
    #: Weight of each term, and of a word that no example has.
    scale: np.ndarray
    unknown: float
    ids: list
    labels: np.ndarray
    #: The postings of term t are [ptr[t], ptr[t + 1]) of examples and weights.
    ptr: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    #: Runs of a term's postings within one block: those of term t are [run_ptr[t], run_ptr[t + 1]) of the next three.
    run_ptr: np.ndarray
    run_block: np.ndarray
    run_start: np.ndarray
    run_most: np.ndarray
    #: Weights of frequent terms by example, and the row there of each term, -1 if it has none.
    matrix: np.ndarray
    row: np.ndarray
    #: Share of label 1, and the same among examples without words.
    prior: float
    bare: float


def term_counts(texts: pa.Array, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) for all words of texts, by text; place gives the numbers of an array of distinct words."""
    tokens = tokenize(texts, ALNUM)
    words = tokens.words.dictionary_encode()
    codes, owner = words.indices.to_numpy(), tokens.owners()
    size = max(len(words.dictionary), 1)
    pair, times = np.unique(owner * size + codes, return_counts=True)
    at = place(words.dictionary.cast(pa.string()))
    return pair // size, at[pair % size] if len(pair) else pair, times


def vectors(texts: pa.Array, terms: pa.StringArray, scale: np.ndarray, unknown: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its known terms and their weights; words that no example has count in the unit length."""
    owner, term, times = term_counts(texts, lambda c: pc.fill_null(pc.index_in(c, terms, skip_nulls=True), -1).to_numpy().astype(np.int64))
    w = (1 + np.log(times)) * np.where(term >= 0, scale[term] if len(scale) else 0.0, unknown)
    length = np.sqrt(np.bincount(owner, w * w, minlength=len(texts)))
    known = term >= 0
    owner, term, w = owner[known], term[known], w[known] / length[owner[known]]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield term[a:b], w[a:b]


def frequent(x: Index, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each query the part of its cosine with every example that frequent terms give."""
    w = np.zeros((len(queries), len(x.matrix)))
    for i, (term, weight) in enumerate(queries):
        row = x.row[term]
        w[i, row[row >= 0]] = weight[row >= 0]
    return w @ x.matrix


def _sums(x: Index, term: np.ndarray, w: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The cosine with every example, through all postings of the terms; common has the part of the frequent ones."""
    rare = x.row[term] < 0
    if not rare.any():
        return common
    term, w = term[rare], w[rare]
    begins, ends = x.ptr[term], x.ptr[term + 1]
    at = _spread(begins, ends - begins)
    return common + np.bincount(x.examples[at], np.repeat(w, ends - begins) * x.weights[at], minlength=len(x.ids))


def _best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest above 0 of sums rounded to 9 digits, ties to the earlier one."""
    least = np.partition(sums, len(sums) - k)[len(sums) - k] - 1e-8 if len(sums) > k else 0.0
    hit = np.flatnonzero(sums >= least)
    cos = np.round(sums[hit], 9)
    hit, cos = hit[cos > 0], cos[cos > 0]
    top = np.lexsort((hit, -cos))[:k]
    return hit[top], cos[top]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one after another."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def nearest(x: Index, term: np.ndarray, w: np.ndarray, k: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k examples of highest cosine above 0, ties to the earlier one.

    A block's bound is the sum of its largest weights. Blocks are evaluated by falling bound in rounds, and the k-th best
    so far is the threshold that the bounds of the next round's blocks have to reach. Where more than half of all blocks
    still reach it, all postings are summed at once, which is cheaper than their selection; so is a query without a
    heavy term, since sums over many small weights bound nothing. ``common`` is the query's row of ``frequent``, if known.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    if not len(term):
        return none
    if common is None:
        common = frequent(x, [(term, w)])[0]
    if w.max() ** 2 < HEAVY:
        return _best(_sums(x, term, w, common), k)
    sizes = x.run_ptr[term + 1] - x.run_ptr[term]
    runs = _spread(x.run_ptr[term], sizes)
    block, run_w = x.run_block[runs], np.repeat(w, sizes)
    blocks = -(-len(x.ids) // BLOCK)
    bounds = np.bincount(block, run_w * x.run_most[runs], minlength=blocks) * (1 + 1e-9) + 1e-9
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 1e-9]
    best, cos = none
    done, step = 0, FIRST
    while done < len(order):
        if len(cos) >= k:
            order = order[: done + int(np.searchsorted(-bounds[order[done:]], 1e-9 - cos[k - 1], "right"))]
            if done == len(order):
                break
        if done and len(order) - done > blocks // 2:
            return _best(_sums(x, term, w, common), k)
        some = np.zeros(blocks, bool)
        some[order[done : done + step]] = True
        mine = np.flatnonzero(some[block])
        n = x.run_start[runs[mine] + 1] - x.run_start[runs[mine]]
        at = _spread(x.run_start[runs[mine]], n)
        hit, place = np.unique(x.examples[at], return_inverse=True)
        sums = np.round(np.bincount(place, np.repeat(run_w[mine], n) * x.weights[at]), 9)
        best, cos = np.concatenate((best, hit[sums > 0])), np.concatenate((cos, sums[sums > 0]))
        done, step = done + step, 2 * step
        top = np.lexsort((best, -cos))[:k]
        best, cos = best[top], cos[top]
    return best, cos


def searches(x: Index, queries: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``nearest`` for each query, TOGETHER of them at a time."""
    for group in batched(queries, TOGETHER):
        for (term, w), common in zip(group, frequent(x, group), strict=True):
            yield nearest(x, term, w, k, common)


def vote(x: Index, best: np.ndarray, cos: np.ndarray) -> float:
    """Votes weigh cosine^2 / (0.05 + distance), beside the prior's: neighbours that share little say little."""
    cos = np.minimum(cos, 1)
    w = cos**2 / (1.05 - cos)
    return float((w @ x.labels[best] + PRIOR * x.prior) / (w.sum() + PRIOR))


def calibrated(curve: tuple[np.ndarray, np.ndarray], raw: float) -> float:
    return float(np.clip(np.interp(raw, *curve), 0, 1))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of label 1 by raw score, over levels of it, made to rise by pooling; it rises on between the pooled levels."""
    level = np.minimum((raw * LEVELS).astype(int), LEVELS - 1)
    blocks: list[list[float]] = []
    for i in range(LEVELS):
        mid = (i + 0.5) / LEVELS
        n = int((level == i).sum())
        blocks.append([label[level == i].sum() + mid, n + 1.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    share_ = np.array([s / n for s, n, _ in blocks])
    ends = np.cumsum([0.0, *(m for *_, m in blocks)]) / LEVELS
    return np.concatenate(([0.0], (ends[1:] + ends[:-1]) / 2, [1.0])), np.concatenate(([share_[0] / 2], share_, [(1 + share_[-1]) / 2]))


def build(ids: list, labels: np.ndarray, texts: pa.StringArray | list[str]) -> Examples:
    """Examples for an index, each text once. Examples lie by their heaviest term, so that blocks differ in their bounds."""
    known: dict[str, int] = {}

    def place(words: pa.Array) -> np.ndarray:
        return np.array([known.setdefault(w, len(known)) for w in words.to_pylist()], np.int64)

    parts, start = [], 0
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    for batch in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
        owner, term, times = term_counts(batch.column(0), place)
        parts.append(tuple(a.astype(np.int32) for a in (owner + start, term, times)))
        start += batch.num_rows
    owner, term, times = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32) for i in range(3))
    del parts
    n, v, labels = len(ids), len(known), labels.astype(float)
    df, toxic = np.bincount(term, minlength=v).astype(float), np.bincount(term, labels[owner] if n else None, minlength=v)
    pos = float(labels.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.abs(n * toxic - df * pos) / np.sqrt(df * (n - df) * pos * (n - pos))
    phi = np.nan_to_num(phi, nan=0.0, posinf=0.0)
    idf = lambda d: np.log((1 + n) / (1 + d)) + 1
    scale = idf(df) * (FLOOR + np.maximum(phi - np.sqrt(CHANCE / max(n, 1)), 0))
    w = (1 + np.log(times)) * scale[term]
    w = w / np.sqrt(np.bincount(owner, w * w, minlength=n))[owner]
    heavy = np.full(n, v)
    by_weight = np.lexsort((w, owner))
    heavy[owner[by_weight]] = term[by_weight]  # the last one written is the heaviest
    del w, by_weight
    order = np.lexsort((np.arange(n), heavy))
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n)
    owner = rank[owner]
    at = np.lexsort((owner, term))
    with_words = heavy[order] < v
    prior = float((pos + 0.5) / (n + 1)) if n else 0.0
    bare = labels[order][~with_words]
    return Examples(
        terms=pa.array(list(known), pa.string()), scale=scale, unknown=float(idf(0) * FLOOR), ids=[ids[i] for i in order], labels=labels[order],
        ptr=np.searchsorted(term[at], np.arange(v + 1, dtype=np.int32)).astype(np.int32), examples=owner[at], times=times[at],
        prior=prior, bare=float((bare.sum() + prior) / (len(bare) + 1)),
    )


class Examples(NamedTuple):
    """What an index is made from, as it travels: counts of words instead of weights."""

    terms: pa.StringArray
    scale: np.ndarray
    unknown: float
    ids: list
    labels: np.ndarray
    ptr: np.ndarray
    examples: np.ndarray
    times: np.ndarray
    prior: float
    bare: float

    def index(self) -> Index:
        """Weights are made in pieces: each worker of an executor holds an index."""
        n, owner, sizes = len(self.ids), self.examples, np.diff(self.ptr)
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), sizes)
        pieces = [slice(a, a + PIECE) for a in range(0, len(term), PIECE)]
        counted = lambda p: (1 + np.log(self.times[p])) * self.scale[term[p]]
        length, w = np.zeros(n), np.empty(len(term), np.float32)
        for p in pieces:
            np.add.at(length, owner[p], counted(p) ** 2)
        length = np.sqrt(length)
        for p in pieces:
            w[p] = counted(p) / length[owner[p]]
        many = np.argsort(-sizes, kind="stable")[: MATRIX_BYTES // (8 * max(n, 1))]
        many = many[sizes[many] * FREQUENT > n]
        matrix, row = np.zeros((len(many), n)), np.full(len(sizes), -1)
        row[many] = np.arange(len(many))
        for i, t in enumerate(many.tolist()):
            matrix[i, owner[self.ptr[t] : self.ptr[t + 1]]] = w[self.ptr[t] : self.ptr[t + 1]]
        block = owner // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        return Index(
            terms=self.terms, scale=self.scale, unknown=self.unknown, ids=self.ids, labels=self.labels, ptr=self.ptr.astype(np.int64), examples=self.examples, weights=w,
            run_ptr=np.searchsorted(term[first], np.arange(len(self.terms) + 1, dtype=np.int32)), run_block=block[first], run_start=np.append(first, len(term)),
            run_most=np.maximum.reduceat(w, first) if len(first) else np.zeros(0, np.float32), matrix=matrix, row=row, prior=self.prior, bare=self.bare,
        )


def examples_of(documents: DataFrame, labels: DataFrame, learns: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, text): at most EXAMPLES labelled documents where ``learns``, of EXAMPLE_BYTES bytes, each text once.

    One with both labels counts as 1, of several texts of an id the least is learned from, and copies of a text are one
    example, with the least id and the greatest label.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    some = known.groupBy("id").agg(F.max("label").alias("label"))
    some = bounded_sample(some.withColumnRenamed("id", id_col).where(learns).select(F.col(id_col).alias("id"), "label"), "id", EXAMPLES)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = docs.join(F.broadcast(some), "id").select("id", "label", F.coalesce("text", F.lit("")).alias("text"))
    sample = cut(joined.groupBy("id", "label").agg(F.min("text").alias("text")).groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")))
    sizes = sample.select("id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").collect()  # EXAMPLES at most
    total = np.cumsum([r["size"] for r in sizes])
    if len(sizes) and total[-1] > EXAMPLE_BYTES:
        sample = sample.where(F.col("id").isin([r["id"] for r in sizes[: int(np.searchsorted(total, EXAMPLE_BYTES, "right"))]]))
    return sample.select("id", "label", "text")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the packed Examples of all rows (id, label, text)."""
    if rows := list(batches):
        table = pa.Table.from_batches(rows)
        ids = table["id"].to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        rows = None
        table = table.take(order).combine_chunks()
        x = build([ids[i] for i in order], table["label"].to_numpy(), pa.concat_arrays(table["text"].chunks))
        size, data = packed(tuple(x))
        yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["n", "size", "data"])
        del table, x, data
        release()


def learn(documents: DataFrame, labels: DataFrame, learns: Column, id_col: str, text_col: str, label_col: str) -> tuple[Callable[[], Examples], tuple[np.ndarray, np.ndarray]]:
    """The shared examples and the calibration (raw score, share) on all of them: tasks score each by its neighbours other
    than itself.

    One task builds the examples, so that the driver holds neither texts nor postings, but their packed form only.
    """
    spark = documents.sparkSession
    sample = examples_of(documents, labels, learns, id_col, text_col, label_col)
    made = sample.coalesce(1).mapInArrow(_built, "n long, size long, data binary").collect()
    n, size, data = made[0] if made else (0, *packed(tuple(build([], np.zeros(0), []))))
    sent = share_packed(spark, size, bytes(data))
    del made, data
    shared = lambda: Examples(*sent())
    if not n:
        return shared, (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared().index()
        release()
        for batch in slices(batches, "text"):
            raw = []
            queries = list(vectors(batch.column("text"), x.terms, x.scale, x.unknown))
            own = pc.index_in(batch.column("id"), pa.array(x.ids, batch.column("id").type)).to_pylist()
            for e, (term, _), (best, cos) in zip(own, queries, searches(x, queries, NEIGHBOURS + 1), strict=True):
                keep = best != e
                raw.append(vote(x, best[keep][:NEIGHBOURS], cos[keep][:NEIGHBOURS]) if len(term) else None)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column("label")], names=["raw", "label"])
        x = queries = None
        release()

    parts = spark.sparkContext.defaultParallelism * 2
    got = sample.repartition(parts, "id").mapInArrow(leave_out, "raw double, label int").where("raw IS NOT NULL").collect()  # EXAMPLES at most
    return shared, isotonic(np.array([r["raw"] for r in got]), np.array([r["label"] for r in got], float))


def score(documents: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry: bool = False, evidence: int = 3) -> DataFrame:
    """Per row: id (if carry, instead a struct ``row`` of all columns), held_out, score, predicted and evidence.

    ``learns`` is a condition on id_col that says whose labels may be learned. Words are letters, digits and all beyond
    ASCII, A-Z lowered; all of them count. A score is the vote of the NEIGHBOURS nearest examples by cosine (ties to the
    earlier example), calibrated on all examples, each by its neighbours other than itself; a text without any word (an
    empty or null one too) has the share of label 1 among such examples. Evidence lists the nearest examples with id,
    cosine and label. Without labels every score is 0. Repeated rows are scored each, an empty table gives none, a
    very long text is worked on whole, and other columns, whatever their names, are never read.
    """
    text_batches(documents.sparkSession)
    shared, curve = learn(documents, labels, learns, id_col, text_col, label_col)
    columns = [F.col(f"`{c}`") for c in documents.columns] if carry else [F.col(id_col)]
    text = [] if carry else [F.col(text_col).cast("string").alias("text")]
    docs = documents.select(F.struct(*columns).alias("row"), (~F.coalesce(learns, F.lit(False))).alias("held_out"), *text)
    id_kind = documents.schema[id_col].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared().index()
        release()
        memo: dict[int, tuple] = {}  # exact copies are searched once; a bounded number of texts is remembered
        for batch in slices(with_text(batches, text_col), "text"):
            scores, notes = [], []
            for group in batched(vectors(batch.column("text"), x.terms, x.scale, x.unknown), TOGETHER):
                keys = [hash(term.tobytes() + w.tobytes()) for term, w in group]
                new = {key: query for key, query in zip(keys, group, strict=True) if key not in memo}
                found = {}
                for key, (best, cos) in zip(new, searches(x, new.values(), NEIGHBOURS), strict=True):
                    note = [{"id": x.ids[e], "cosine": float(c), "label": int(x.labels[e])} for e, c in zip(best[:evidence], cos[:evidence], strict=True)]
                    found[key] = calibrated(curve, vote(x, best, cos)) if len(best) else x.bare, note
                for key in keys:
                    got = found[key] if key in found else memo[key]
                    scores.append(got[0])
                    notes.append(got[1])
                if len(memo) < 20_000:
                    memo |= found
            note_type = pa.list_(pa.struct([("id", id_arrow), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(notes, note_type)], names=["row", "held_out", "score", "predicted", "evidence"])
        x = memo = found = None
        release()

    id_arrow = to_arrow_type(documents.schema[id_col].dataType)
    out = docs.mapInArrow(rate, fields(f"held_out boolean, score double, predicted int, evidence array<struct<id: {id_kind}, cosine: double, label: int>>", row=docs.schema["row"].dataType))
    return out.select("row" if carry else "row.*", "held_out", "score", "predicted", "evidence")
