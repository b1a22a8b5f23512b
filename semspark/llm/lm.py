"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

The model predicts the class of a token from the classes of the two before it. Classes are the ``HEAD`` most frequent
words, the end of a text, and ``BUCKETS`` buckets of all rarer words (by crc32 of their last two characters). With
context classes u (nearest) and v, class k scores (r[u] C1 + r[v] C2) . q[k] + b[k]; a batched matrix product over all
contexts gives the normaliser of each, so every class probability is exactly normalised. A rare word has its bucket's
probability times its smoothed share (c + 1) / (n + v + 1) of the bucket, with counts over the whole training part.

Nothing is sampled: word counts are a distributed aggregation over all training texts, which are dealt by hash to shards of
about SHARD tokens. Each shard trains a copy of the same model on all its tokens, after which the copies are averaged by
their token counts; the next round starts from the average.
Counts of the ``COUNTED`` most frequent words are broadcast (a fixed bound); rarer words are joined to their counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.llm.scratch import bounded_sample, cut, share, text_batches
from semspark.llm.text import BLANKS, Tokens, slices, tokenize

HEAD, BUCKETS, COUNTED, WIDTH = 1024, 256, 1 << 18, 16
#: Noise classes for each minibatch, positions in one, the step of AdaGrad.
NOISE, BATCH, STEP = 32, 2048, 0.04
#: No word holds a blank, so this stands for the end of a text among the words.
END = " "
#: Bytes that the counted words may take together.
COUNTED_BYTES = 16 << 20
#: Training tokens of a shard, rounds over all shards, and models that are added up in one task.
SHARD, ROUNDS, ADDED = 4_000_000, 2, 32


class Words(NamedTuple):
    """Broadcast: the most frequent words and their training counts, the totals, and the buckets' totals."""

    words: pa.StringArray
    counts: np.ndarray
    head: int
    total: int
    distinct: int
    bucket_n: np.ndarray
    bucket_v: np.ndarray

    def classes(self) -> int:
        return self.head + 1 + BUCKETS


class Model(NamedTuple):
    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray


def bucket_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2).cast("binary")) % BUCKETS).cast("int")


def buckets_of(words: pa.StringArray) -> np.ndarray:
    tails = pc.utf8_slice_codeunits(words, -2, None).dictionary_encode()
    each = np.array([zlib.crc32(x.encode()) % BUCKETS for x in tails.dictionary.to_pylist()], np.int64)
    return each[tails.indices.to_numpy()] if len(each) else each


def encoded(tokens: Tokens) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct words of a slice, and each token's place among them."""
    codes = tokens.words.dictionary_encode()
    return codes.dictionary, codes.indices.to_numpy()


def with_ends(codes: np.ndarray, ends: np.ndarray, end_code: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' codes with an end after each, and the offsets between texts."""
    n = len(ends) - 1
    at = ends + np.arange(n + 1)
    out = np.full(int(at[-1]), end_code, np.int64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = codes
    return out, at


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of a column ``text``, ends included as END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, codes = encoded(tokenize(batch.column("text"), BLANKS))
            n = np.bincount(codes, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows], pa.int64())], names=["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list:
    """At most ``most`` rows of the highest counts, of COUNTED_BYTES at most, cut between two levels of a logarithmic histogram.

    Where even the highest level is too large, those of its words with the least hashes stand for it.
    """
    words = counts.where(F.col("word") != END).withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    levels = sorted(words.groupBy("level").agg(F.count("*"), F.sum(F.octet_length("word"))).collect(), reverse=True)
    seen, size, level = 0, 0, 1 << 30
    for row in levels:
        if seen + row[1] > most or size + row[2] > COUNTED_BYTES:
            break
        seen, size, level = seen + row[1], size + row[2], row[0]
    some = words.where(F.col("level") >= level)
    if levels and not seen:
        room = min(most, int(levels[0][1] * COUNTED_BYTES / max(levels[0][2], 1)))
        some = bounded_sample(words.where(F.col("level") == levels[0][0]), "word", room)
    rows = some.select("word", "n").toArrow()
    return sorted(zip(rows["n"].to_pylist(), rows["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))


def vocabulary(counts: DataFrame) -> Words:
    top = frequent(counts, COUNTED)
    sums = counts.groupBy(F.when(F.col("word") == END, -1).otherwise(bucket_column(F.col("word"))).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    bucket_n, bucket_v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in sums:
        if r["k"] >= 0:
            bucket_n[r["k"]], bucket_v[r["k"]] = r["n"], r["v"]
    words, n = pa.array([w for _, w in top], pa.string()), np.array([c for c, _ in top], np.int64)
    head = min(HEAD, len(top))
    at = buckets_of(words.slice(0, head))
    np.subtract.at(bucket_n, at, n[:head])
    np.subtract.at(bucket_v, at, 1)
    return Words(words, n, head, sum(r["n"] for r in sums), sum(r["v"] for r in sums), bucket_n, bucket_v)


def class_counts(v: Words) -> np.ndarray:
    ends = v.total - int(v.counts[: v.head].sum()) - int(v.bucket_n.sum())
    return np.concatenate([v.counts[: v.head], [ends], v.bucket_n]).astype(np.float64)


def classes_of(words: pa.StringArray, v: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its class, and its place among the counted words or -1."""
    at = pc.fill_null(pc.index_in(words, v.words.cast(words.type)), -1).to_numpy().astype(np.int64)
    rare = (at < 0) | (at >= v.head)
    out = at.copy()
    if rare.any():
        out[rare] = v.head + 1 + buckets_of(words.filter(pa.array(rare)))
    return out, at


def contexts(stream: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places back; before a text there are ends."""
    u, v = np.empty_like(stream), np.empty_like(stream)
    u[1:], v[2:] = stream[:-1], stream[:-2]
    first = at[:-1]
    v[first] = end
    v[first[np.diff(at) > 1] + 1] = end
    u[first] = end
    return u, v


def start(v: Words) -> Model:
    """The same small random start for every shard; biases begin at the class frequencies."""
    k, rng = v.classes(), np.random.default_rng(7)
    n = class_counts(v) + 1
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Model(small(k, WIDTH), np.eye(WIDTH, dtype=np.float32), np.eye(WIDTH, dtype=np.float32), small(k, WIDTH), np.log(n / n.sum()).astype(np.float32))


def scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by row number, for the rows that occur."""
    order = np.argsort(rows, kind="stable")  # of 16-bit numbers: a radix sort
    ranked = rows.take(order)
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return ranked[first], np.add.reduceat(values.take(order, 0), first, axis=0)


class Trainer:
    """Noise-contrastive estimation: tell each token from NOISE classes drawn by frequency and shared by a minibatch."""

    def __init__(self, v: Words, m: Model, round_: int = 0):
        self.m = Model(*(x.copy() for x in m))
        n = class_counts(v) + 1
        self.p = n / n.sum()
        self.log_kp = np.log(NOISE * self.p).astype(np.float32)
        self.cumulative = np.cumsum(self.p)
        self.g = Model(*(np.full(x.shape, 1e-6, np.float32) for x in self.m))
        self.rng, self.seen = np.random.default_rng(11 + round_), 0

    def feed(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        u, v, w = (x.astype(np.int16).take(order) for x in (u, v, w))
        for i in range(0, len(w), BATCH):
            self.step(u[i : i + BATCH], v[i : i + BATCH], w[i : i + BATCH])

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m, n = self.m, len(w)
        self.seen += n
        h = (m.r @ m.c1).take(u, 0) + (m.r @ m.c2).take(v, 0)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.p) - 1)
        shift = m.b - self.log_kp
        qw, qn = m.q.take(w, 0), m.q[noise]
        real = np.einsum("ij,ij->i", h, qw) + shift.take(w)
        fake = h @ qn.T + shift[noise]
        gr = (1 / (n + n * np.exp(np.clip(real, -30, 30)))).astype(np.float32)
        gf = (-1 / (n + n * np.exp(-np.clip(fake, -30, 30)))).astype(np.float32)
        dh = gr[:, None] * qw + gf @ qn
        rows, d = scatter(w, np.concatenate((gr[:, None] * h, gr[:, None]), 1))
        self.move("q", rows, d[:, :-1])
        self.move("b", rows, d[:, -1])
        self.move("q", *scatter(noise, gf.T @ h))
        self.move("b", *scatter(noise, gf.sum(0)))
        for name, c in (("c1", u), ("c2", v)):
            rows, d = scatter(c, dh)
            now = getattr(m, name).copy()
            self.move(name, slice(None), m.r[rows].T @ d)
            self.move("r", rows, d @ now.T)

    def move(self, name: str, rows, grad: np.ndarray) -> None:
        x, g = getattr(self.m, name), getattr(self.g, name)
        g[rows] += grad * grad
        x[rows] += STEP * grad / np.sqrt(g[rows])


def _fitting(begin: Callable[[], tuple[Words, Model]], k: int) -> Callable[[pa.Table], pa.Table]:
    """The function that trains a shard's copy of the model in round k and gives its parameters times its tokens."""

    def fit(group: pa.Table) -> pa.Table:
        v, m = begin()
        trainer = Trainer(v, m, k)
        rows = sorted(zip(group.column("h").to_pylist(), group.column("stream").to_pylist(), strict=True))
        for i in range(0, len(rows), 2000):
            some = [np.frombuffer(x, np.int16).astype(np.int64) for _, x in rows[i : i + 2000]]
            stream, at = np.concatenate(some), np.concatenate(([0], np.cumsum([len(x) for x in some])))
            trainer.feed(*contexts(stream, at, v.head), stream)
        flat = np.concatenate([x.ravel() for x in trainer.m] + [np.ones(1)]).astype(np.float64) * trainer.seen
        return pa.table({"shard": group.column("shard")[:1].cast(pa.int32()), "x": pa.array([flat], pa.list_(pa.float64()))})

    return fit


def train(texts: DataFrame, v: Words) -> Model:
    """ROUNDS passes over all training texts (columns id, text); after each, the mean of the shards' models by tokens.

    A shard holds about SHARD tokens, dealt by hash of id and text and ordered by it, so that neither partitions nor
    machines change the model. Texts go to their shards as class numbers of two bytes.
    """
    spark, m = texts.sparkSession, start(v)
    shared, shards = share(spark, v), max(1, round(v.total / SHARD))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared()
        for batch in slices(batches, "text"):
            tokens = tokenize(batch.column("text"), BLANKS)
            words, codes = encoded(tokens)
            stream, at = with_ends(classes_of(words, v)[0][codes], tokens.ends, v.head)
            raw = stream.astype(np.int16).tobytes()
            own = [raw[2 * x : 2 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(own, pa.binary())], names=["h", "stream"])

    hashed = texts.select(F.xxhash64("id", "text").alias("h"), "text")
    table = cut(hashed.mapInArrow(encode, "h long, stream binary").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")))
    for k in range(ROUNDS):
        fit = _fitting(share(spark, (v, m)), k)
        sums = added(table.groupBy("shard").applyInArrow(fit, "shard int, x array<double>"), shards)
        if sums is None:
            return m
        flat, out = sums[:-1] / sums[-1], []
        for x in m:
            out, flat = [*out, flat[: x.size].reshape(x.shape).astype(np.float32)], flat[x.size :]
        m = Model(*out)
    return m


def added(models: DataFrame, n: int) -> np.ndarray | None:
    """The sum of n arrays (shard, x), ADDED of them in a task at a time, in the order of their numbers."""

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("shard").to_numpy(), kind="stable")
        total = sum(group.column("x")[int(i)].values.to_numpy() for i in order)
        return pa.table({"shard": pa.array([group.column("into")[0].as_py()], pa.int32()), "x": pa.array([total], pa.list_(pa.float64()))})

    while True:
        n = -(-n // ADDED)
        models = cut(models.withColumn("into", F.expr(f"shard div {ADDED}").cast("int")).groupBy("into").applyInArrow(add, "shard int, x array<double>"))
        if n <= 1:
            rows = models.select("x").toArrow()
            return rows["x"][0].values.to_numpy() if rows.num_rows else None


class Tables(NamedTuple):
    """log p(k | u, v) = near[u, k] + far[v, k] + bias[k] - norm[u, v]."""

    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    norm: np.ndarray


def tables(m: Model) -> Tables:
    near, far = m.r @ m.c1 @ m.q.T, m.r @ m.c2 @ m.q.T
    top = float(near.max() + far.max() + m.b.max())
    a = np.exp(near + (m.b - top))  # the batched product over all contexts: sum over k of e^near e^far e^bias
    shift = far.max(1, keepdims=True)
    norm = np.log(np.maximum(a @ np.exp(far - shift).T, 1e-37)) + top + shift.T
    return Tables(near, far, m.b, norm.astype(np.float32))


def log10_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return run[at[1:]] - run[at[:-1]]


def score(documents: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text, learning from the rows where ``learns``.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram model) and score (log-bilinear).
    A null text is empty: one token, its end. Repeated rows are scored each; other columns, whatever their names, are not
    read; an empty table gives no rows; a very long text is scored whole. Without any training row every count is 0 and the
    model is its start. Rows are told apart by 128 bits of id and text.
    """
    text_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learn"))
    counts = cut(word_counts(docs.where("learn").select("text")))
    v = vocabulary(counts)
    t = tables(train(docs.where("learn").select(F.col("doc_id").alias("id"), "text"), v))
    spark = documents.sparkSession
    shared = share(spark, (t, v))
    ln10, all_log = math.log(10), math.log10(v.total + v.distinct + 1)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, v = shared()
        k = v.classes()
        near, far, norm = t.near + t.bias, t.far.ravel(), t.norm.ravel()
        near = near.ravel()
        in_bucket = np.zeros(k)
        in_bucket[v.head + 1 :] = np.log10(v.bucket_n + v.bucket_v + 1.0)
        known, end_log = np.log10(v.counts + 1.0), math.log10(class_counts(v)[v.head] + 1)
        for batch in slices(batches, "text"):
            tokens = tokenize(batch.column("text"), BLANKS)
            words, codes = encoded(tokens)
            kind, place = classes_of(words, v)
            stream, at = with_ends(codes, tokens.ends, len(words))
            kind = np.append(kind, v.head)
            log_c = np.append(np.where(place >= 0, known[np.maximum(place, 0)] if len(known) else 0.0, 0.0), end_log)
            seen = np.append(place >= 0, class_counts(v)[v.head] > 0)
            cls = kind[stream]
            u, w = contexts(cls, at, v.head)
            lp = (near[u * k + cls] + far[w * k + cls] - norm[u * k + w]) / ln10
            base = log_c[stream] - all_log
            full = lp + np.where(cls > v.head, log_c[stream] - in_bucket[cls], 0.0)
            ids, texts = batch.column("doc_id"), batch.column("text")
            keys = pa.array([xxhash.xxh3_128_digest(f"{i}\0{'' if x is None else x}".encode()) for i, x in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.binary())
            n = batch.num_rows
            none = pa.nulls(n, pa.int32())
            doc = [ids, keys, batch.column("learn"), pa.array([f" {x.hex()}" for x in keys.to_pylist()], pa.string()), none, pa.array(np.diff(at)), pa.array(log10_sum(seen[stream], at).astype(np.int64)), pa.array(log10_sum(base, at)), pa.array(log10_sum(full, at))]
            yield pa.RecordBatch.from_arrays(doc, names=names)
            # words beyond the broadcast counts: one row for each text and word
            far_off = np.append(place < 0, False)[stream]
            if far_off.any():
                owner = np.repeat(np.arange(n), np.diff(at))[far_off]
                pair, times = np.unique(owner * (len(words) + 1) + stream[far_off], return_counts=True)
                doc_of, word_of = pa.array(pair // (len(words) + 1)), pa.array(pair % (len(words) + 1))
                m, zero = len(pair), pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(doc_of), keys.take(doc_of), batch.column("learn").take(doc_of), words.cast(pa.string()).take(word_of), pa.array(times.astype(np.int32)), zero, zero, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)

    names = ["doc_id", "key", "learn", "word", "times", "n_tokens", "n_known", "base", "full"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.mapInArrow(rate, f"doc_id {id_type}, key binary, learn boolean, word string, times int, n_tokens long, n_known long, base double, full double")
    # both sides shuffle by word, texts themselves by a name of their own; a word that many held-out texts alone have is a
    # key that the join splits, since only one side has many rows of it
    joined = parts.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    more = F.col("times") * F.log10(F.col("c") + 1)
    got = joined.groupBy("doc_id", "key", "learn").agg(
        F.count(F.when(F.col("times").isNull(), 1)).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum("n_known"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times").cast("long"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(more), F.lit(0.0))).alias("base"),
        (F.sum("full") + F.coalesce(F.sum(more), F.lit(0.0))).alias("full"),
    )
    return got.select(
        F.col("doc_id").alias(id_col),
        (~F.col("learn")).alias("held_out"),
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("full") / F.col("copies")).alias("score"),
        F.explode(F.expr("sequence(1, copies)")).alias("copy"),
    ).drop("copy")
