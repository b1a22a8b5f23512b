"""Language model, quality, toxicity and URL filters against plain versions."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semspark.llm import lm, quality, toxicity, urls
from semspark.llm.text import ALNUM, BLANKS, crc_fold, slices, tokenize, word_sizes

DOCS = [(0, "The cat sat"), (1, None), (2, ""), (3, " \t\n"), (4, "the CAT sat on\vthe mat"), (5, "É été É"), (6, "the cat sat"), (6, "the cat sat"), (7, "x" * 100_000 + " the"), (8, "the " * 5000), (None, "cat"), (9, "dog dog mat on")]


def table(spark, rows=None):
    """Documents whose other columns bear names that operators use themselves."""
    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string")
    return df.selectExpr("*", "'w' AS word", "1 AS n", "text AS row", "2 AS score", "doc_id AS id", "'k' AS key").repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out, now = [], ""
    for c in lower(text):
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def test_tokens():
    texts = [t for _, t in DOCS[:7]] + ["a", "b", " ", "c d"]
    got = tokenize(pa.array(texts, pa.string()), BLANKS)
    w = got.words.to_pylist()
    assert [w[a:b] for a, b in zip(got.ends[:-1], got.ends[1:])] == [words(t) for t in texts]
    assert word_sizes(pa.array(texts, pa.string())).tolist() == [len(words(t)) for t in texts]
    assert tokenize(pa.array(["A-b_ü9", None], pa.string()), ALNUM).words.to_pylist() == ["a", "b", "ü9"]
    batch = pa.record_batch({"text": pa.array(["x" * n for n in (5 << 20, 0, 10, 3 << 20, 3 << 20)])})
    assert sum(b.num_rows for b in slices([batch], "text")) == 5
    assert tokenize(pa.array([], pa.string()), BLANKS).ends.tolist() == [0]


def base_scores(rows):
    c = Counter(w for i, t in rows if fold(i, 7) != 2 for w in [*words(t), " "])
    n, v = sum(c.values()), len(c)
    return {(i, t): (len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), " "]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), " "])) for i, t in rows}


@pytest.mark.parametrize("counted", [1 << 18, 3])
def test_language_model(spark, monkeypatch, counted):
    monkeypatch.setattr(lm, "COUNTED", counted)  # with 3 most words are joined to their counts
    df = table(spark)
    got = lm.score(df, crc_fold("doc_id", 7) != 2).collect()
    want = base_scores(DOCS)
    by_id = {i: x for (i, _), x in want.items()}
    assert len(got) == len(DOCS)
    for r in got:
        n, known, total, base = by_id[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, fold(r["doc_id"], 7) == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0


def test_language_model_is_normalised_and_learns(spark):
    g = np.random.default_rng(0)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(g.choice(a if i % 2 else b, 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learns = crc_fold("doc_id", 7) != 2
    v = lm.vocabulary(lm.word_counts(df.where(learns).select("text")))
    t = lm.tables(lm.train(df.where(learns).selectExpr("doc_id AS id", "text"), v))
    k = v.classes()
    p = np.exp(t.near[:, None, :] + t.far[None, :, :] + t.bias - t.norm[:, :, None])[: v.head : 7, : v.head : 7]
    assert np.allclose(p.sum(-1), 1, atol=1e-3) and p.shape[-1] == k
    held = lm.score(df, learns).where("held_out")
    assert held.agg(F.sum("score") > F.sum("base_score")).first()[0]


def plain_lm_scores(v, t, texts):
    """log10 of the model's probability, token by token."""
    place, out = {w: i for i, w in enumerate(v.words.to_pylist())}, []
    counts = dict(zip(v.words.to_pylist(), v.counts.tolist(), strict=True))
    bucket = lambda w: zlib.crc32(w[-2:].encode()) % lm.BUCKETS
    for text in texts:
        u = w = v.head
        total = 0.0
        for x in [*words(text), None]:
            k = v.head if x is None else place[x] if place.get(x, v.head) < v.head else v.head + 1 + bucket(x)
            lp = float(t.near[u, k]) + float(t.far[w, k]) + float(t.bias[k])
            all_ = np.log(np.exp((t.near[u] + t.far[w] + t.bias).astype(np.float64)).sum())
            total += (lp - all_) / math.log(10)
            if k > v.head:
                b = bucket(x)
                total += math.log10((counts.get(x, 0) + 1) / (v.bucket_n[b] + v.bucket_v[b] + 1))
            u, w = k, u
        out.append(total)
    return out


def test_language_model_score_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)
    monkeypatch.setattr(lm, "SHARD", 700)
    monkeypatch.setattr(lm, "ADDED", 2)
    g = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(x)}" for x in np.minimum(g.zipf(1.4, int(g.integers(0, 60))), 90))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learns = crc_fold("doc_id", 7) != 2
    v = lm.vocabulary(lm.word_counts(df.where(learns).select("text")))
    t = lm.tables(lm.train(df.where(learns).selectExpr("doc_id AS id", "text"), v))
    one, eight = ({r["doc_id"]: r["score"] for r in lm.score(df.repartition(n), learns).collect()} for n in (1, 8))
    want = plain_lm_scores(v, t, [x for _, x in rows])
    for (i, _), score in zip(rows, want, strict=True):
        assert math.isclose(one[i], score, rel_tol=2e-4) and math.isclose(one[i], eight[i], rel_tol=1e-6)


@pytest.mark.parametrize(("most", "size"), [(5, 1 << 20), (50, 60), (50, 1 << 20)])
def test_frequent_words_are_never_none(spark, monkeypatch, most, size):
    monkeypatch.setattr(lm, "COUNTED_BYTES", size)
    counts = spark.createDataFrame([(f"word{i}", 7) for i in range(40)] + [("x" * 70, 6), (lm.END, 99)], "word string, n long")
    got = lm.frequent(counts, most)
    assert 0 < len(got) <= most and sum(len(w) for _, w in got) <= size and (most < 41 or size < 100 or len(got) == 41)


def test_language_model_without_rows(spark):
    assert lm.score(table(spark, []), F.lit(True)).count() == 0
    got = lm.score(table(spark), F.lit(False)).collect()
    assert len(got) == len(DOCS) and all(r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def corpus(n=240):
    g = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, toxic, good = [], [], []
    for i in range(n):
        w = g.choice(vocabulary, 40).tolist()
        bad = i % 5 == 0
        if bad:
            w[3], w[20] = "scum", "idiot"
        junk = i % 4 == 1
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + "."))
        toxic.append((i, int(junk), int(bad)))
        good.append((i, int(not junk), int(bad)))
    return rows, good


def test_toxicity(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (1002, "You SCUM, idiot"), (None, "scum idiot"), (1002, "You SCUM, idiot")]
    df = table(spark, rows + extra)
    got = toxicity.score(df, lab, crc_fold("doc_id", 5) != 0).collect()
    assert len(got) == len(rows) + 5
    truth = {i: t for i, _, t in labels}
    wrong = [r for r in got if r["doc_id"] in truth and r["predicted"] != truth[r["doc_id"]]]
    assert not wrong and all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1002]["predicted"] == 1 and by[1000]["predicted"] == 0 and by[1001]["score"] == by[1000]["score"]
    assert by[1002]["evidence"][0]["label"] == 1
    assert toxicity.score(table(spark, []), lab, F.lit(True)).count() == 0
    assert {r["score"] for r in toxicity.score(df, lab.where("false"), F.lit(True)).collect()} == {0.0}


def plain_words(text):
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in lower(text)).split(" ")


def plain_scores(examples, texts):
    """Scores of texts by dense vectors: (raw votes, calibrated), from (label, text) of distinct texts."""
    counts = [Counter(w for w in plain_words(t) if w) for _, t in examples]
    y, n = np.array([float(label) for label, _ in examples]), len(examples)
    vocabulary = sorted({w for c in counts for w in c})
    df = {w: sum(w in c for c in counts) for w in vocabulary}
    scale = {}
    for w in vocabulary:
        a = sum(label for label, c in zip(y, counts, strict=True) if w in c)
        b, c, d = df[w] - a, y.sum() - a, n - y.sum() - (df[w] - a)
        under = (a + b) * (c + d) * (a + c) * (b + d)
        phi = abs(a * d - b * c) / math.sqrt(under) if under else 0.0
        scale[w] = (math.log((1 + n) / (1 + df[w])) + 1) * (toxicity.FLOOR + max(phi - math.sqrt(toxicity.CHANCE / n), 0))
    unknown = (math.log(1 + n) + 1) * toxicity.FLOOR

    def vector(c):
        w = {x: (1 + math.log(m)) * scale.get(x, unknown) for x, m in c.items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / size for x, v in w.items() if x in scale}

    vectors = [vector(c) for c in counts]
    prior = (y.sum() + 0.5) / (n + 1)

    def raw(v, without=None):
        cos = np.array([0.0 if i == without else round(sum(v[x] * u.get(x, 0.0) for x in v), 9) for i, u in enumerate(vectors)])
        top = np.sort(cos)[::-1][: toxicity.NEIGHBOURS]
        least = top[-1]
        tied = (cos == least).sum() - (top == least).sum()
        best = np.argsort(-cos, kind="stable")[: toxicity.NEIGHBOURS]
        best = best[cos[best] > 0]
        w = cos[best] ** 2 / (1.05 - np.minimum(cos[best], 1))
        return (w @ y[best] + prior) / (w.sum() + 1), bool(tied)

    bare = [label for label, c in zip(y, counts, strict=True) if not c]
    own = [(raw(v, i)[0], y[i]) for i, v in enumerate(vectors) if counts[i]]
    curve = toxicity.isotonic(np.array([r for r, _ in own]), np.array([label for _, label in own]))
    out = []
    for t in texts:
        v = vector(Counter(w for w in plain_words(t) if w))
        r, tied = raw(v) if v else (0.0, False)
        out.append((float(np.interp(r, *curve)) if v else (sum(bare) + prior) / (len(bare) + 1), tied))
    return out


def test_toxicity_by_brute_force(spark):
    rows, labels = corpus(150)
    texts = [t for _, t in rows] + ["nothing known here", "idiot", "", "w1 w2 scum zzz", "w5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, lab, crc_fold("doc_id", 5) != 0).collect()}
    truth = {i: t for i, _, t in labels}
    want = plain_scores([(truth[i], t) for i, t in rows if fold(i, 5) != 0], texts)
    checked = 0
    for i, (score, tied) in enumerate(want):
        if not tied:
            assert math.isclose(got[i], score, abs_tol=1e-5), (i, texts[i])
            checked += 1
    assert checked > 100 and len({round(x, 4) for x in got.values()}) > 5


def test_toxicity_learns_without_texts_on_the_driver(spark):
    g = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{j}" for j in g.integers(0, 500, 4000))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    total = sum(len(t) for _, t in rows)
    tracemalloc.start()
    try:
        shared, _ = toxicity.learn(df, lab, F.lit(True), "doc_id", "text", "toxic")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(shared().ids) == [i for i, _ in rows]
    assert peak < total / 2, (peak, total)


@pytest.mark.parametrize("terms", [60, 600])
def test_block_max_search_is_exact(terms):
    g = np.random.default_rng(5)
    texts = [" ".join(f"t{int(j)}" for j in np.minimum(g.zipf(1.3, int(g.integers(1, 40))), terms)) for _ in range(700)]
    texts[7] = ""
    labels = np.array([int("t7 " in t) for t in texts])
    x = toxicity.build(list(range(700)), labels, texts).index()
    dense = np.zeros((700, len(x.terms)))
    dense[x.examples, np.repeat(np.arange(len(x.terms)), np.diff(x.ptr))] = x.weights
    queries = [*texts[:60], "t7", "t7 t9 t11 new", "t1 " * 9]
    for t, w in toxicity.vectors(pa.array(queries, pa.string()), x.terms, x.scale, x.unknown):
        best, cos = toxicity.nearest(x, t, w, 10)
        full = np.round(dense[:, t].astype(np.float64) @ w, 9)
        want = np.lexsort((np.arange(700), -full))[:10]
        want = want[full[want] > 0]
        assert np.allclose(cos, full[want], atol=2e-9) and len(best) == len(want)


def test_quality(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels + [(None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    df = table(spark, rows + [(1000, None), (1001, ""), (None, "a b c"), (1002, "x" * 200_000), (1002, "x" * 200_000)])
    got = quality.score(df, lab, crc_fold("doc_id", 3) != 1).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labels}
    assert all(r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    carried = quality.score(df, lab, crc_fold("doc_id", 3) != 1, carry=True)
    assert sorted(carried.select("row.*").columns) == sorted(df.columns)
    one = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None}
    assert all(math.isclose(one[r["row"]["doc_id"]], r["score"], rel_tol=1e-9) for r in carried.collect() if r["row"]["doc_id"] is not None)
    assert quality.score(df, lab.where("false"), F.lit(True)).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    assert quality.score(df, lab.where("quality = 1"), F.lit(True)).agg(F.min("score")).first()[0] == 1.0
    assert quality.score(table(spark, []), lab, F.lit(True)).count() == 0


def test_discriminant_is_a_density_ratio():
    g = np.random.default_rng(1)
    k = len(quality.NAMES)
    x = {0: g.normal(0, 2, (500, k)), 1: g.normal(1, 1, (800, k))}
    m = quality.fit({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    q = g.normal(0.5, 1, (20, k))
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 1300
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for c in (0, 1):
        cov = np.cov(x[c].T, bias=True) / np.outer(scale, scale)
        s = quality.SHRINKAGE + (1 - quality.SHRINKAGE) * k / (k + len(x[c]))
        cov = (1 - s) * cov + s * np.eye(k) + quality.RIDGE * np.eye(k)
        d = (q - x[c].mean(0)) / scale
        logs.append(np.log(len(x[c]) / 1300) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
    assert np.allclose(m.scores(q), want)


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URLS = ["http://a.example.com/en/1?q=/x#y", "HTTPS://WWW.Example.COM/en/", "https://b.www.example.com/en/2", "http://example.com/de", "http://x.net/es/1", "http://x.net/en", "http://notcom/", "http://com", "nothing", None, "", "a://b://c/d", "http://h#/en/", "http://h?x/y", "http://net/fr/\n", "ftp://example.org/a/b"]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = lower(rest[:cut]), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(len(r), r, v) for v, r in RULES for name, _, start in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])], "page_id long, url string").selectExpr("*", "'r' AS rule", "1 AS host")
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is None:
            continue
        host, path, (rule, verdict) = plain_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert urls.judge(df.where("false"), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_trees_learn(spark):
    g = np.random.default_rng(3)
    rows = [(f"http://h{i}.example.org/{'z' * int(g.integers(1, 9))}{'9' * (12 if i % 2 else 1)}", i % 2) for i in range(400)]
    lab = spark.createDataFrame(rows[:300], "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [], lab).collect()}
    assert sum(got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows[300:])) >= 95
