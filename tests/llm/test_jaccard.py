from __future__ import annotations

import os

import numpy as np
import pytest

from semspark.llm import crowds, jaccard, simhash

SF = "/root/testdata/sf0.001"


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ")


def shingle_set(text, width=5):
    w = [x for x in words_of(text) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def least_ids(rows):
    """The ids that stay, by comparing all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups[find(i)] = min(groups.get(find(i), k), k)
    return sorted(set(groups.values()))


def edited(g, words, most):
    x = list(words)
    for _ in range(int(g.integers(most + 1))):
        at, kind = int(g.integers(len(x))), int(g.integers(3))
        x[at : at + (kind != 1)] = [] if kind == 0 and len(x) > 1 else [f"n{int(g.integers(10**6))}"]
    return x


def test_segments_meet():
    g = np.random.default_rng(3)
    for _ in range(4000):
        n = int(g.integers(1, 400 if g.random() < 0.5 else 30))
        union = g.integers(0, 2**63, int(n * 1.25) + 1).astype(np.uint64) * np.uint64(2)
        union = np.unique(union)
        lost = int(g.integers(len(union) // 5 + 1))
        side = g.permutation(len(union))[:lost]
        split = int(g.integers(lost + 1))
        a, b = np.delete(union, side[:split]), np.delete(union, side[split:])
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(union)
        assert len(np.intersect1d(jaccard.segments(a), jaccard.segments(b)))
        assert len(np.intersect1d(jaccard.prefix(a), jaccard.prefix(b)))


@pytest.mark.parametrize(("crowd", "block"), [(32, 1024), (2, 4)])
def test_edited_copies_go(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(crowds, "BLOCK", block)
    g = np.random.default_rng(5)
    rows = []
    for size in (1, 4, 6, 12, 30, 60, 120, 250, 500, 900):
        w = [f"w{int(i)}" for i in g.integers(0, 5000, size)]
        rows += [(len(rows) + v, " ".join(edited(g, w, max(size // 40, 1)))) for v in range(9)]
    chain = [f"c{i}" for i in range(300)]
    rows += [(500 + i, " ".join(chain[: 200 + 12 * i])) for i in range(9)]
    rows += [(700 + i, " ".join([*chain[:150], *(f"p{i}x{k}" for k in range(int(g.integers(60))))])) for i in range(12)]  # a shared passage
    rows += [(600, None), (601, ""), (602, " \n"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS keys", "4 AS root").repartition(3)
    kept = simhash.deduplicate(df)
    want = least_ids(rows)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert simhash.deduplicate(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_dedup_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    got = sorted(r["doc_id"] for r in stage(spark, docs, SF).collect())
    assert got == least_ids([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
