"""Mixing, decontamination, search, licences, archives, near copies and the pipeline against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import io
import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from semspark.llm import decontaminate, licenses, mixing, simhash, topk, warc
from semspark.llm.components import components

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower(text)).split(" ") if w]


def alnum_words(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in lower(text)).split(" ")


# Mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000, 10], [3, 1, 2]) == pytest.approx([20, 1490, 20])
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []
    for _ in range(50):
        s = np.random.default_rng(_).integers(0, 1000, 9).tolist()
        t = mixing.targets(s, [3, 1, 2] * 3)
        assert sum(t) == pytest.approx(1.5 * sum(s)) and all(a <= 2 * b + 1e-9 for a, b in zip(t, s))


def test_flight_keeps_totals():
    for seed in range(20):
        g = np.random.default_rng(seed)
        size, p = g.integers(0, 50, 300).astype(float), g.random(300)
        x = mixing.flight(size, p, g)
        assert ((x > 0) & (x < 1)).sum() <= 2
        assert x.sum() == pytest.approx(p.sum(), abs=1e-6) and x @ size == pytest.approx(p @ size, abs=1e-4)
    equal = mixing.flight(np.full(10, 3.0), np.full(10, 0.3), np.random.default_rng(0))
    assert ((equal > 0) & (equal < 1)).sum() <= 1
    many = np.array([mixing.flight(np.arange(1.0, 31), np.full(30, 0.4), np.random.default_rng(s)) for s in range(600)])
    assert np.abs(many.mean(0) - 0.4).max() < 0.09  # each keeps its expectation


@pytest.mark.parametrize("block", [2000, 10])
def test_mix(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    g = np.random.default_rng(0)
    rows = [(i, ["b", "a", None, "é", ""][min(int(g.integers(8)), 4)], " ".join(["w"] * int(g.integers(0, 40)))) for i in range(500)]
    rows += [(1000, "a", None), (None, "a", "x y"), (7, "b", "p q r"), (7, "b", "p q r")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS x", "3 AS target").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(len(blank_words(t)) for _, s, t in rows if s == x) for x in sources]
    aim = dict(zip(sources, mixing.targets(size, [[3, 1, 2][i % 3] for i in range(len(sources))])))
    for s, n in zip(sources, size):
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and all(r["target"] == pytest.approx(aim[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - aim[s]) <= 60
        low = int(aim[s] / n + 1e-12)
        assert all(low <= r["copies"] <= low + 1 and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in own)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["copies"])
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(df.where("false")).count() == 0


# Decontamination


def plain_contamination(docs, items):
    windows = []
    for name, text in items:
        w = [x for x in alnum_words(text) if x]
        n = min(13, len(w))
        windows += [(str(name), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = {}
    for i, text in docs:
        w = [x for x in alnum_words(text) if x]
        hit, found = set(), set()
        for name, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit.update(range(a, a + len(x)))
                    found.add(name)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("words", [1 << 20, 20])
def test_contamination(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", words)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 50)
    g = np.random.default_rng(4)
    some = lambda n, k=3: " ".join(g.choice(list("abcdefgh")[:k], n))
    items = [(i, some(int(n), 2)) for i, n in enumerate((14, 13, 20, 5, 2, 12))] + [(10, "q"), (11, None), (12, "!?"), (3, "É é z z z")]
    docs = [(i, some(int(g.integers(0, 200)), 2 + i % 3)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " ".join(["pre", items[2][1].upper().replace(" ", ", "), "post " * 500])), (103, "Q"), (104, some(3000, 2)), (105, "É-é z z z"), (106, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS row", "'y' AS items", "0 AS key").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    got = decontaminate.contamination(df, bench).withColumn("sha", digest).collect()
    want = plain_contamination(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["sha"], r["contaminated"]) == want[r["doc_id"]], r["doc_id"]
    carried = decontaminate.contamination(df, bench, carry=True)
    assert carried.select("row.*").columns == df.columns and carried.count() == len(docs)
    twice = decontaminate.contamination(df.unionByName(df), bench)
    assert twice.count() == 2 * len(docs)
    assert decontaminate.contamination(df, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(df.where("false"), bench).count() == 0


# Top-k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "ROWS", 100)
    g = np.random.default_rng(6)
    rows = [(i, g.normal(0, 0.2, 40).astype(np.float32).tolist()) for i in range(600)]
    rows[5] = (5, rows[100][1])
    rows[6] = (6, [v * 4 for v in rows[100][1]])
    rows += [(700, None), (701, []), (702, [1.0, float("nan")] + [0.0] * 38), (703, [None] + [0.0] * 39), (750, [float("inf")] * 40), (None, rows[1][1]), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS query_id", "0 AS id").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, q in {i: q for i, q in ok if i % 50 == 0}.items():
        s = sorted((-int(q @ c), j) for j, c in ok if j != i and len(c) == len(q))[:5]
        want[i] = [(j, -x) for x, j in s]
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert have == want and all(r["rank"] <= 5 for r in got)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(i, [float(2**20 + i), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(big, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [59, 58]


def test_bounds_drop_candidates():
    g = np.random.default_rng(1)
    scale = np.concatenate((np.full(32, 40.0), np.full(32, 1.0)))
    c = (g.normal(size=(4000, 64)) * scale).astype(np.int64)
    s = topk.Search(np.array([10**6]), c[:1], 5)
    s.feed(np.arange(4000), c)
    s.feed(np.arange(4000, 8000), c)
    assert s.evaluated < 5000


# Licences


def test_licences(spark):
    mit = licenses.KNOWN[0][1]
    variant = "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;") + "\n(c) nobody"
    rows = [(0, mit), (1, variant), (2, mit + " and more"), (3, "Some text\nReleased under the MIT Licence\nmore"), (4, None), (5, ""), (0, mit), (None, "Licensed under CC BY 4.0"), (6, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'d' AS digest", "1 AS license", "2 AS lines", "3 AS c")
    got = licenses.scan(df, licenses.known_digests(spark)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["license"] == by[1]["license"] == "MIT" and by[0]["digest"] == by[1]["digest"]
    assert by[2]["license"] is None and by[3]["license"] is None and by[3]["line_licenses"] == "MIT" and by[3]["n_license_lines"] == 1
    assert by[None]["license"] == "CC-BY-4.0" and by[4]["digest"] == by[5]["digest"] and by[4]["license"] is None
    assert licenses.scan(df.where("false"), licenses.known_digests(spark)).count() == 0


# Archives


def test_archives(spark, tmp_path, monkeypatch):
    page = "é<p>" * 700
    rows = [(1, "http://a\r\nb", "a" * 3_000_000), (2, None, None), (3, "u", page), (4, "u", page), (9, "u", page), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (4, "u", page), (None, "u", page), (8, "u", "x" * 999), (10, "u", "x" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS size", "3 AS id").repartition(3)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    text = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        raw = text[r["page_id"]]
        again = raw == page.encode() and r["page_id"] != 9
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if again else ("response", None))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    warc.write(df, str(tmp_path / "w"), segment=1000)
    table = warc.read(spark, str(tmp_path / "w")).where("record_id = '<urn:page:1>'").orderBy("chunk").collect()
    assert b"".join(r["data"] for r in table).decode() == "a" * 3_000_000 and len(table) == 3000
    assert [r["last"] for r in table] == [False] * 2999 + [True]
    assert table[1]["sha1"] == hashlib.sha1(b"a" * 2000).hexdigest()
    assert warc.round_trip(df.where("false")).count() == 0
    some = next((tmp_path / "w").glob("part-*.gz"))
    heads = [x for x in gzip.decompress(some.read_bytes()).split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert heads


def test_foreign_archive():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"z" * 700
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    rows = list(warc.records(io.BytesIO(raw), chunk=256))
    got = [r for r in rows if r["record_id"] == "<urn:x>"]
    assert [r["size"] for r in got] == [256, 256, 188] and got[-1]["last"] and got[-1]["sha1"] == hashlib.sha1(b"z" * 700).hexdigest()


# Near copies


def plain_fingerprint(text, width=3):
    w = blank_words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_shingles(text, width=5):
    w = blank_words(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def plain_components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def near_rows():
    g = np.random.default_rng(8)
    rows = []
    for c in range(8):
        w = g.choice([f"w{i}" for i in range(300)], 400).tolist()
        for v in range(6):
            x = list(w)
            for _ in range(v):
                x[int(g.integers(400))] = f"n{int(g.integers(1000))}"
            rows.append((c * 10 + v, " ".join(x)))
    return rows + [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (204, "a b c"), (3, rows[3][1]), (205, "tail " * 30_000)]


@pytest.mark.parametrize(("distance", "crowd"), [(0, 256), (1, 256), (2, 256), (3, 256), (4, 256), (5, 256), (1, 1), (2, 1), (3, 1), (5, 1)])
def test_near_copies(spark, monkeypatch, distance, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS hash", "4 AS root").repartition(3)
    got = simhash.near_duplicates(df, distance=distance).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    n = len(rows)
    comp = plain_components(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= distance])
    least = {c: min(rows[i][0] for i in range(n) if comp[i] == c) for c in set(comp)}
    want = sorted((rows[i][0], f"{fps[i]:016x}", least[comp[i]]) for i in range(n))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_near_copies_with_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "q r s t"), (5, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    assert sorted(map(str, (r["doc_id"] for r in simhash.deduplicate(df).collect()))) == ["5", "None"]
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.deduplicate(df.where("false")).count() == 0


def test_rows_grow_with_documents_not_pairs(spark):
    base = 0x0F0F_0F0F_0F0F_0F0F
    group = sorted({base} | {base ^ (1 << a) for a in range(64)} | {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in group], "fp long")
    pairs = simhash.links(df)
    assert pairs.count() <= 160 * len(group)
    roots = components(pairs)
    assert roots.count() == len(group) and roots.select("root").distinct().count() == 1


def test_components(spark):
    g = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in g.integers(0, 300, (250, 2))] + [(400 + i, 401 + i) for i in range(100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*pairs, (None, 3)], "p long, q long")).collect()}
    want = plain_components(600, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}


# The pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline
    from semspark.llm import quality, toxicity
    from semspark.llm.text import crc_fold

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(texts)
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF).checkpoint()
        if name.startswith("quality"):
            kept &= {r["doc_id"] for r in quality.score(df, labels, crc_fold("doc_id", 3) != 1).where("predicted = 1").collect()}
        elif name == "toxicity":
            kept &= {r["doc_id"] for r in toxicity.score(df, labels, crc_fold("doc_id", 5) != 0).where("predicted = 0").collect()}
        elif name.startswith("SimHash"):
            ids = sorted(kept)
            sets = [plain_shingles(texts[i]) for i in ids]
            comp = plain_components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
            kept = {ids[c] for c in set(comp)}
        elif name.startswith("benchmark"):
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = plain_contamination([(i, texts[i]) for i in kept], items)
            kept = {i for i in kept if not bad[i][1]}
        else:
            got = {r["doc_id"]: r for r in out.collect()}
            assert set(got) == kept and all(r["size"] == len(blank_words(texts[i])) for i, r in got.items())
            total = sum(r["size"] for r in got.values())
            assert abs(sum(r["taken"] for r in got.values()) - 1.5 * total) < 0.1 * total
            break
        assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} == kept and out.count() == len(kept)
        df = out
    assert corpus_pipeline.run(spark, SF).count() == len(kept)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_decontamination", "op5_exact_top_k", "op8_license_scan", "op9_warc"])
def test_queries_against_sql(spark, name):
    import duckdb

    from semspark.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = c.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    want = sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == want
