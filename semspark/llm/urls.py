"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.llm.scratch import bounded_sample, share
from semspark.llm.text import fields

#: Labelled URLs that the trees learn from, those of the least hash.
EXAMPLES = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 4, 32, 0.2, 1.0, 5
#: Suffixes (the last labels of a host) whose statistics are kept: the most frequent.
SUFFIXES = 512

FEATURES = ["url_length", "host_length", "host_labels", "host_digits", "host_hyphens", "host_entropy", "path_length", "path_depth", "path_digits", "path_entropy", "parameters", "query_length", "fragment", "https", "suffix_1", "suffix_2", "suffix_3"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lowered) after the first :// and the path after it; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. A rule is a host with its subdomains and the start of a path."""
    out, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out, verdict = F.when(fits, F.lit(rule)).otherwise(out), F.when(fits, F.lit(what)).otherwise(verdict)
    return out, verdict


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3)]


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The features but for the suffixes' statistics."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    digits = lambda x: sum(c.isdigit() for c in x) / max(len(x), 1)
    return [len(url), len(host), host.count(".") + 1, digits(host), host.count("-"), entropy(host), len(path), path.count("/"), digits(path), entropy(path), query.count("&") + bool(query), len(query), float("#" in url), float(url[:8].lower() == "https://")]


class Trees(NamedTuple):
    """Complete binary trees over features: at node i go to 2i + 2 if above the cut, else to 2i + 1."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    #: Log odds of label 1 by suffix.
    suffix: dict[str, float]

    def rows(self, urls: Sequence[tuple[str | None, str, str]]) -> np.ndarray:
        return np.array([[*lexical(*u), *(self.suffix.get(s, self.base) for s in suffixes(u[1]))] for u in urls], float).reshape(-1, len(FEATURES))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            out += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(urls: Sequence[tuple[str | None, str, str]], y: np.ndarray) -> Trees:
    """Boost TREES trees on the logistic loss, both labels weighing the same, with split points from quantiles."""
    y = y.astype(float)
    share_ = (y.sum() + 0.5) / (len(y) + 1)
    one_kind = not len(y) or y.min() == y.max()
    base = -1.0 if not len(y) else float(np.log(share_ / (1 - share_))) if one_kind else 0.0
    weight = np.where(y > 0, 0.5 / share_, 0.5 / (1 - share_))
    seen: dict[str, list[float]] = {}
    for (_, host, _), label in zip(urls, y, strict=True):
        for s in suffixes(host):
            n = seen.setdefault(s, [0.0, 0.0])
            n[0] += 1
            n[1] += label
    common = sorted(seen, key=lambda s: (-seen[s][0], s))[:SUFFIXES]
    odds = {s: float(np.log(((seen[s][1] + share_ * 4) / share_) / ((seen[s][0] - seen[s][1] + (1 - share_) * 4) / (1 - share_)))) for s in common}
    nodes = 2**DEPTH - 1
    empty = Trees(base, np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), odds)
    if one_kind or len(y) < 2 * LEAST_ROWS:
        return empty
    x = empty.rows(urls)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    f_all, c_all, l_all, out = [], [], [], np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, place = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first = 2**depth - 1
            for node in range(first, 2 * first + 1):
                own = np.flatnonzero(place == node)
                best, found = 1e-6, None
                if len(own) >= 2 * LEAST_ROWS:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[own, j]
                        gs, hs, ns = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g[own], h[own], np.ones(len(own))))
                        gt, ht = g[own].sum(), h[own].sum()
                        gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                        gain[(ns < LEAST_ROWS) | (len(own) - ns < LEAST_ROWS)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, found = gain[k], (j, e[k])
                if found:
                    feature[node], cut[node] = found
                place[own] = 2 * node + 1 + (x[own, feature[node]] > cut[node])
        leaf = place - nodes
        leaves = RATE * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + RIDGE)
        out += leaves[leaf]
        f_all.append(feature)
        c_all.append(cut)
        l_all.append(leaves)
    return Trees(base, np.array(f_all), np.array(c_all), np.array(l_all), odds)


def train(labelled: DataFrame) -> Trees:
    """From (url, host, path, label): at most EXAMPLES distinct labelled URLs, label 1 to block."""
    rows = labelled.where("label IN (0, 1) AND url IS NOT NULL").groupBy("url", "host", "path").agg(F.max("label").alias("label"))
    rows = bounded_sample(rows, "url", EXAMPLES).collect()
    return grow([(r["url"], r["host"], r["path"]) for r in rows], np.array([r["label"] for r in rows], float))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and score (of blocking, where no rule fits) of each row's URL.

    rules are (allow or block, host/path). The longest that fits decides; other URLs are judged by trees learned from
    ``labelled`` (url, label 1 to block), or from the URLs that rules decide. A null URL has no host, path or rule, and is
    judged by its features like any other. Without labels of both kinds the share of blocked ones decides (none: allow).
    """
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = urls.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    if labelled is None:
        known = urls.where("rule IS NOT NULL").select("url", "host", "path", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("label"))
    else:
        h, p = host_and_path(F.col("url"))
        known = labelled.select("url", h.alias("host"), p.alias("path"), "label")
    trees = share(pages.sparkSession, train(known))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trees()
        for batch in batches:
            free = np.flatnonzero(np.array(batch.column("rule").is_null()))
            cols = [batch.column(c).take(pa.array(free)).to_pylist() for c in ("url", "host", "path")]
            score = np.full(batch.num_rows, np.nan)
            score[free] = t.scores(t.rows(list(zip(*cols, strict=True))))
            verdict = np.array(batch.column("verdict").to_pylist(), object)
            verdict[free] = np.where(score[free] >= 0.5, "block", "allow")
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "host", "path", "rule")] + [pa.array(verdict.tolist(), pa.string()), pa.array(score, mask=np.isnan(score))], names=["id", "host", "path", "rule", "verdict", "score"])

    out = urls.mapInArrow(work, fields("host string, path string, rule string, verdict string, score double", id=urls.schema["id"].dataType))
    return out.withColumnRenamed("id", id_col)
