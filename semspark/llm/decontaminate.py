"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is 13 consecutive words of an item. Its set of shingles (3 words) is ordered by rarity in the documents; since the
whole window has to occur, one prefix shingle, the rarest, is enough to find every candidate. Its place in the window
gives where the window must start, which has to lie within the document (length and positional bounds), and the
window's words are then compared exactly.

Items travel to the documents in blocks of about ITEM_WORDS words. There are two passes over the documents, one for the
rarities and one for the hits, however many blocks there are: a task holds one block at a time against each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.llm.scratch import share, text_batches
from semspark.llm.text import ALNUM, fields, slices, tokenize, with_text, word_sizes

WINDOW, SHINGLE = 13, 3
#: Words of benchmark items broadcast at once.
ITEM_WORDS = 1 << 20
#: Candidates verified at a time.
AT_ONCE = 1 << 18


class Windows(NamedTuple):
    """Distinct windows of a block of items, and the shingles at each place of each."""

    vocabulary: pa.StringArray
    #: Window w has words flat[begins[w]:begins[w + 1]], as places in the vocabulary.
    flat: np.ndarray
    begins: np.ndarray
    items: list[list[str]]
    #: By shingle width (below SHINGLE only for shorter windows): codes of all shingles, ordered.
    codes: dict[int, np.ndarray]


def pack(ids: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    out = np.zeros(len(starts), np.int64)
    for i in range(width):
        out = out * base + ids[starts + i]
    return out


def windows(items: list[tuple[str, str | None]]) -> Windows:
    texts = [x or "" for _, x in items]
    tokens = tokenize(pa.array(texts, pa.string()), ALNUM)
    words = tokens.words.dictionary_encode()
    vocabulary, ids = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64)
    found: dict[tuple, set[str]] = {}
    for (name, _), a, b in zip(items, tokens.ends[:-1], tokens.ends[1:], strict=True):
        own = ids[a:b].tolist()
        for i in range(max(len(own) - WINDOW + 1, min(len(own), 1))):
            found.setdefault(tuple(own[i : i + WINDOW]), set()).add(str(name))
    begins = np.concatenate(([0], np.cumsum([len(w) for w in found], dtype=np.int64))).astype(np.int64)
    flat = np.array([i for w in found for i in w], np.int64)
    sizes, codes = np.diff(begins), {}
    for width in range(1, SHINGLE + 1):
        starts = [b + j for b, n in zip(begins[:-1], sizes, strict=True) if min(n, SHINGLE) == width for j in range(n - width + 1)]
        codes[width] = np.unique(pack(flat, np.array(starts, np.int64), width, len(vocabulary) + 1))
    return Windows(vocabulary, flat, begins, [sorted(x) for x in found.values()], codes)


def occurrences(w: Windows, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each width: tokens' vocabulary places, offsets between texts, positions of item shingles and which these are."""
    tokens = tokenize(texts, ALNUM)
    ids = pc.fill_null(pc.index_in(tokens.words, w.vocabulary.cast(tokens.words.type)), -1).to_numpy().astype(np.int64)
    for width, codes in w.codes.items():
        none = np.zeros(0, np.int64)
        if not len(codes) or len(ids) < width:
            yield width, ids, tokens.ends, none, none
            continue
        n = len(ids) - width + 1
        ok = ids[:n] >= 0
        for i in range(1, width):
            ok &= ids[i : i + n] >= 0
        at = np.flatnonzero(ok)
        at = at[np.searchsorted(tokens.ends, at, "right") == np.searchsorted(tokens.ends, at + width - 1, "right")]
        code = pack(ids, at, width, len(w.vocabulary) + 1)
        place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[place] == code
        yield width, ids, tokens.ends, at[hit], place[hit]


def rarity(docs: DataFrame, blocks: list[Callable[[], Windows]], sizes: list[dict[int, int]]) -> list[dict[int, np.ndarray]]:
    """For each block how often each item shingle occurs in all documents (column text); sizes: shingles by width."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [{k: np.zeros(n, np.int64) for k, n in x.items()} for x in sizes]
        items = loaded(blocks)
        for batch in batches:
            for block, w in enumerate(items()):
                for part in slices([batch], "text"):
                    for width, _, _, _, which in occurrences(w, part.column("text")):
                        sums[block][width] += np.bincount(which, minlength=len(sums[block][width]))
        for block, own in enumerate(sums):
            for width, n in own.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x, np.int32)) for x in (block, width)] + [pa.array(some.astype(np.int32)), pa.array(n[some])], names=["block", "width", "i", "n"])

    out = [{k: np.zeros(n, np.int64) for k, n in x.items()} for x in sizes]
    for r in docs.select("text").mapInArrow(count, "block int, width int, i int, n long").groupBy("block", "width", "i").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["block"]][r["width"]][r["i"]] = r["n"]  # at most a row for each shingle of the items
    return out


def loaded(blocks: list[Callable[[], Any]]) -> Callable[[], Iterable[Any]]:
    """For a task: gives the blocks of items, one in memory at a time, again and again; a single one stays."""
    only = [blocks[0]()] if len(blocks) == 1 else None
    return lambda: only or (block() for block in blocks)


def prefixes(w: Windows, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By width: the windows ordered by prefix shingle, where each shingle's windows begin, and the prefix's offset."""
    out, sizes = {}, np.diff(w.begins)
    for width, codes in w.codes.items():
        own, offset, shingle = [], [], []
        for k in np.flatnonzero(np.minimum(sizes, SHINGLE) == width):
            starts = np.arange(w.begins[k], w.begins[k + 1] - width + 1)
            at = np.searchsorted(codes, pack(w.flat, starts, width, len(w.vocabulary) + 1))
            best = int(np.lexsort((codes[at], counts[width][at]))[0])
            own.append(k)
            offset.append(best)
            shingle.append(at[best])
        order = np.argsort(np.array(shingle, np.int64), kind="stable")
        first = np.searchsorted(np.array(shingle, np.int64)[order], np.arange(len(codes) + 1))
        out[width] = np.array(own, np.int64)[order], first, np.array(offset, np.int64)[order]
    return out


def verified(w: Windows, lead: dict, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start token, window, text) of all windows that occur, in pieces."""
    sizes = np.diff(w.begins)
    for width, ids, ends, at, which in occurrences(w, texts):
        own, first, offset = lead[width]
        n = (first[which + 1] - first[which]) if len(which) else which
        at, which, n = at[n > 0], which[n > 0], n[n > 0]
        run = np.cumsum(n)
        done = 0
        while done < len(at):
            stop = max(done + 1, int(np.searchsorted(run, (run[done - 1] if done else 0) + AT_ONCE, "right")))
            p, k, m = at[done:stop], which[done:stop], n[done:stop]
            done = stop
            inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            entry = np.repeat(first[k], m) + inner
            window, start = own[entry], np.repeat(p, m) - offset[entry]
            doc = np.searchsorted(ends, np.repeat(p, m), "right") - 1
            fits = (start >= ends[doc]) & (start + sizes[window] <= ends[doc + 1])
            window, start, doc = window[fits], start[fits], doc[fits]
            for size in np.unique(sizes[window]):
                some = sizes[window] == size
                span = np.arange(size)
                same = (ids[start[some][:, None] + span] == w.flat[w.begins[window[some]][:, None] + span]).all(1)
                yield start[some][same], window[some][same], doc[some][same]


def _hits(texts: pa.Array, w: Windows, lead: dict, at: np.ndarray, edge: np.ndarray, items: list[set[str]]) -> None:
    """Add the windows of a block that occur: a step up and down in edge at each, and their items to each text."""
    sizes = np.diff(w.begins)
    for start, window, doc in verified(w, lead, texts):
        np.add.at(edge, start + doc, 1)  # a place more for each text, so that ranges don't run together
        np.add.at(edge, start + doc + sizes[window], -1)
        pairs = np.unique(doc * len(sizes) + window)
        for d, k in zip((pairs // len(sizes)).tolist(), (pairs % len(sizes)).tolist(), strict=True):
            items[d].update(w.items[k])


def _spans(at: np.ndarray, edge: np.ndarray, rows: int) -> pa.ListArray:
    hit = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0]))
    begins, stops = np.flatnonzero(np.diff(hit) > 0), np.flatnonzero(np.diff(hit) < 0)
    owner = np.searchsorted(at + np.arange(rows + 1), begins, "right") - 1
    shift = (at + np.arange(rows + 1))[owner]
    spans = pa.StructArray.from_arrays([pa.array(begins - shift, pa.int64()), pa.array(stops - shift, pa.int64())], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), spans)


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", one_in: int = 20, carry: bool = False) -> DataFrame:
    """For each row: id (if carry, instead a struct ``row`` of all columns), n_words, n_hit, n_items, items, spans and contaminated.

    Words are letters, digits and all beyond ASCII, A-Z lowered. spans are the merged word ranges that windows cover, n_hit
    their words; contaminated if that is one of ``one_in`` words at least. Null texts have no words, and items without
    words no windows; an item shorter than 13 words is one window. Repeated rows and items are kept each; a null item id
    is the text "null". Empty documents give no rows, an empty benchmark no hits; a very long text is worked on whole, and
    other columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    text_batches(spark)
    columns = [F.col(f"`{c}`") for c in documents.columns] if carry else [F.col(id_col)]
    text = F.col(text_col).cast("string").alias("text")
    docs = documents.select(F.struct(*columns).alias("row"), *([] if carry else [text]))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (5 * ITEM_WORDS)))  # no word takes less than two characters with its blank, most six
    blocks, sizes = [], []
    for k in range(n):  # the driver makes one block of windows at a time
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        w = windows([(r["item"], r["text"]) for r in some.toLocalIterator()])
        blocks.append(share(spark, w))
        sizes.append({width: len(codes) for width, codes in w.codes.items()})
    counts = rarity(documents.select(text), blocks, sizes)
    leads = [share(spark, (block(), prefixes(block(), own))) for block, own in zip(blocks, counts, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = loaded(leads)
        for batch in with_text(batches, text_col):
            parts = list(slices([batch], "text"))
            state = []
            for part in parts:
                at = np.concatenate(([0], np.cumsum(word_sizes(part.column("text"), ALNUM))))
                state.append((at, np.zeros(at[-1] + part.num_rows + 1, np.int64), [set() for _ in range(part.num_rows)]))
            for w, lead in items():
                for part, (at, edge, found) in zip(parts, state, strict=True):
                    _hits(part.column("text"), w, lead, at, edge, found)
            for part, (at, edge, found) in zip(parts, state, strict=True):
                names = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(at)), _spans(at, edge, part.num_rows), names], names=["row", "n_words", "spans", "items"])

    merged = docs.mapInArrow(work, fields("n_words long, spans array<struct<start: long, stop: long>>, items array<string>", row=docs.schema["row"].dataType))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    out = merged.select("row" if carry else "row.*", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
