"""Exact Jaccard similarity of word-shingle sets, for the near copies that a 64-bit SimHash can't tell.

Two indexes lead to the candidates, and any two sets of the similarity meet in one of them. The first has the least hashes of
each set (its prefix). Where more than CROWD sets share such a hash, which a common passage or a large group of
near copies does, their sets are cut into segments by hash, of which similar sets have one in common, content and all;
a passage alone makes no equal segment. There each set is compared with the least at the segment, and what that leaves
apart in blocks by their sketches. Candidates are verified by counting common shingles.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.llm import simhash
from semspark.llm.components import components
from semspark.llm.crowds import by_blocks
from semspark.llm.scratch import cut, few, forget, text_batches
from semspark.llm.text import BLANKS, slices, tokenize

SEED = 42
#: Least and most bits of a sketch.
SKETCH, SKETCH_MOST = 1 << 10, 1 << 20
#: Keys with up to this many sets compare all of them.
CROWD = 32
#: Sizes at which a class of set sizes begins: each class reaches half as far again.
STARTS = [1]
while STARTS[-1] < 1 << 40:
    STARTS.append(max(STARTS[-1] + 1, STARTS[-1] * 3 // 2))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit integers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, ascending; one of all words if they are fewer than width."""
    tokens = tokenize(texts, BLANKS)
    words = tokens.words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    hashes = each[words.indices.to_numpy()] if len(each) else each
    rolled = np.full(max(len(hashes) - width + 1, 0), width, np.uint64)
    for i in range(width):
        rolled = mix(rolled + hashes[i : i + len(rolled)])
    out = []
    for a, b in zip(tokens.ends[:-1].tolist(), tokens.ends[1:].tolist(), strict=True):
        if 0 < b - a < width:
            one = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                one = mix(one + h)
            out.append(one)
        else:
            out.append(np.unique(rolled[a : max(a, b - width + 1)]))
    return out


def set_hash(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), SEED) if len(members) else 0


def set_fingerprint(members: np.ndarray) -> int:
    """64-bit SimHash of a set, 0 if it is empty."""
    ones = np.zeros(simhash.BITS, np.int64)
    for start in range(0, len(members), simhash.AT_ONCE):
        part = members[start : start + simhash.AT_ONCE].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, simhash.BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(members)).view(">u8")[0])


def prefix(members: np.ndarray, similarity: tuple[int, int] = (4, 5)) -> np.ndarray:
    """Keys of a set: its least hashes, as many as it can lack in a set of the similarity, and one more."""
    n, (p, q) = len(members), similarity
    return members[: n + (-n * p // q) + 1] if n else members


def segments(members: np.ndarray, similarity: tuple[int, int] = (4, 5)) -> np.ndarray:
    """Keys of a set such that any two sets of at least the similarity p / q have one in common.

    If the smaller of two such sets has at most m members, they differ in at most d = m (q - p) / p. Members are dealt by
    hash to more than d segments, so that some segment is the same in both; its key is that of its members. A class of
    sizes has its own m and number of segments k, and a set has the keys of each class that a smaller partner can be in.
    Of the k - d segments or more that are the same one isn't empty, unless both sets leave so many empty; such a set also
    has the keys of its least hashes, one of which it shares with a set of that similarity.
    """
    n, (p, q) = len(members), similarity
    if not n:
        return members
    out = []
    for c in range(bisect_right(STARTS, -(-n * p // q)) - 1, bisect_right(STARTS, n)):
        d = (STARTS[c + 1] - 1) * (q - p) // p
        k = d + 1 + d // 6
        place = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as members are
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(mix(members), first)
        out.append(mix(sums + mix(place[first] + np.uint64(c << 40))))
        if len(first) <= d:
            out.append(mix(prefix(members, similarity) + mix(np.array([(c << 40) + (1 << 39)], np.uint64))))
    return np.unique(np.concatenate(out))


def sketch(members: np.ndarray) -> np.ndarray:
    """For each value of a hash whether an odd number of members has it, as bits of longs: as many as members, or up to twice as many."""
    bits = min(max(SKETCH, 1 << max(len(members) - 1, 0).bit_length()), SKETCH_MOST)
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def folded_column(own: Column, other: Column) -> Column:
    """A sketch in the length of another's, if that has half as many bits."""
    half = (F.size(own) / 2).cast("int")
    return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(own)


def rows_of(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp, hash, n, sim, sketch) for each row: fp is a hash of the set of n shingles (0 without words), sim its SimHash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            fps = pa.array(np.array([set_hash(x) for x in sets], np.uint64).view(np.int64))
            sims = pa.array(np.array([set_fingerprint(x) for x in sets], np.uint64).view(np.int64))
            lists = pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), fps, batch.column("hash"), pa.array([len(x) for x in sets], pa.int64()), sims, lists], names=["id", "fp", "hash", "n", "sim", "sketch"])

    text_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("hash"), "text")
    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, fp long, hash long, n long, sim long, sketch array<long>")


def shared_keys(texts: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """(key, fp, n) for the keys that n different sets have, n at least 2, from the texts of a column ``text``.

    Keys are counted first, with partial sums, so that the many that one text alone has go no further. They take more room
    than the texts, so that they are made again rather than written.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            keys = [keys_of(x) for x in sets]
            fps = np.repeat(np.array([set_hash(x) for x in sets], np.uint64), [len(x) for x in keys])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "fp"])

    rows = texts.select("text").mapInArrow(work, "key long, fp long")
    again = cut(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    forget(texts.sparkSession)
    members = cut(rows.join(again, "key").distinct())
    forget(texts.sparkSession)
    return cut(members.join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))


def apart(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def all_pairs(members: DataFrame, differ: str | None = None) -> DataFrame:
    """(a, b) of the (key, fp, root) at keys of at most CROWD sets; with ``differ`` only those of different roots."""
    lists = members.groupBy("key").agg(F.collect_list(F.struct("fp", "root")).alias("m"))
    first = lists.select("m", F.explode("m").alias("x"))
    second = F.filter("m", lambda y: (y["fp"] > F.col("x.fp")) & (y["root"] != F.col("x.root")) if differ else y["fp"] > F.col("x.fp"))
    return first.select(F.col("x.fp").alias("a"), F.explode(second).alias("y")).select("a", F.col("y.fp").alias("b"))


def possible(na: Column, nb: Column, bits: Column, similarity: tuple[int, int]) -> Column:
    """Whether sets of these sizes, whose sketches differ in so many bits, can have the similarity.

    Sets of that similarity differ in at most (q - p) / (q + p) of their members' total, and their sketches in no more
    bits than the sets in members.
    """
    p, q = similarity
    return (na * p <= nb * q) & (nb * p <= na * q) & (bits * (p + q) <= (na + nb) * (q - p))


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets have at least the similarity; nodes has (fp, x, n, sketch), texts (id, hash, text)."""
    p, q = similarity
    sides = [nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]
    bits = F.aggregate(F.zip_with(folded_column(F.col("sa"), F.col("sb")), folded_column(F.col("sb"), F.col("sa")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(f"na * {p} <= nb * {q} AND nb * {p} <= na * {q}")  # so sketches differ by one doubling at most
    maybe = sized.where(possible(F.col("na"), F.col("nb"), bits, similarity))
    maybe = cut(maybe.select("a", "b"))
    ends = maybe.select(F.col("a").alias("fp")).unionByName(maybe.select(F.col("b").alias("fp"))).distinct()
    wanted = cut(nodes.join(ends, "fp").select("fp", F.col("x.id").alias("id"), F.col("x.hash").alias("hash")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            members = pa.array([x.view(np.int64) for x in shingle_sets(batch.column("text"), width)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), members], names=["fp", "members"])

    rows = texts.alias("d").join(few(wanted).alias("w"), F.expr("d.id <=> w.id AND d.hash = w.hash")).select("w.fp", "d.text")
    sets = cut(rows.dropDuplicates(["fp"]).mapInArrow(work, "fp long, members array<long>"))
    left = sets.select(F.col("fp").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))
    both = maybe.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n"), (F.size("x") + F.size("y")).cast("long").alias("total"))
    return cut(both.where(F.col("n") * (p + q) >= F.col("total") * p).select("a", "b"))


def crowd_pairs(members: DataFrame, nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of the (key, fp, root) at a key whose roots differ and that sizes and sketches let pass, by blocks."""
    p, q = similarity
    rows = members.join(nodes.select("fp", F.col("n").alias("size"), "sketch"), "fp")

    def compare(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        fa, ra, na = (left.column(c).to_numpy() for c in ("fp", "root", "size"))
        fb, rb, nb = (right.column(c).to_numpy() for c in ("fp", "root", "size"))
        by_length: dict[int, list[int]] = {}
        own = [np.array(x, np.int64) for x in left.column("sketch").to_pylist()]
        others = [np.array(x, np.int64) for x in right.column("sketch").to_pylist()]
        for j, x in enumerate(others):
            by_length.setdefault(len(x), []).append(j)
        tables = {n: (np.array(js), np.stack([others[j] for j in js])) for n, js in by_length.items()}
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, x in enumerate(own):
            ok = (rb != ra[i]) & (nb * p <= na[i] * q) & (na[i] * p <= nb * q)
            if same:
                ok[: i + 1] = False
            for n, (js, sketches) in tables.items():
                at = np.flatnonzero(ok[js])
                if not len(at) or n not in (len(x), 2 * len(x), len(x) // 2):
                    continue
                part = folded(sketches[at]) if n > len(x) else sketches[at]
                bits = np.bitwise_count((part ^ (folded(x) if n < len(x) else x)).view(np.uint64)).sum(1, dtype=np.int64)
                at = js[at]
                at = at[bits * (p + q) <= (nb[at] + na[i]) * (q - p)]
                out.append((np.full(len(at), fa[i]), fb[at]))
        return pa.table({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    return by_blocks(rows, ["key"], "fp", compare, "a long, b long")


def hinted(nodes: DataFrame, distance: int) -> DataFrame:
    """Candidates (a, b) by the SimHash index: sets with one SimHash and with neighbouring ones, tied to the least of each."""
    sims = cut(nodes.where("n > 0").groupBy("sim").agg(F.min("fp").alias("lead")))
    same = nodes.where("n > 0").join(sims, "sim").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    near = simhash.links(sims.select(F.col("sim").alias("fp")), distance)
    lead = lambda c: sims.select(F.col("sim").alias(c), F.col("lead").alias(f"lead_{c}"))
    return same.unionByName(near.join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")))


def links(docs: DataFrame, documents: DataFrame, id_col: str, text_col: str, width: int, similarity: tuple[int, int], distance: int) -> DataFrame:
    """Links (a, b) that connect all sets, named by fp, of at least the similarity. docs: what rows_of gives."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("x")
    nodes = cut(docs.groupBy("fp").agg(first, F.any_value("n").alias("n"), F.any_value("sim").alias("sim"), F.any_value("sketch").alias("sketch")))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    keyed = shared_keys(texts, lambda x: prefix(x, similarity), width)
    pairs = apart(hinted(nodes, distance).unionByName(all_pairs(keyed.where(F.col("n") <= CROWD).withColumn("root", F.col("fp")))))
    crowd = cut(keyed.where(F.col("n") > CROWD).select("fp").distinct())
    if not crowd.count():
        return similar(pairs, nodes, texts, width, similarity)
    wanted = cut(nodes.join(crowd, "fp").select(F.col("x.id").alias("i"), F.col("x.hash").alias("h")))
    own = texts.join(few(wanted), F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left_semi")
    parted = shared_keys(own, lambda x: segments(x, similarity), width).drop("n")
    least = parted.groupBy("key").agg(F.min("fp").alias("a"))
    star = parted.join(least, "key").select("a", F.col("fp").alias("b"))
    near = similar(apart(pairs.unionByName(star)), nodes, texts, width, similarity)
    known = components(near)
    members = parted.join(known, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_ = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    members = cut(members.join(open_, "key"))
    rest = all_pairs(members.where(F.col("n") <= CROWD), differ="root").unionByName(crowd_pairs(members.where(F.col("n") > CROWD).drop("n"), nodes, similarity))
    return near.unionByName(similar(apart(rest), nodes, texts, width, similarity))


def classes(documents: DataFrame, id_col: str, text_col: str, width: int, similarity: tuple[int, int], distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, fp, hash, ...), and the root of the component of each distinct set (fp, root)."""
    docs = cut(rows_of(documents, id_col, text_col, width))
    roots = components(links(docs, documents, id_col, text_col, width, similarity, distance))
    return docs, docs.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
