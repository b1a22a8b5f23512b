"""SimHash near-duplicates by multi-index hashing: a table for each segment of the fingerprints, probed by small Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.llm.components import components
from semspark.llm.crowds import by_blocks, forest
from semspark.llm.scratch import cut, few, text_batches
from semspark.llm.text import BLANKS, slices

SEED, BITS = 42, 64
#: Shingles hashed at a time, so that a very long text needs no more hashes in memory than this many.
AT_ONCE = 1 << 16
#: Buckets of a segment's table with more distinct fingerprints than this are crowded: they are looked up in another way.
CROWD = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().translate(BLANKS).split()
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, AT_ONCE):
        part = words[start : start + AT_ONCE + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, hash) for each row; fp is the fingerprint's bits as a long, hash one of the text. A null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x, width) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64)), batch.column("hash")], names=["id", "fp", "hash"])

    text_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("hash"), "text")
    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, fp long, hash long")


def layout(distance: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment: fingerprints within ``distance`` bits are within the radius in one of them.

    Radii of r0, r1, ... find all pairs if the sum of r + 1 exceeds the distance. Up to 3 bits two segments of 32 do with
    radii of 1 at most; beyond, there are more and narrower segments, so that balls stay small.
    """
    if not 0 <= distance < BITS:
        raise ValueError(f"distance {distance}: not of {BITS} bits")
    parts = max(2, -(-(distance + 1) // 2))
    least, more = divmod(distance + 1, parts)
    edges = [BITS * k // parts for k in range(parts + 1)]
    found = [(edges[k], edges[k + 1] - edges[k], least - (k >= more)) for k in range(parts)]
    return [x for x in found if x[2] >= 0]


def _segment(fp: str, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def links(table: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within ``distance`` differing bits.

    Each segment has a table from its value to the fingerprints. A fingerprint looks up its own value and, where the
    segment's radius is 1, each value with one of its set bits cleared: of two values that differ in one bit one has it
    set. What it fetches is verified by the complete distance. So a fingerprint makes about 20 rows at 2 bits.

    Buckets of over CROWD fingerprints aren't fetched, since a group of near copies would make rows by its square. Those
    who are in or look up such a bucket meet instead at complete fingerprints within one bit of theirs (up to 2 bits),
    or are compared in pairs of blocks, of which a spanning forest is kept (beyond); both exact.
    """
    segments = layout(distance)
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if distance == 0:
        return table.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    at = lambda k, value: F.struct(F.lit(k).alias("segment"), value.alias("value"))
    own = F.array(*(at(k, _segment("fp", low, width)) for k, (low, width, _) in enumerate(segments)))
    def ball(k: int, value: Column, width: int) -> Column:
        cleared = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: value.bitwiseAND(F.bitwise_not(_bit(i))))
        return F.transform(F.filter(cleared, lambda x: x != value), lambda x: at(k, x))

    balls = [ball(k, _segment("fp", low, width), width) for k, (low, width, radius) in enumerate(segments) if radius]
    nodes = table.select("fp").repartition(parts, "fp")  # each becomes many rows
    tables = nodes.select("fp", F.explode(own).alias("s")).select("s.segment", "s.value", "fp")
    probes = tables.withColumn("flipped", F.lit(False))
    if balls:
        more = nodes.select("fp", F.explode(F.concat(*balls)).alias("s")).select("s.segment", "s.value", "fp")
        probes = probes.unionByName(more.withColumn("flipped", F.lit(True)))
    crowded = cut(tables.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD))
    some = crowded.count()
    plain = tables
    if some:
        plain = tables.join(F.broadcast(crowded) if some <= 10_000 else crowded, ["segment", "value"], "left_anti")
    pairs = probes.withColumnRenamed("fp", "a").join(plain.withColumnRenamed("fp", "b"), ["segment", "value"]).where("flipped OR a < b")
    found = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    if not some:
        return found
    near = cut(probes.join(F.broadcast(crowded) if some <= 10_000 else crowded, ["segment", "value"], "left_semi"))
    rest = _meeting(near.select("fp").distinct(), distance) if distance <= 2 else _compared(near.select("segment", "value", "fp").distinct(), distance)
    return found.unionByName(rest)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _meeting(table: DataFrame, distance: int) -> DataFrame:
    """Links within 1 or 2 bits of distinct fingerprints, through all complete fingerprints within one bit of each.

    A key comes to one row, a mask of the flipped bits; its members differ by 2 bits at most and are tied to the least of
    them, never in all pairs. So rows are 65 for each fingerprint, whatever the size of a group.
    """
    flips = F.sequence(F.lit(-1), F.lit(BITS - 1))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = table.repartition(parts, "fp").select("fp", F.explode(flips).alias("i"))
    flip = F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(_bit(F.greatest("i", F.lit(0))))
    hits = balls.select(F.col("fp").bitwiseXOR(flip).alias("key"), flip.alias("mask"), (F.col("i") < 0).alias("own")).groupBy("key").agg(F.bit_or("mask").alias("mask"), F.bool_or("own").alias("own"))
    found = hits.where((F.bit_count("mask") + F.col("own").cast("int")) >= 2)
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("mask").bitwiseAND(_bit(i)) != 0)
    near = F.transform(set_bits, lambda i: F.col("key").bitwiseXOR(_bit(i)))
    if distance == 1:
        found = found.where("own")
    members = F.when(F.col("own"), F.concat(F.array("key"), near)).otherwise(near)
    hub = F.when(F.lit(distance == 1), F.col("key")).otherwise(F.array_min("members"))
    pairs = found.select("key", members.alias("members")).select(hub.alias("a"), F.explode("members").alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def _compared(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within the distance among those at a bucket (segment, value), a spanning forest for each two blocks."""

    def compare(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        fps = left.column("fp").to_numpy() if same else np.concatenate((left.column("fp").to_numpy(), right.column("fp").to_numpy()))
        root = forest(np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= distance)
        tied = root != np.arange(len(fps))
        return pa.table({"a": fps[tied], "b": fps[root[tied]]})

    return by_blocks(rows, ["segment", "value"], "fp", compare, "a long, b long")


def classes(documents: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, fp, hash), and the distinct fingerprints (fp, least id, root: that of their component)."""
    docs = cut(fingerprints(documents, id_col, text_col, width))
    nodes = cut(docs.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), distance))
    return docs, nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for each row; component_id is the least id among all that links reach.

    Rows whose fingerprints differ in at most ``distance`` bits link. Exact copies share a fingerprint and are one node,
    texts without words too (null texts and fingerprint 0). A null id is no least id unless its component has no other.
    Repeated rows come back each; an empty table gives none; other columns, whatever their names, are not read. A very
    long text is hashed AT_ONCE shingles at a time, though its words are held as one list.
    """
    docs, tied = classes(documents, id_col, text_col, width, distance)
    tied = tied.join(tied.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    out = docs.join(tied, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5), distance: int = 3) -> DataFrame:
    """One row, with all columns, of each component of near copies: that of the least id (null ids last).

    Rows link whose sets of word shingles have at least the Jaccard similarity p / q, counted exactly; all texts without
    words are copies of each other. Candidates come first from the SimHash index at ``distance`` bits. Texts of similarity
    0.8 differ in up to 18 bits, which no index of 64 bits finds at a bearable cost, so ``semspark.llm.jaccard`` finds the
    rest. Of several rows with the least id the least fingerprint, then the least text hash, then the least hash of all
    columns decides. An empty table stays empty; extra columns of any name come back as they are.
    """
    from semspark.llm import jaccard

    docs, tied = jaccard.classes(documents, id_col, text_col, width, similarity, distance)
    return keep_first(documents, docs, tied, id_col, text_col)


def keep_first(documents: DataFrame, docs: DataFrame, tied: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of the least id of each root, given the rows (id, fp, hash) and the root of each fp."""
    each = docs.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "hash")).alias("x"))  # partial first
    first = each.join(tied.select("fp", "root"), "fp").groupBy("root").agg(F.min("x").alias("x"))
    kept = first.select(F.col("x.id").alias("kept"), F.col("x.hash").alias("kept_hash"))
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(row.alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    kept, own = cut(kept), F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash"))
    rows = rows.join(few(kept), own, "left_semi")
    # rows of one id and text are rare, so that only they meet
    twice = cut(docs.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("kept"), F.col("hash").alias("kept_hash")))
    if not twice.count():
        return rows.select("row.*")
    first = rows.join(few(twice), own, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return rows.join(few(twice), own, "left_anti").select("row.*").unionByName(first.select("row.*"))
