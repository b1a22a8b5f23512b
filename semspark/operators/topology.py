"""Shared nodes and entities of a mesh, direct stiffness, boundaries, masks and subdomains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semspark.operators import elements as el


def node_key(coordinates: Sequence[Column], tolerance: float = 1e-8) -> Column:
    """Coordinates on a grid of the tolerance: nodes of equal keys are one."""
    return F.struct(*(F.round(c / tolerance).cast("long").alias(f"k{i}") for i, c in enumerate(coordinates)))


def multiplicity(nodes: DataFrame, key: Sequence[str], out: str = "multiplicity") -> DataFrame:
    """How many rows share each node. One exchange by the key; a node belongs to a few elements only."""
    return nodes.withColumn(out, F.count("*").over(Window.partitionBy(*key)))


def dssum(nodes: DataFrame, fields: Sequence[str], key: Sequence[str], average: bool = True) -> DataFrame:
    """Direct stiffness: each node's field becomes the sum over all rows that share it, divided by the multiplicity."""
    w = Window.partitionBy(*key)
    f = F.avg if average else F.sum
    return nodes.withColumns({c: f(c).over(w) for c in fields})


def dssum_skewed(nodes: DataFrame, fields: Sequence[str], key: Sequence[str], average: bool = True) -> DataFrame:
    """dssum for keys that many rows share (poles, periodic planes): partial sums first, then a join that can be split."""
    f = F.avg if average else F.sum
    sums = nodes.groupBy(*key).agg(*(f(c).alias(f"_{c}") for c in fields))
    return nodes.join(sums, list(key)).withColumns({c: F.col(f"_{c}") for c in fields}).drop(*(f"_{c}" for c in fields))


def entities(mesh: DataFrame, n: int, kind: str, tolerance: float = 1e-8) -> DataFrame:
    """(elem_id, entity, key) for the vertices, edges or facets of all elements; equal keys are the same place."""
    q = lambda x: F.round(x / tolerance).cast("long")
    if kind == "vertex":
        rows = F.arrays_zip(*(F.transform(el.vertices(c, n), q).alias(c) for c in "xyz"))
        return mesh.select("elem_id", F.posexplode(rows).alias("entity", "key"))
    if kind == "edge":
        ends = lambda c: F.transform(el.edges(c, n), lambda e: F.array(e[0], e[n - 1]))
        rows = F.arrays_zip(*(ends(c).alias(c) for c in "xyz"))
        both = mesh.select("elem_id", F.posexplode(rows).alias("entity", "e"))
        end = lambda i: F.struct(*(q(F.col(f"e.{c}")[i]).alias(c) for c in "xyz"))
        return both.select("elem_id", "entity", F.struct(F.least(end(0), end(1)).alias("a"), F.greatest(end(0), end(1)).alias("b")).alias("key"))
    mid = lambda c: F.array(*(F.aggregate(F.array(*(el.facet(c, w, n)[i] for i in (0, n - 1, n * n - n, n * n - 1))), F.lit(0.0), lambda a, x: a + x) / 4 for w in ("r-", "r+", "s-", "s+", "t-", "t+")))
    rows = F.arrays_zip(*(F.transform(mid(c), q).alias(c) for c in "xyz"))
    return mesh.select("elem_id", F.posexplode(rows).alias("entity", "key"))


def shared(entities: DataFrame, least: int = 2) -> DataFrame:
    """(key, members): the (elem_id, entity) pairs at each place that ``least`` of them share."""
    return entities.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("elem_id", "entity"))).alias("members")).where(F.size("members") >= least)


#: Members of a place that are joined with as many others at once, and pairs that a task is to make, roughly.
BLOCK, PAIRS = 1024, 1 << 23


def neighbours(entities: DataFrame) -> DataFrame:
    """Pairs (elem_id, other) of elements that share an entity, each once. An element has few entities.

    Members of crowded places are dealt into blocks of about BLOCK, and a task joins pairs of blocks; the number of
    tasks follows that of the pairs, which is counted at once. Elements that share several places meet at each, but the
    least of them alone makes their pair, so pairs aren't shuffled.
    """
    rows = entities.select("key", "elem_id").where("key IS NOT NULL AND elem_id IS NOT NULL").distinct()
    counts = rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    pairs = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0.0
    tasks = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), -int(-pairs // PAIRS))
    places = rows.groupBy("elem_id").agg(F.sort_array(F.collect_list("key")).alias("_all"))
    # null for an element of one place: what it shares it shares there
    members = places.select("elem_id", F.explode("_all").alias("key"), F.when(F.size("_all") > 1, F.col("_all")).alias("_all"))
    members = members.join(counts, "key").withColumn("_b", F.ceil(F.col("_n") / BLOCK).cast("int"))
    members = members.withColumn("_own", F.pmod(F.xxhash64("elem_id"), F.col("_b")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    left = members.select("key", "elem_id", "_all", F.col("_own").alias("_i"), each.alias("_j"))
    right = members.select("key", F.col("elem_id").alias("other"), F.col("_all").alias("_others"), each.alias("_i"), F.col("_own").alias("_j"))
    at = ["key", "_i", "_j"]
    both = left.repartition(tasks, *at).join(right.repartition(tasks, *at).hint("merge"), at).where("elem_id <> other")
    first = F.col("_all").isNull() | F.col("_others").isNull() | (F.array_min(F.array_intersect("_all", "_others")) == F.col("key"))
    return both.where(first).select("elem_id", "other")


def within(left: DataFrame, right: DataFrame, tolerance: float, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of points that agree within a tolerance in each coordinate: a join on grid cells and the cells beside.

    The right side goes to its own cell, the left to all 3 ** d around its own; the exact predicate follows.
    """
    cell = lambda c: F.floor(F.col(c) / (2 * tolerance)).cast("long")
    l, r = left, right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    r = r.withColumns({f"_c{i}": F.floor(F.col(f"r_{c}") / (2 * tolerance)).cast("long") for i, c in enumerate(columns)})
    for i, c in enumerate(columns):
        l = l.withColumn(f"_c{i}", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
    keys = [f"_c{i}" for i in range(len(columns))]
    close = F.lit(True)
    for c in columns:
        close = close & (F.abs(F.col(c) - F.col(f"r_{c}")) <= tolerance)
    return l.join(r, keys).where(close).drop(*keys)


def boundary(entities: DataFrame, mask: Column | None = None) -> DataFrame:
    """Entities that no other element shares, optionally only those where mask."""
    alone = entities.groupBy("key").agg(F.count("*").alias("_n")).where("_n = 1").select("key")
    out = entities.join(alone, "key", "left_semi")
    return out if mask is None else out.where(mask)


def element_mask(nodes: DataFrame, condition: Column, by: str = "elem_id") -> DataFrame:
    """The elements (by) of which any node meets the condition."""
    return nodes.groupBy(by).agg(F.bool_or(condition).alias("_any")).where("_any").select(by)


def partition(nodes: DataFrame, condition: Column, by: str = "elem_id") -> DataFrame:
    """All rows of the elements of which any node meets the condition."""
    return nodes.join(element_mask(nodes, condition, by), by, "left_semi")


def bounding_box(mesh: DataFrame, columns: Sequence[str] = ("x", "y", "z"), tolerance: float = 0.0) -> DataFrame:
    """Append <c>_min and <c>_max of the array columns, widened by the tolerance times half the side."""
    out = {}
    for c in columns:
        lo, hi = F.array_min(c).cast("double"), F.array_max(c).cast("double")
        pad = (hi - lo) * tolerance / 2
        out |= {f"{c}_min": lo - pad, f"{c}_max": hi + pad}
    return mesh.withColumns(out)


def subdomain(mesh: DataFrame, box: dict[str, tuple[float, float]] | None) -> DataFrame:
    """Elements whose bounding box has its centre strictly inside a box; without a box, all."""
    keep = F.lit(True)
    for c, (lo, hi) in (box or {}).items():
        mid = (F.array_min(c).cast("double") + F.array_max(c).cast("double")) / 2
        keep = keep & (mid > lo) & (mid < hi)
    return mesh.where(keep)


def balanced_ranks(elements: DataFrame, ranks: int, total: int, key: str = "elem_id") -> DataFrame:
    """Append rank: an even linear split of elements numbered from 0, the remainder to the first ranks."""
    size, more = divmod(total, ranks)
    e, cut = F.col(key), more * (size + 1)
    rest = F.floor((e - cut) / F.lit(max(size, 1))) + more
    return elements.withColumn("rank", F.when(e < cut, F.floor(e / (size + 1))).otherwise(rest).cast("int"))


def grouped_sections(centres: DataFrame, section: str, columns: Sequence[str] = ("x", "y"), digits: int = 6) -> DataFrame:
    """Bundles of elements at the same truncated place in different sections: (place, source, copies), copies ordered."""
    key = F.struct(*((F.floor(F.col(c) * 10**digits) / 10**digits).alias(c) for c in columns))
    rows = centres.groupBy(key.alias("place")).agg(F.sort_array(F.collect_list(F.struct(section, "elem_id"))).alias("_m"))
    ids = F.transform("_m", lambda m: m["elem_id"])
    return rows.select("place", F.element_at(ids, 1).alias("source"), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("copies"))
