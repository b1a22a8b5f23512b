"""Tables that cut lineage, in the folder that the session shares between driver and executors."""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def packed(value: Any) -> tuple[int, bytes]:
    """A value of bounded size as ``share_packed`` takes it: the size of its pickle, and the pickle compressed."""
    raw = cloudpickle.dumps(value)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def share_packed(spark: SparkSession, size: int, data: bytes) -> Callable[[], Any]:
    """Broadcast what ``packed`` gave, perhaps in a task; call the result in a task to get the value."""
    sent = spark.sparkContext.broadcast(data)
    return lambda: pickle.loads(pa.decompress(sent.value, size, codec="zstd", asbytes=True))  # noqa: S301


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a value of bounded size, compressed; call the result in a task to get it. Classes of this package travel by value."""
    return share_packed(spark, *packed(value))


#: Rows of an Arrow batch where whole texts go to Python, and the setting that bounds them.
TEXT_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to TEXT_ROWS rows, unless something else than Spark's default is set.

    The JVM and Python each hold several copies of a batch outside the heap; rows with texts are large.
    """
    if spark.conf.get(BATCH_SETTING, "10000") == "10000":
        spark.conf.set(BATCH_SETTING, str(TEXT_ROWS))


#: Folders made so far, in their order.
_MADE: list[str] = []


def made() -> int:
    """How many folders there have been: a mark for sweep."""
    return len(_MADE)


def sweep(spark: SparkSession, first: int, last: int, keep: DataFrame) -> None:
    """Remove the folders made between two marks, but for those that ``keep`` reads from."""
    needed = [str(x).split("semspark-", 1)[-1][:32] for x in keep.inputFiles() if "semspark-" in str(x)]
    for folder in _MADE[first:last]:
        if folder[-32:] not in needed:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, removed when the session's file systems close.

    Only where no checkpoint folder is set, on a single machine, a temporary one becomes it; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = f"file://{tempfile.mkdtemp(prefix='semspark-')}"
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/semspark-{uuid.uuid4().hex}"
    _MADE.append(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


#: Schemes of paths that tasks open through pyarrow, and the name that it has for each.
OPENED = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def opened(path: str) -> pa.NativeFile:
    """A stream of a file in a shared folder, read piece by piece wherever the caller runs."""
    scheme, colon, rest = path.partition(":")
    uri = f"{OPENED[scheme]}:{rest}" if colon else f"file://{path}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    if uri.startswith("file://"):
        return pa.OSFile(unquote(uri[7:]))
    fs, name = pa.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(name)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lost executors cost no recomputation past here."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Tables of ids and hashes of at most so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, a written table of ids and hashes, to be broadcast where it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of df, those of the least hash of their key; all, if there are no more.

    Rows are thinned by hash where they lie, so that about ``most`` rows move, however many there are.
    """
    n, grain = df.count(), 1 << 30
    if n > most:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(grain)) < int(grain * most / n))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(grain)), key).limit(most)
