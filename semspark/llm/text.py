"""Tokens of whole Arrow batches of texts, found with byte tables instead of a loop over characters."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Texts are worked on in slices of about this many bytes (a longer text makes a slice of its own).
SLICE_BYTES = 2 << 20

_UPPER = {c: c + 32 for c in range(65, 91)}


def byte_table(separators: Iterable[int], lower: bool = True) -> bytes:
    """A translation of bytes: separators become blanks, and A-Z small letters if lower."""
    out = list(range(256))
    if lower:
        for c, d in _UPPER.items():
            out[c] = d
    for c in separators:
        out[c] = 32
    return bytes(out)


#: Words between the ASCII blanks 20 and 09 to 0D, with A-Z lowered or kept.
BLANKS = byte_table([32, *range(9, 14)])
BLANKS_KEEP_CASE = byte_table([32, *range(9, 14)], lower=False)
#: Words of letters, digits and everything beyond ASCII, with A-Z lowered.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Tokens(NamedTuple):
    words: pa.StringArray
    #: The tokens of text i are words[ends[i]:ends[i + 1]].
    ends: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.ends)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), self.counts())


def offsets_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return texts, np.zeros(1, np.int64)
    return texts, np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def raw_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; null counts as empty."""
    texts, at = offsets_of(texts)
    data = texts.buffers()[2] if len(texts) else None
    return b"" if data is None else bytes(memoryview(data)[at[0] : at[-1]]), at - at[0]


def tokenize(texts: pa.Array, table: bytes) -> Tokens:
    data, at = raw_bytes(texts)
    if not data:
        return Tokens(pa.array([], pa.string()), np.zeros(len(at), np.int64))
    data = np.frombuffer(data.translate(table), np.uint8)
    inside = data != 32
    change = inside[1:] != inside[:-1]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    change[edge - 1] = True
    cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(data)]))
    runs = inside[cuts[:-1]]
    starts, sizes = cuts[:-1][runs], np.diff(cuts)[runs]
    begins = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    kept = data[inside]
    if len(kept) < 2**31:
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(kept))
    else:
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(begins), pa.py_buffer(kept))
    return Tokens(words, np.searchsorted(starts, at))


def word_sizes(texts: pa.Array, table: bytes = BLANKS) -> np.ndarray:
    """The number of words of each text."""
    data, at = raw_bytes(texts)
    if not data:
        return np.zeros(len(at) - 1, np.int64)
    inside = np.frombuffer(data.translate(table), np.uint8) != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    first[edge] = inside[edge]
    return np.diff(np.searchsorted(np.flatnonzero(first), at))


def release() -> None:
    """Give freed memory back to the system: workers are used again, and so would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def with_text(batches: Iterable[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``text``, taken from the struct column ``row`` where it isn't there: it travels once."""
    for batch in batches:
        if "text" not in batch.schema.names:
            batch = batch.append_column("text", batch.column("row").field(text_col).cast(pa.string()))
        yield batch


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts together hold about SLICE_BYTES, a longer text alone."""
    for batch in batches:
        _, at = offsets_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + SLICE_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        release()


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of a key as text, modulo folds; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def fields(ddl: str, **first: DataType) -> StructType:
    """A schema of columns of given types, then those of ddl."""
    return StructType([*(StructField(k, v) for k, v in first.items()), *StructType.fromDDL(ddl).fields])
