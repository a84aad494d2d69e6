"""Shared helpers: session, tables and numpy views of Arrow text columns.

Text operators run in ``mapInArrow``. They look at a column's UTF-8 buffer as
one numpy array and work through it in blocks of a few megabytes, so a task
holds one Arrow batch and one block at a time, however long its partition is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.session import run_dir, tune

#: Bytes of text that a numpy block holds (a longer text is a block of its own).
BLOCK = 2 << 20
#: Rows and bytes of an Arrow batch sent to a Python worker.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
              "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}

SPACES = b" \t\n\v\f\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE_KEYS = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_KEYS = _random.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP_KEYS = _random.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators; workers find the package by path too."""
    tune(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def crc_mod(column: str, divisor: int):
    """crc32 of an id as text, modulo a number; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and validity of a text or binary column (NULL: empty)."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    buffers = column.buffers()
    n = len(column)
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offsets = np.frombuffer(buffers[1], width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    if column.null_count:  # a NULL's slot may hold bytes
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                                  else b"")
        data, offsets, _ = utf8(column)
        return data, offsets, valid
    return data[offsets[0]:offsets[-1]], offsets - offsets[0], valid


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def text_blocks(column: pa.Array, limit: int = BLOCK):
    """(first row, last row, bytes, offsets, validity) of each block."""
    data, offsets, valid = utf8(column)
    for low, high in blocks(offsets, limit):
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], valid[low:high]


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags that do not cross a row: starts, ends, first run of each row."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin, finish = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    finish[:-1] &= ~flags[1:]
    edges = offsets[:-1][offsets[:-1] < len(flags)]
    begin[edges] = flags[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    finish[edges] = flags[edges]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans do not overlap and are in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(total) - np.repeat(first, lengths)
    if total != len(data):
        data = data[np.repeat(starts, lengths) + place]
    values = BYTE_KEYS[data] * PLACE_KEYS[place & 4095]
    # an empty span at the end would index past the array
    sums = np.add.reduceat(np.append(values, np.uint64(0)), first)
    sums[lengths == 0] = 0
    return mix(sums + lengths.astype(np.uint64) * STEP_KEYS[7])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, their spans and each row's first word."""
    if lower:
        data = LOWER[data]
    starts, ends, firsts = spans(IS_WORD[data], offsets)
    return hash_spans(data, starts, ends), starts, ends, firsts


def windows(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words inside each row, and each row's first window."""
    counts = np.maximum(np.diff(firsts) - n + 1, 0)
    edges = np.concatenate(([0], np.cumsum(counts)))
    if not edges[-1]:
        return np.zeros(0, np.uint64), edges
    at = np.arange(edges[-1]) + np.repeat(firsts[:-1] - edges[:-1], counts)
    sums = np.zeros(len(at), np.uint64)
    for k in range(n):
        sums += hashes[at + k] * STEP_KEYS[k]
    return mix(sums), edges


def row_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive edges; an empty range sums to 0."""
    kind = np.float64 if values.dtype.kind == "f" else values.dtype
    out = np.zeros((len(edges) - 1, *values.shape[1:]), kind)
    some = np.flatnonzero(np.diff(edges) > 0)
    if len(some):
        out[some] = np.add.reduceat(values[:edges[-1]], edges[:-1][some], axis=0, dtype=kind)
    return out


def binary_column(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from its bytes and row offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                  pa.py_buffer(data)]).cast(pa.binary())


def add_columns(docs: DataFrame, function, schema: str, *inputs: str) -> DataFrame:
    """``docs`` with columns that a function of Arrow batches adds row by row.

    The function gets the batch of input columns and returns arrays for the
    columns of ``schema``; all columns of ``docs`` pass through unread, but for
    those that have the name of a new one, which takes their place.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    position = [docs.columns.index(c) for c in inputs]
    passed = [k for k, c in enumerate(docs.columns) if c not in added.names]
    whole = StructType([docs.schema.fields[k] for k in passed] + added.fields)

    def run(batches):
        for batch in batches:
            new = function(pa.RecordBatch.from_arrays([batch.column(i) for i in position], list(inputs)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), *new], whole.names)

    return docs.mapInArrow(run, whole)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe when executors go."""
    path = run_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def block_texts(column: pa.Array):
    """The texts of a column, some megabytes at a time (NULL: empty)."""
    for low, high, _, _, _ in text_blocks(column):
        yield [t or "" for t in column.slice(low, high - low).to_pylist()]
