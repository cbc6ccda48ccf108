"""Shared pieces: stored intermediate tables, bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import scratch_path

CHUNK_BYTES = 1 << 20
"""Text bytes that one numpy step handles at once; a longer text is a step of its own."""

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends at those files, so a
    lost executor repeats nothing before them, and several readers see the same rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text):
    """Words between ASCII blanks as an array; none for NULL and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` with at most CHUNK_BYTES of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + CHUNK_BYTES, "right")), start + 1)
        yield start, stop
        start = stop


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; NULL is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets.astype(np.int64) - int(offsets[0])


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, from 0 on."""
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK_BYTES + 1, 1 << (n - 1).bit_length())
        made = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C and P with hash(data[s:e]) = (C[e] - C[s]) * P[s] modulo 2^64."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[:-1], out=total[1:])
    return total, down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words between blanks, and each text's word range."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total, down = prefix_hash(data, _LETTER)
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, offsets)
