"""Shared helpers of this subpackage: input tables, stored intermediates, byte batches with substring hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterline import session

#: A word is a maximal run of bytes outside these.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 21  # text worked on at once inside a task; longer single texts form a chunk of their own


def load(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = session.fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit keys."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps)
    return have[:n]


class Rolling:
    """Hashes of any substring of one symbol sequence in constant time (polynomial, modulo 2^64)."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.h = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_BASE, n), out=self.h[1:])
        self.inv = _power(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.h[end] - self.h[start]) * self.inv[start] + (end - start).astype(np.uint64))


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Bytes:
    """The UTF-8 bytes of several texts end to end; document i is data[off[i]:off[i + 1]]."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data, self.off = data, off
        self.n = len(off) - 1

    def lower(self) -> Bytes:
        return Bytes(LOWER[self.data], self.off)

    def values(self) -> np.ndarray:
        return BYTE_VALUE[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word."""
        inside = ~IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.off] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, self.doc_of(starts)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte by document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Bytes]]:
    """Slices of an Arrow batch whose texts have about `limit` bytes together; null texts count as empty."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, len(col))
        yield batch.slice(lo, hi - lo), Bytes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


def repeated(key: np.ndarray) -> np.ndarray:
    """Marks the keys that occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(total)
