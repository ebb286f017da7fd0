"""Pairs dealt out in classes as arrays: a row for each class of a part, not for each pair.

A pair is multiplied by an odd number, which spreads it over all 64 bits; classes are equal ranges of the products, so a sorted
part falls into slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Pairs of a class, about; a class is what a task holds at once.
CLASS = 1 << 20
_BY = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BY, -1, 1 << 64))
_BY_32 = 0x9E3779B1
_BACK_32 = np.uint64(pow(_BY_32, -1, 1 << 32))


def spread(b: np.ndarray) -> np.ndarray:
    return b * np.uint64(_BY)


def unspread(m: np.ndarray) -> np.ndarray:
    return m * _BACK


def spread_key(k: np.ndarray) -> np.ndarray:
    """Keys of 32 bits, in longs, spread over these bits."""
    return (k * np.uint64(_BY_32)) & np.uint64(0xFFFFFFFF)


def unspread_key(m: np.ndarray) -> np.ndarray:
    return (m * _BACK_32) & np.uint64(0xFFFFFFFF)


def class_edges(classes: int) -> np.ndarray:
    """Where the classes of spread keys begin, and the end of all."""
    return np.array([-(-(k << 32) // classes) for k in range(classes + 1)], np.uint64)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def class_count(spark: SparkSession, n: int) -> int:
    """Classes for ``n`` pairs: a multiple of the shuffle partitions."""
    parts = partitions(spark)
    return parts * max(1, -(-n // (parts * CLASS)))


def class_keys(spark: SparkSession, classes: int) -> np.ndarray:
    """A long for each class by which Spark's hash partitioning deals them out evenly."""
    parts, n = partitions(spark), 64 * classes
    got = spark.range(n).select(F.pmod(F.hash("id"), F.lit(parts)).alias("part"), "id").toArrow()
    part, key = got["part"].to_numpy(), got["id"].to_numpy()
    order = np.lexsort((key, part))
    starts = np.searchsorted(part[order], np.arange(parts))
    # by turns: some key of each partition, as far as it has one
    turn = np.arange(n) - starts[part[order]]
    return key[order][np.lexsort((part[order], turn))][:classes]


def dealt(m: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted spread pairs, the classes that have some and where each begins; the end of all follows."""
    k = ((m >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(m) else np.zeros(0, np.int64)
    return k[first].astype(np.int64), np.append(first, len(m))


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each slice of an array."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def whole(parts: list[pa.Scalar], kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(p.as_buffer(), kind) for p in parts])


def in_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[pa.Scalar]]]:
    """From rows ordered by their first column, the other columns of each class, one list for each column."""
    last, held = None, []
    for batch in batches:
        for k, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if k != last and held:
                yield [list(c) for c in zip(*held)]
                held = []
            last = k
            held.append(row)
    if held:
        yield [list(c) for c in zip(*held)]
