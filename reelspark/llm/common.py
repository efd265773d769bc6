"""Helpers that the training-data operators share: tables, batches, hashing and array kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.stages import delete, stage_path, stored, stored_at

__all__ = ["ASCII_SPACE", "by_batch", "delete", "kasai", "mix64", "pieces", "stage_path", "stored", "stored_at", "suffix_ranks", "table"]
#: The characters that separate words: space, tab, newline, vertical tab, form feed, carriage return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, limit: int = 8 << 20) -> DataFrame:
    """Applies ``make`` to Arrow batches that are cut so that strings and binaries of one call stay near ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit):
            out = make(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(limit, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64 arrays."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xD1342543DE82EF95) + MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def suffix_ranks(first: np.ndarray, end: np.ndarray, have: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and inverse by Larsson-Sadakane doubling over many sequences laid end to end.

    first: rank of each position by its next ``have`` symbols; end: for each position the place of its sequence's
    terminator, whose ``first`` is unique. Only groups that are still tied are sorted again, by the rank ``have``
    symbols further on, and ``have`` doubles each round."""
    n = len(first)
    order = np.argsort(first)
    sorted_first = first[order]
    head = np.r_[True, sorted_first[1:] != sorted_first[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = start
    size = np.diff(np.r_[np.flatnonzero(head), n])
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied):
        at = order[tied]
        key = (rank[at] << 32) | rank[np.minimum(at + have, end[at])]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        heads = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = heads
        size = np.diff(np.r_[np.flatnonzero(fresh), len(tied)])
        tied = tied[np.repeat(size > 1, size)]
        have *= 2
    return order, rank


def kasai(symbols: np.ndarray, order: np.ndarray, end: np.ndarray, cap: int = 1 << 30, lanes: int = 4096, wide: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix with the one before it in suffix order, by Kasai's scan in text order.

    The scan runs in lanes side by side: each lane walks its own stretch of the text and carries the last length
    less one, which is Kasai's bound. Lengths stop at sequence ends and at ``cap``. ``wide``: for byte texts, the eight
    bytes at each position as one number, which are then compared at once. Indexed by text position."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lanes = max(1, min(lanes, n // 64))
    width = -(-n // lanes)
    carry = np.zeros(lanes, np.int64)
    starts = np.arange(lanes) * width
    for step in range(width):
        i = starts + step
        live = np.flatnonzero(i < n)
        i = i[live]
        j = before[i]
        h = np.where(j >= 0, np.maximum(carry[live] - 1, 0), 0)
        room = np.minimum(np.minimum(end[i] - i, np.where(j >= 0, end[j] - j, 0)), cap)
        h = np.minimum(h, room)
        going = np.flatnonzero(h < room)
        while len(going):
            if wide is None:
                going = going[symbols[i[going] + h[going]] == symbols[j[going] + h[going]]]
                h[going] += 1
            else:
                x = wide[i[going] + h[going]] ^ wide[j[going] + h[going]]
                other = x != 0
                x = x[other]
                h[going[other]] += (np.log2((x & (~x + np.uint64(1))).astype(float)) / 8).astype(np.int64)
                going = going[~other]
                h[going] += 8
            going = going[h[going] < room[going]]
        h = np.minimum(h, room)
        carry[live] = h
        out[i] = h
    return out
