"""Op 8, packing: documents as token ids in sequences of a fixed length, by the online sum-of-squares rule."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table

#: Texts of other characters go through ``tokenizers`` itself, whose tables of letters and digits could differ there.
COMMON = re.compile(r"[\x00-ɏ‐-›€]*")
LOADED: dict[str, tuple] = {}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed string"
#: Documents that one task packs at least, where there are so many: few windows stay open among many documents.
GROUP = 8_000


def encoders(vocabulary: str, ranks: str) -> tuple[tokenizers.Tokenizer, tiktoken.Encoding]:
    """The tokenizer, and the same vocabulary as ranks, which is four times as fast; loaded once in each worker."""
    if vocabulary not in LOADED:
        exact = tokenizers.Tokenizer.from_file(vocabulary)
        exact.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        LOADED[vocabulary] = exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return LOADED[vocabulary]


def token_ids(text: str | None, vocabulary: str, ranks: str, last: int) -> np.ndarray:
    """uint32 ids of one whole text and the end id; null: the end id alone."""
    exact, fast = encoders(vocabulary, ranks)
    if not text:
        ids = []
    elif COMMON.fullmatch(text):
        ids = fast.encode_ordinary(text)
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    ids.append(last)
    return np.array(ids, "<u4")


class SumOfSquares:
    """The level array of partially filled windows. ``place`` puts an item where the sum of squared level counts grows
    least; a window that is within ``slack`` of ``size`` is full."""

    def __init__(self, size: int, slack: int = 0):
        self.size, self.full = size, size - slack
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, level it had) for an item of under ``size`` tokens; of equal levels the fullest."""
        counts, size = self.counts, self.size
        level = 0
        if length < self.full:
            have = np.flatnonzero(counts[1 : size - length + 1]) + 1
            # moving a window from level h to h + length changes the sum of squares by 2 (N[h + length] - N[h] + 1), or by
            # 1 - 2 N[h] where it becomes full; a new window changes it by 2 N[length] + 1
            change = np.where(have + length < self.full, 2 * (counts[have + length] - counts[have] + 1), 1 - 2 * counts[have])
            if len(have):
                best = len(have) - 1 - int(np.argmin(change[::-1]))
                if change[best] <= 2 * counts[length] + 1:
                    level = int(have[best])
        window = self.open[level].pop() if level else self.new()
        if level:
            counts[level] -= 1
        if level + length < self.full:
            counts[level + length] += 1
            self.open[level + length].append(window)
        return window, level


def packed(docs: Iterator[tuple[int | None, np.ndarray]], size: int, base: int, slack: int) -> Iterator[tuple]:
    """Rows of (doc_id, start, length, crc32, doc_tokens, sequence, offset, placed) for one partition's documents, in order."""
    level = SumOfSquares(size, slack)
    waiting: dict[int, list[tuple]] = {}

    def row(piece: tuple, window: int, offset: int, placed: str) -> tuple:
        doc_id, start, ids, total = piece
        return doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + window, offset, placed

    def closed(held: list[tuple], window: int) -> Iterator[tuple]:
        offset = 0
        for piece in held:
            yield row(piece, window, offset, "squares")
            offset += len(piece[2])

    for doc_id, ids in docs:
        total = len(ids)
        whole = total - total % size
        for start in range(0, whole, size):
            yield row((doc_id, start, ids[start : start + size], total), level.new(), 0, "whole")
        if whole < total:
            window, at = level.place(total - whole)
            waiting.setdefault(window, []).append((doc_id, whole, ids[whole:], total))
            if at + total - whole >= level.full:
                yield from closed(waiting.pop(window), window)
    # what is still open is cut freely: full windows, and at the end powers of two, which need no padding
    ends: list[list[tuple]] = []
    for held in waiting.values():
        fill = sum(len(p[2]) for p in held)
        if fill & (fill - 1) == 0:
            yield from closed(held, level.new())
        else:
            ends.append(held)
    ends.sort(key=lambda held: -sum(len(p[2]) for p in held))
    left = sum(len(p[2]) for held in ends for p in held)
    room, window, offset = 0, -1, 0
    for held in ends:
        for doc_id, start, ids, total in held:
            while len(ids):
                if not room:
                    room, window, offset = (size if left >= size else 1 << (left.bit_length() - 1)), level.new(), 0
                cut = ids[:room]
                yield row((doc_id, start, cut, total), window, offset, "cut")
                start, offset, room, left, ids = start + len(cut), offset + len(cut), room - len(cut), left - len(cut), ids[room:]


def pack(docs: DataFrame, size: int = 2048, vocabulary: str | None = None, ranks: str | None = None, last: int = 1, slack: int | None = None, group: int = GROUP) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed.

    docs: doc_id, text (other columns are ignored). Null and empty texts are one token, the end id. Repeated rows and
    null ids are documents of their own; an empty table gives no rows. Texts of any length are cut at multiples of
    ``size`` (placed: whole); the rest goes where the sum of squared counts of partially filled windows grows least
    (squares). A window that lacks at most ``slack`` tokens (a hundredth of ``size``) is closed and padded. Each input
    partition packs its own documents in one pass, so nothing is shuffled and a lost task is run again with the same
    result; partitions are joined until there are ``group`` documents to each, for which the rows are counted first.
    Sequence ids hold the partition's number in the high bits. At a partition's end, windows that are still open are
    refilled by cutting (cut), and a last rest under ``size`` goes into sequences of powers of two, which need no padding.

    vocabulary, ranks: paths of the tokenizer's file and of its ranks; the paths must be readable on all executors."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    slack = size // 100 if slack is None else slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def each() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in pieces(batches, 4 << 20):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc_id, token_ids(text.as_py(), vocabulary, ranks, last)

        for found in packed(each(), size, base, slack):
            rows.append(found)
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows_ = docs.select("doc_id", "text")
    return rows_.coalesce(max(1, rows_.count() // group)).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
