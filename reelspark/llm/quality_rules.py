"""Op 5, quality rules: counts of words, symbols and lines, and repeated substrings by suffix arrays over words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ASCII_SPACE, by_batch, kasai, suffix_ranks, table

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_covered_words long, longest_repeat long, kept boolean"
)


def repeat_lengths(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word position, the longest run of words from there that also starts elsewhere in the same document.

    ids: word ids; first: rank of (document, word), so that suffixes of different documents never tie; end: index of
    the document's terminator. It is the larger of the common prefixes with both neighbours in suffix order."""
    order, _ = suffix_ranks(first, end, 1)
    ahead = kasai(ids, order, end)
    best = ahead.copy()
    by_rank = ahead[order]
    best[order[:-1]] = np.maximum(best[order[:-1]], by_rank[1:])
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span (start, length)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[bytes], least: int, fraction: float, longest: int) -> list[np.ndarray]:
    """The columns of SCHEMA after doc_id, for whole texts as UTF-8."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    spaces = [len(t) - len(t.translate(None, ASCII_SPACE)) for t in texts]
    chars = np.array([len(t.decode(errors="replace")) for t in texts], np.int64) - np.array(spaces, np.int64)
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    dup_lines = np.array([len(x) - len(set(x)) for x in lines], np.int64)

    # all documents end to end, each with a terminator of its own
    size = n + 1
    stop = np.cumsum(size) - 1
    flat = np.empty(int(size.sum()), object)
    flat[np.setdiff1d(np.arange(len(flat)), stop, assume_unique=True)] = [w for ws in words for w in ws]
    flat[stop] = b""
    ids = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    end = stop[doc]
    first = doc * (int(ids.max(initial=0)) + 2) + ids + 1
    first[stop] = doc[stop] * (int(ids.max(initial=0)) + 2)
    best = repeat_lengths(ids, first, end)
    best[stop] = 0

    def words_in(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.bincount(doc[covered(at, length, len(flat))], minlength=len(texts)).astype(np.int64)

    triple = np.flatnonzero(best >= 3)
    repeat_words = words_in(triple, np.full(len(triple), 3))
    long_ = np.flatnonzero(best >= least)
    spans = words_in(long_, best[long_])
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, best)
    failed = (n < 50) | (100 * repeat_words > 50 * n)
    kept = ~failed & (spans <= fraction * n) & (most <= longest)
    return [n, chars, symbols, dup_lines, repeat_words, failed, spans, most, kept]


def quality_rules(docs: DataFrame, least: int = 8, fraction: float = 0.3, longest: int = 150) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), with the columns of SCHEMA; n_covered_words counts the words in the union of all maximal
    repeats of ``least`` words or more, longest_repeat is the longest repeat in words (overlaps count).

    kept: not base_failed, at most ``fraction`` of the words covered and no repeat over ``longest`` words. Every maximal
    repeat is an interval of the suffix array's common prefixes; the span from a position to its longest common prefix
    with a neighbour is the largest of the intervals that hold it, so the union of these spans is that of all intervals.
    Null and empty texts have no words and fail; null ids and repeated rows stay, each judged alone; an empty table gives
    no rows. Documents are judged where they lie: nothing is shuffled, memory goes with a batch of a few MB or the
    longest text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        columns = measure(texts, least, fraction, longest)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names)

    return by_batch(docs.select("doc_id", "text"), run, SCHEMA, limit=2 << 20)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def _repeated(k: int) -> str:
    """Starts of k-word windows that are in their document twice or more."""
    return f"SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, hash(w[i:i + {k - 1}])) AS n FROM p WHERE i + {k - 1} <= len(w)) WHERE n > 1"


# a word is in a repeat of 8 words or more where it is in a repeated window of 8, and a repeat of over 150 words has one of 151
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
triples AS (SELECT r, count(DISTINCT i + j) AS n FROM ({_repeated(3)}), range(3) AS x(j) GROUP BY r),
eights AS (SELECT r, count(DISTINCT i + j) AS n FROM ({_repeated(8)}), range(8) AS x(j) GROUP BY r),
long AS (SELECT DISTINCT r FROM ({_repeated(151)})),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
facts AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(triples.n, 0)::BIGINT AS n_repeat_words, coalesce(eights.n, 0)::BIGINT AS n_covered_words, long.r IS NOT NULL AS too_long
  FROM d LEFT JOIN triples USING (r) LEFT JOIN eights USING (r) LEFT JOIN long USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, n_covered_words,
  NOT base_failed AND n_covered_words <= 0.3 * n_words AND NOT too_long AS kept FROM judged
"""
