"""Op 7, suffix-array dedup: removes every byte of a 400-byte string that also starts anywhere else.

A suffix array over all bytes is not needed, and not payable, where nothing repeats. So three steps, each exact:

1. Every 400-byte string is owned by its anchor, the 32-byte string in it with the smallest hash (the first of equals).
   Equal strings have equal anchors at equal places. Start positions with one anchor form a run; a run's content is the
   text from its first start to the end of its last string. Anchors seen once have nothing that repeats; runs whose whole
   content is seen twice repeat throughout. What remains are different contents about one anchor.
2. These are dealt into shards by anchor. Each shard sorts its suffixes (Larsson-Sadakane in numpy) and takes common
   prefixes by Kasai; a start whose neighbour in suffix order shares 400 bytes is a repeat.
3. Anchors with very many contents are split over shards. Such shards also give their distinct strings as sorted
   fingerprints, in ranges; each range is merged across shards by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_batch, delete, kasai, mix64, pieces, stored, stored_at, suffix_ranks, table

ANCHOR = 32
#: Bytes of text that are hashed at a time; longer texts are taken in overlapping parts of it.
PART = 1 << 20
PLACE = np.uint64((1 << 22) - 1)
#: Contents of one anchor that one shard takes, and bytes that a shard holds, about.
SPLIT, SHARD = 512, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE = mix64(np.arange(256, dtype=np.uint64), 11)
POWERS: list[np.ndarray] = []
RUNS = "doc_id long, digest long, anchor long, run long, first long, n int, times int"
RANGES = "array<struct<at:int,n:int>>"
RANGE_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
#: Columns of what shards return.
NAMES = ["anchor", "run", "ranges", "bucket", "shard", "prints", "runs", "places"]
KINDS = (pa.int64(), pa.int64(), RANGE_TYPE, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


class Hashes:
    """Hashes of any substring of a buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        if not POWERS or len(POWERS[0]) < n + 1:
            size = max(n + 1, PART * 2)
            POWERS[:] = [np.r_[np.uint64(1), np.cumprod(np.full(size, b, np.uint64))] for b in (BASE, UNBASE)]
        self.sums = np.r_[np.uint64(0), np.cumsum(BYTE[buffer] * POWERS[0][:n])]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * POWERS[1][start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * POWERS[1][:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def run_hash(content: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Of a run's content, number of starts and distance from first start to anchor."""
    return mix64(content ^ (n.astype(np.uint64) << np.uint64(32)) ^ back.astype(np.uint64), 5)


def find_runs(parts: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(part, anchor hash, run hash, first start in the text, starts, times in a row) of all runs; parts: (row, place in its text, bytes)."""
    buffer = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    size = np.array([len(p[2]) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    hashes = Hashes(buffer)
    grams = hashes.all(ANCHOR)
    low = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), length - ANCHOR + 1)
    count = np.maximum(size - length + 1, 0)
    part = np.repeat(np.arange(len(parts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[part]
    owner = (low[start] & PLACE).astype(np.int64)
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]) if len(start) else np.zeros(0, np.int64)
    n = np.diff(np.r_[at, len(start)])
    first, anchor, part = start[at], owner[at], part[at]
    content = hashes.of(first, first + n - 1 + length)
    place = np.array([p[1] for p in parts], np.int64)
    run = run_hash(content, n, anchor - first)
    # a periodic stretch is the same run again and again: one row that says how many times
    same = (part[1:] == part[:-1]) & (run[1:] == run[:-1]) & (grams[anchor[1:]] == grams[anchor[:-1]]) & (first[1:] == first[:-1] + n[:-1])
    at = np.flatnonzero(np.r_[True, ~same]) if len(run) else np.zeros(0, np.int64)
    times = np.diff(np.r_[at, len(run)])
    part, anchor, run, first, n = part[at], anchor[at], run[at], first[at], n[at]
    return part, grams[anchor], run, first - begin[part] + place[part], n, times


def runs_of(docs: DataFrame, length: int) -> DataFrame:
    """RUNS of all rows of (doc_id, digest, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        for batch in pieces(batches, PART):
            for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode(errors="surrogatepass")
                for place in range(0, len(raw) - length + 1, PART):
                    yield doc_id, digest, place, raw[place : place + PART + length - 1]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        part, anchor, run, first, n, times = find_runs([(0, p, raw) for _, _, p, raw in held], length)
        ids, digests = (pa.array([h[i] for h in held], pa.int64()).take(pa.array(part)) for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [ids, digests, pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(first), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32))],
            ["doc_id", "digest", "anchor", "run", "first", "n", "times"],
        )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in cut(batches):
            held.append(part)
            size += len(part[3])
            if size >= PART:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(go, RUNS)


def contents_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """shard, anchor, run, split, content: the bytes of each wanted run, from the document that has it."""
    lists = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("first", "n", "anchor", "run", "shard", "split")).alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("digest").alias("hash"), "text")
    both = lists.join(texts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("digest"))).select("text", "wanted")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode(errors="surrogatepass")
            out += [(w["shard"], w["anchor"], w["run"], w["split"], raw[w["first"] : w["first"] + w["n"] + length - 1]) for w in want]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
            ["shard", "anchor", "run", "split", "content"],
        )

    return by_batch(both, cut, "shard long, anchor long, run long, split boolean, content binary", 4 << 20)


def shard_repeats(contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all starts of strings of ``length`` in the contents: (content, place in it, is a repeat, place in the buffer), and
    repeats are found by suffix array and common prefixes; the order is that of the suffix array."""
    pad = 8
    size = np.array([len(c) for c in contents], np.int64)
    buffer = np.frombuffer(b"".join(c + bytes(pad) for c in contents), np.uint8)
    stop = np.cumsum(size + pad)
    begin = stop - size - pad
    of = np.repeat(np.arange(len(contents)), size + pad)
    end = (begin + size)[of]
    symbols = buffer.astype(np.int64) + 1
    place = np.arange(len(buffer))
    padding = place >= end
    symbols[padding] = 0
    first = np.zeros(len(buffer), np.int64)
    for i in range(7):
        first[: len(buffer) - i] |= symbols[i:] << (9 * (6 - i))
    first[padding] = -1 - place[padding]
    order, _ = suffix_ranks(first, np.where(padding, place, end), 7)
    wide = np.lib.stride_tricks.sliding_window_view(np.r_[buffer, np.zeros(7, np.uint8)], 8).copy().view("<u8").ravel()
    ahead = kasai(buffer, order, np.where(padding, place, end), cap=length, wide=wide)[order]
    again = (ahead >= length) | (np.r_[ahead[1:], 0] >= length)
    whole = end[order] - order >= length
    at = order[whole]
    return of[at], at - begin[of[at]], again[whole], at


def may_repeat(contents: list[bytes], anchors: np.ndarray, length: int) -> np.ndarray:
    """Which contents can share a string of ``length`` with another one of their anchor. The string holds the anchor, and half
    of the rest lies before or after it; so the other content has the same anchor with the same half before, or after."""
    half = (length - ANCHOR) // 2
    size = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(size) - size
    hashes = Hashes(np.frombuffer(b"".join(contents), np.uint8))
    of = np.repeat(np.arange(len(contents)), size)
    grams = hashes.all(ANCHOR)
    hits = np.flatnonzero(grams == anchors.view(np.uint64)[of[: len(grams)]])
    found, first = np.unique(of[hits], return_index=True)
    keep = np.ones(len(contents), bool)
    at, begin, stop = hits[first], begin[found], (begin + size)[found]
    keep[found] = False
    for low, high, whole in ((at - half, at + ANCHOR, at - half >= begin), (at, at + ANCHOR + half, at + ANCHOR + half <= stop)):
        prints = hashes.of(np.where(whole, low, at), np.where(whole, high, at))
        _, which = np.unique(prints, return_inverse=True)
        times = np.bincount(which[whole], minlength=which.max(initial=-1) + 1)
        keep[found] |= whole & (times[which] > 1)
    return keep


def ranges(places: np.ndarray) -> list[dict[str, int]]:
    places = np.unique(places)
    at = np.flatnonzero(np.r_[True, np.diff(places) > 1]) if len(places) else np.zeros(0, np.int64)
    return [{"at": int(a), "n": int(n)} for a, n in zip(places[at], np.diff(np.r_[at, len(places)]))]


def by_content(of: np.ndarray, places: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(keys) + 1))
    for i in range(len(keys)):
        if cuts[i] < cuts[i + 1]:
            yield i, places[order[cuts[i] : cuts[i + 1]]]


def repeats_in_shards(contents: DataFrame, length: int, buckets: int) -> DataFrame:
    """anchor, run, ranges (of starts that repeat) and, for shards of split anchors, rows of bucket, prints, runs,
    places, where a bucket is a range of fingerprints and prints are sorted."""
    schema = f"anchor long, run long, ranges {RANGES}, bucket long, shard long, prints binary, runs binary, places binary"

    def go(shard: pa.Table) -> pa.Table:
        rows = sorted(set(zip(*(shard.column(c).to_pylist() for c in ("anchor", "run", "split", "content")))))
        # a split anchor's contents may have their like in another shard
        keep = may_repeat([r[3] for r in rows], np.array([r[0] for r in rows], np.int64), length)
        rows = [r for r, k in zip(rows, keep) if k or r[2]]
        if not rows:
            return pa.table([pa.array([], k) for k in KINDS], NAMES)
        of, places, again, at = shard_repeats([r[3] for r in rows], length)
        out = [(rows[i][0], rows[i][1], ranges(p), None, None, None, None, None) for i, p in by_content(of[again], places[again], np.arange(len(rows)))]
        split = np.array([r[2] for r in rows], bool)
        if split.any():
            # one place of each distinct string that the shard did not already find twice
            single = ~again & split[of]
            where = at[single]
            hashes = Hashes(np.frombuffer(b"".join(r[3] + bytes(8) for r in rows), np.uint8))
            prints = hashes.of(where, where + length)
            # repeats inside the shard still have to meet their like in others: one print a string, without a place
            twice = np.unique(hashes.of(at[again & split[of]], at[again & split[of]] + length)) if (again & split[of]).any() else np.zeros(0, np.uint64)
            runs = np.r_[np.array([r[1] for r in rows], np.int64)[of[single]], np.zeros(len(twice), np.int64)]
            spots = np.r_[places[single], np.full(len(twice), -1)].astype(np.int32)
            anchors = np.r_[np.array([r[0] for r in rows], np.int64)[of[single]], np.zeros(len(twice), np.int64)]
            prints = np.r_[prints, twice]
            by = np.argsort(prints)
            prints, runs, spots, anchors = prints[by], runs[by], spots[by], anchors[by]
            bucket = (prints >> np.uint64(33)).astype(np.int64) * buckets >> 31
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                both = np.stack([anchors[a:b], runs[a:b]], axis=1)
                out.append((None, None, None, int(bucket[a]), shard.column("shard")[0].as_py(), prints[a:b].tobytes(), both.tobytes(), spots[a:b].tobytes()))
        columns = list(zip(*out)) or [[]] * len(KINDS)
        return pa.table([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)

    return contents.groupBy("shard").applyInArrow(go, schema)


def merged(prints: DataFrame) -> DataFrame:
    """anchor, run, ranges from rows of one bucket: a print that binary search finds in the sorted prints of another shard is a repeat."""

    def go(bucket: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in bucket.column("prints").to_pylist()]
        runs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in bucket.column("runs").to_pylist()])
        places = np.concatenate([np.frombuffer(x, np.int32) for x in bucket.column("places").to_pylist()])
        everything = np.sort(np.concatenate(lists))
        again = np.concatenate([np.searchsorted(everything, x, "right") - np.searchsorted(everything, x, "left") > 1 for x in lists])
        again &= places >= 0
        found = np.unique(runs[again], axis=0)
        key = {tuple(x): i for i, x in enumerate(found.tolist())}
        of = np.array([key[tuple(x)] for x in runs[again].tolist()], np.int64)
        out = [(int(found[i, 0]), int(found[i, 1]), ranges(p)) for i, p in by_content(of, places[again], np.arange(len(found)))]
        columns = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), RANGE_TYPE))], ["anchor", "run", "ranges"])

    return prints.select("bucket", "prints", "runs", "places").groupBy("bucket").applyInArrow(go, f"anchor long, run long, ranges {RANGES}")


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, spans (at, n: start and number of starts of strings that repeat) of all rows that have any."""
    runs = stored(runs_of(docs, length), "runs")
    kinds = runs.groupBy("anchor", "run", "n").agg(F.sum("times").alias("copies"), F.min(F.struct("doc_id", "digest", "first")).alias("of"))
    kinds, kinds_at = stored_at(kinds, "kinds")
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(F.col("copies")).alias("most"), F.min("copies").alias("least"))
    seen = kinds.join(anchors.where("kinds > 1 or most > 1"), "anchor")
    seen, seen_at = stored_at(seen, "seen")
    delete(docs.sparkSession, kinds_at)
    open_ = (F.col("kinds") > 1) & (F.col("least") == 1)
    total = seen.where(open_).agg(F.sum(F.col("n") + length).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-total // SHARD))
    parts = F.ceil(F.col("kinds") / SPLIT).cast("long")
    wanted = seen.where(open_).select(
        F.col("of.doc_id").alias("doc_id"), F.col("of.digest").alias("digest"), F.col("of.first").alias("first"), "n", "anchor", "run", (F.col("kinds") > SPLIT).alias("split"),
        F.pmod(F.xxhash64("anchor", F.pmod(F.col("run"), parts)), F.lit(shards)).alias("shard"),
    )
    found, found_at = stored_at(repeats_in_shards(contents_of(docs, wanted, length), length, buckets=max(1, shards)), "repeats")
    across = merged(found.where("bucket is not null"))
    ranges_ = found.where("bucket is null").select("anchor", "run", "ranges").unionByName(across)
    full = seen.where("copies > 1").select("anchor", "run", F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("n"))).alias("ranges"))
    # a run that repeats as a whole needs no part of it
    every = ranges_.unionByName(full).groupBy("anchor", "run").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    # stored, so that the join below starts from plain exchanges and a run with very many copies can be split
    every = stored(every, "ranges")
    delete(docs.sparkSession, seen_at)
    delete(docs.sparkSession, found_at)
    stretch = F.array(F.struct(F.col("first").alias("at"), (F.col("n") * F.col("times")).alias("n")))
    spans = runs.join(every, ["anchor", "run"]).select(
        "doc_id", "digest", F.when(F.col("times") > 1, stretch).otherwise(F.transform("ranges", lambda r: F.struct((F.col("first") + r["at"]).alias("at"), r["n"].alias("n")))).alias("spans")
    )
    return spans.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 400, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text without its repeats, n_bytes, n_removed, n_spans,
    kept_sha256 and, where ``carry``, ``row``, a struct of the columns of ``docs`` besides doc_id and text.

    Each byte goes that a string of ``length`` bytes covers which also starts anywhere else in any text, the same one
    included; strings are judged on the input. Where a cut leaves part of a character, its bytes stay in the digest and
    are dropped from the text. Null texts are empty, texts under ``length`` bytes stay whole, repeated rows repeat each
    other, rows with a null id are like others, an empty table gives no rows. Rows with one doc_id and different texts
    are kept apart by a hash of the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if carry and rest else F.struct(F.lit(0).alias("none"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text", row.alias("row"))
    spans = repeated_ranges(rows.select("doc_id", "digest", "text"), length)
    spans = spans.select(F.col("doc_id").alias("id"), F.col("digest").alias("hash"), "spans")
    columns = ["doc_id", "text", "spans", "row"] if carry else ["doc_id", "text", "spans"]
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("hash")), "left").select(*columns)
    schema = StructType.fromDDL("doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if carry:
        schema = schema.add("row", both.schema["row"].dataType)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, facts = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode(errors="surrogatepass")
            kept, removed, n, last = [], 0, 0, 0
            for at, stop in union((s["at"], s["at"] + s["n"] - 1 + length) for s in spans or ()):
                kept.append(raw[last:at])
                removed, n, last = removed + stop - at, n + 1, stop
            rest = b"".join([*kept, raw[last:]])
            texts.append(rest.decode(errors="ignore"))
            facts.append((len(raw), removed, n, hashlib.sha256(rest).hexdigest()))
        columns = [batch.column(0), pa.array(texts, pa.string()), *(pa.array(c) for c in zip(*facts)), *batch.columns[3:]]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return by_batch(both, cut, schema, 4 << 20)


def union(spans: Iterator[tuple[int, int]]) -> list[list[int]]:
    """Disjoint spans in order; overlapping and touching ones become one."""
    out: list[list[int]] = []
    for at, stop in sorted(spans):
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([at, stop])
    return out


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("text")


SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, i, hash(substring(h, 2 * i + 1, 800)) AS g FROM (SELECT r, h, unnest(range(length(h) // 2 - 399)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM starts) WHERE n > 1),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY r, k),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
