"""Op 6, n-gram Jaccard join: prefix filters under several token orders, exact verification, connected components.

A document's set is its distinct five-word shingles, as 64-bit hashes; equal sets are one class. Two sets of Jaccard
similarity t or more share a token among the first ``n - ceil(t n) + 1`` tokens of each under every order of the tokens.

1. The first order puts rare tokens first. It goes by a token's level (a range of its hash), in it by the number of classes
   that have it, then by hash; tokens that a bounded sample shows to be very common come last. So a document need only
   send the tokens of as many levels as its prefix can reach, and tokens that no other class has need no partner.
2. Classes that share a prefix token are candidates. Each token's smallest class leads it, and the classes of all tokens
   that one class leads are a unit: every pair of candidates is in a unit, and a class is in few of them.
3. A unit is verified where its sets are together. There, candidates must share prefix tokens under further orders too;
   the filters are intersected before the sets are. First each class takes part in one unit alone. Units that
   then still hold different components are verified whole, where only classes outside the unit's largest component are
   compared with the rest. Units over a size are dealt in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, delete, mix64, pieces, stage_path, stored, table

WORDS = 5
#: Similarity as a fraction, so that bounds are exact: 80 / 100.
PART, WHOLE = 80, 100
LEVELS = np.array([0.3, 0.6]) * 2.0**64
#: Documents in the sample for very common tokens, about, and in how many of them a token must be. Any choice gives the same links.
SAMPLE, COMMON = 4_000, 8
#: Bytes of text whose tokens a task sends at a time, and of sets that one verification holds.
FLUSH, BLOCK = 16 << 20, 8 << 20
MULTIPLIERS = mix64(np.arange(WORDS, dtype=np.uint64), 21) | np.uint64(1)


class WordHashes(dict):
    """Word -> position in ``table``, which has a 64-bit hash for each word; starts anew when it is large."""

    def __init__(self):
        self.table = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.r_[self.table, np.zeros(at, np.uint64)]
        self.table[at] = xxhash.xxh3_64_intdigest(word)
        self[word] = at
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[at]


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles. A to Z are lower-cased, words are what ASCII white space separates."""
    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < WORDS:
        return mix64((h * MULTIPLIERS[: len(h)]).sum(keepdims=True, dtype=np.uint64), 100 + len(words))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += h[i : n + i] * MULTIPLIERS[i]
    return np.unique(mix64(total, 22))


def prefix_length(n: int) -> int:
    return n - -(-n * PART // WHOLE) + 1


def class_of(tokens: np.ndarray) -> int:
    """The 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))) if len(tokens) else 0


def reach(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(tokens to send, common tokens in the prefix, tokens sent of each level)."""
    need = prefix_length(len(tokens))
    usual = tokens[~np.isin(tokens, common, assume_unique=True)] if len(common) else tokens
    level = np.searchsorted(LEVELS, mix64(usual, 31).astype(float), "right")
    counts = np.bincount(level, minlength=3)
    last = int(np.searchsorted(np.cumsum(counts), need))
    rest = np.zeros(0, np.uint64)
    if last > 2:
        others = tokens[np.isin(tokens, common, assume_unique=True)]
        rest = others[np.argsort(mix64(others, 32))[: need - len(usual)]]
    return usual[level <= last], rest, [int(c) if i <= last else 0 for i, c in enumerate(counts)]


def common_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens that at least COMMON documents of a sample by hash of about SAMPLE documents have; at most a few hundred thousand."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).limit(4 * SAMPLE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            sets = [shingles(t, hashes) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k", "s"])

    def count(rows: pa.Table) -> pa.Table:
        everything = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]))
        at = np.flatnonzero(np.r_[True, everything[1:] != everything[:-1]]) if len(everything) else np.zeros(0, np.int64)
        often = np.diff(np.r_[at, len(everything)]) >= COMMON
        return pa.table({"tokens": pa.array([everything[at[often]].tobytes()], pa.binary())})

    found = some.select("text").mapInArrow(send, "k int, s binary").groupBy("k").applyInArrow(count, "tokens binary").collect()
    return np.frombuffer(found[0]["tokens"], np.uint64) if found else np.zeros(0, np.uint64)


def sent_tokens(docs: DataFrame, common: np.ndarray, spread: int) -> DataFrame:
    """Two kinds of rows from one pass: for each document doc_id, digest, cls, n, levels and common tokens of its prefix; for each
    range of tokens and FLUSH bytes of text: range, tokens (sorted), owners (classes, by token)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = "doc_id long, digest long, cls long, n long, levels array<int>, common binary, range long, tokens binary, owners binary"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = WordHashes(), shared.value
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            classes = np.fromiter(held, np.int64, len(held))
            tokens = np.concatenate(list(held.values()))
            owners = np.repeat(classes, [len(x) for x in held.values()])
            by = np.argsort(tokens)
            tokens, owners = tokens[by], owners[by]
            ranges = ((tokens >> np.uint64(33)).astype(np.int64) * spread) >> 31
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]).tolist() if len(tokens) else []
            rows = [(None,) * 6 + (int(ranges[a]), tokens[a:b].tobytes(), owners[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(tokens)])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names)

        for batch in pieces(batches, 2 << 20):
            rows = []
            for doc_id, text, digest in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = shingles(text, hashes)
                cls = class_of(tokens)
                out, rest, levels = reach(tokens, often) if len(tokens) else (tokens, tokens, [0, 0, 0])
                rows.append((doc_id, digest, cls, len(tokens), levels, rest.tobytes(), None, None, None))
                if len(out) and cls not in held:
                    held[cls] = out
                    size += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            if size >= FLUSH:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")).mapInArrow(go, schema)


def shared_tokens(sent: DataFrame) -> DataFrame:
    """cls, tokens, counts: for each class and range, its tokens that two classes or more have, and how many have them."""

    def go(rows: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()])
        owners = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("owners").to_pylist()])
        by = np.argsort(tokens)
        tokens, owners = tokens[by], owners[by]
        twice = np.r_[False, tokens[1:] == tokens[:-1]] | np.r_[tokens[1:] == tokens[:-1], False]
        tokens, owners = tokens[twice], owners[twice]
        by = np.lexsort((owners, tokens))
        tokens, owners = tokens[by], owners[by]
        fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])] if len(tokens) else np.zeros(0, bool)
        tokens, owners = tokens[fresh], owners[fresh]
        _, group, count = np.unique(tokens, return_inverse=True, return_counts=True)
        count = count[group] if len(tokens) else np.zeros(0, np.int64)
        more = count > 1
        tokens, owners, count = tokens[more], owners[more], count[more]
        by = np.argsort(owners, kind="stable")
        tokens, owners, count = tokens[by], owners[by], count[by].astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]).tolist() if len(owners) else []
        out = [(int(owners[a]), tokens[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(owners)])]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["cls", "tokens", "counts"])

    return sent.select("range", "tokens", "owners").groupBy("range").applyInArrow(go, "cls long, tokens binary, counts binary")


def prefix_tokens(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """token, cls: the tokens of each class's prefix under the first order that another class has too."""
    lists = shared.groupBy("cls").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("counts").alias("counts"))
    rows = classes.join(lists, "cls", "left").select("cls", "n", "levels", "common", "tokens", "counts")

    def go(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, owners = [], []
        for cls, n, levels, common, tokens, counts in zip(*(c.to_pylist() for c in batch.columns)):
            need = prefix_length(n)
            mine = np.frombuffer(b"".join(tokens or ()), np.uint64)
            count = np.frombuffer(b"".join(counts or ()), np.int64)
            level = np.searchsorted(LEVELS, mix64(mine, 31).astype(float), "right")
            by = np.lexsort((mix64(mine, 32), count, level))
            mine, level = mine[by], level[by]
            # place in the order: what is in earlier levels, what nobody else has in this level, and what came before in it
            alone = np.array(levels) - np.bincount(level, minlength=3)
            place = np.arange(len(mine)) + np.cumsum(alone)[level]
            chosen = np.r_[mine[place < need], np.frombuffer(common, np.uint64)]
            out.append(chosen)
            owners.append(np.full(len(chosen), cls, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "cls"])

    return by_batch(rows, go, "token long, cls long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node of its component) of an undirected graph of edges (a, b), by large and small stars.

    Each round is stored in the shared folder; what reaches the driver is a count and a checksum. Hot nodes are reduced to
    their smallest neighbour before the shuffle, and the joins that follow can be split."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of the tokens that two sets or more have, and the number of columns."""
    tokens = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    more = count[column] > 1
    _, column = np.unique(column[more], return_inverse=True)
    return row[more], column, int(column.max(initial=-1)) + 1


def overlaps(row: np.ndarray, column: np.ndarray, columns: int, n: int, left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Common entries of the rows ``left`` with the rows ``right``, a strip of columns at a time."""
    total = np.zeros((len(left), len(right)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for at in range(0, columns, width):
        a, b = np.searchsorted(column, [at, at + width])
        strip = np.zeros((n, min(width, columns - at)), np.float32)
        strip[row[a:b], column[a:b] - at] = 1
        total += strip[left] @ strip[right].T
    return total


def pairs_by_token(row: np.ndarray, column: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of rows that share a column, once each; None where the columns hold more than ``limit`` pairs."""
    by = np.lexsort((row, column))
    row, column = row[by], column[by]
    at = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(column)])
    if (size * (size - 1) // 2).sum() > limit:
        return None
    place = np.arange(len(row)) - np.repeat(at, size)
    a = np.repeat(row, place)
    start = np.repeat(np.repeat(at, size), place)
    b = row[start + np.arange(len(a)) - np.repeat(np.cumsum(place) - place, place)]
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return both[0], both[1]


def common_count(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist())], np.int64)


def links(sets: list[np.ndarray], zero: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All similar pairs of different components, at least one of which is in ``zero`` (a mask).

    Pairs must share prefix tokens under three orders: rarest first in this unit with ties by one hash, the same with ties
    by another, and by a hash alone; what is left of all is verified by the size of the whole intersection. Where few
    pairs share a token they are listed by token, otherwise the filters are products of matrices."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    need = np.array([prefix_length(int(s)) for s in size])
    row, column, columns = matrix(sets)
    count = np.bincount(column, minlength=columns)
    alone = size - np.bincount(row, minlength=n)
    start = np.cumsum(np.r_[0, np.bincount(row, minlength=n)])[:-1]
    kept = []
    for seed in (41, 42):
        by = np.lexsort((mix64(np.arange(columns, dtype=np.uint64), seed)[column], count[column], row))
        rank = np.empty(len(row), np.int64)
        rank[by] = np.arange(len(row)) - start[row[by]]
        keep = rank + alone[row] < need[row]
        kept.append((row[keep], column[keep], columns))
    whole = np.concatenate(sets)
    of = np.repeat(np.arange(n), size)
    by = np.lexsort((mix64(whole, 43), of))
    rank = np.arange(len(by)) - np.cumsum(np.r_[0, size])[:-1][of[by]]
    keep = by[rank < need[of[by]]]
    _, at = np.unique(whole[keep], return_inverse=True)
    kept.append((of[keep], at, int(at.max(initial=-1)) + 1))

    def able(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        fits = WHOLE * np.minimum(size[x], size[y]) >= PART * np.maximum(size[x], size[y])
        return fits & (component[x] != component[y]) & (zero[x] | zero[y])

    listed = pairs_by_token(kept[0][0], kept[0][1], max(64, n * n // 16))
    if listed is not None:
        x, y = listed
        good = able(x, y)
        x, y = x[good], y[good]
        for r, c, _ in kept[1:]:
            by = np.lexsort((c, r))
            mine = np.split(c[by], np.cumsum(np.bincount(r, minlength=n))[:-1])
            good = common_count(mine, x, y) > 0 if len(x) else np.zeros(0, bool)
            x, y = x[good], y[good]
    else:
        left = np.flatnonzero(zero)
        found = []
        # strips of rows, so that the matrix of pairs stays small
        for a in range(0, len(left), 1024):
            strip = left[a : a + 1024]
            both = np.ones((len(strip), n), bool)
            for r, c, width in kept:
                both &= overlaps(r, c, width, n, strip, np.arange(n)) > 0
            i, j = np.nonzero(both)
            i = strip[i]
            good = able(i, j)
            found.append((i[good], j[good]))
        x, y = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(x) > max(2000, n * n // 100):
        common = np.empty(len(x), np.int64)
        by = np.argsort(x, kind="stable")
        for a in range(0, n, 1024):
            mine = by[slice(*np.searchsorted(x[by], [a, a + 1024]))]
            if len(mine):
                strip = np.arange(a, min(n, a + 1024))
                common[mine] = overlaps(row, column, columns, n, strip, np.arange(n))[x[mine] - a, y[mine]].astype(np.int64)
    else:
        common = common_count(sets, x, y)
    good = similar(common, size[x], size[y])
    return x[good], y[good]


def similar(common, a, b):
    return WHOLE * common >= PART * (a + b - common)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and edges (a, b) the smallest node of each one's component."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], low)
        np.minimum.at(new, up[b], low)
        new = new[new]
        if (new == up).all():
            return up
        up = new


def verified(sets: DataFrame, deals: DataFrame) -> DataFrame:
    """a, b (classes): edges that join the components of similar pairs, from rows of part, unit, side, cls, component and the
    sets of the classes (cls, tokens). Rows of side 0 are compared with all, those of side 1 not with each other; nor are rows of one component."""

    def go(rows: pa.Table) -> pa.Table:
        unit, cls, side, component = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("unit", "cls", "side", "component"))
        packed = rows.column("tokens")
        by = np.lexsort((side, cls, unit))
        cuts = np.flatnonzero(np.r_[True, np.diff(unit[by]) != 0]).tolist()
        out_a, out_b = [], []
        for a, b in zip(cuts, [*cuts[1:], len(by)]):
            mine = by[a:b]
            mine = mine[np.r_[True, np.diff(cls[mine]) != 0]]
            if len(mine) < 2 or (component[mine] == component[mine[0]]).all():
                continue
            sets = [np.frombuffer(packed[int(i)].as_py(), np.uint64) for i in mine]
            up = roots(len(mine), *links(sets, side[mine] == 0, component[mine]))
            linked = np.flatnonzero(up != np.arange(len(mine)))
            out_a.append(cls[mine[linked]])
            out_b.append(cls[mine[up[linked]]])
        return pa.table({"a": np.concatenate(out_a) if out_a else np.zeros(0, np.int64), "b": np.concatenate(out_b) if out_b else np.zeros(0, np.int64)})

    return deals.hint("merge").join(sets, "cls").groupBy("part").applyInArrow(go, "a long, b long")


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, cls, ...) with ``tokens``, the whole set, from the document they name."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rest = [c for c in wanted.columns if c != "doc_id"]
    # a merge join at every size: the texts are dealt once, and what is wanted may be large
    both = wanted.hint("merge").join(texts, F.col("id").eqNullSafe(F.col("doc_id"))).select("text", *rest)
    kinds = dict(wanted.dtypes)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, 2 << 20):
            sets = [shingles(t, hashes) for t in batch.column(0).to_pylist()]
            # rows with one doc_id may have other texts
            good = pa.array([class_of(s) == c for s, c in zip(sets, batch.column(batch.schema.get_field_index("cls")).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], [*rest, "tokens"]).filter(good)

    return both.mapInArrow(go, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", tokens binary")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, class_id, digest, component.

    Two documents link where 100 * intersection >= 80 * union of their sets of five-word shingles; a text of fewer words is
    one shingle; null and empty texts and texts without words have no set and link with nothing. component_id is the
    smallest doc_id that links reach, itself included; class_id names the set (equal sets, equal ids), digest
    is Spark's xxhash64 of the text, component names what is linked, also where ids repeat or are null; null without a set. Ids that are
    null count as larger than all others and stay null where nothing else is reached; repeated rows link with each other;
    an empty table gives no rows. Shingles and sets are told apart by 64-bit hashes."""
    spread = 16 * docs.select("text").rdd.getNumPartitions()
    spark = docs.sparkSession
    path = stage_path(spark, "tokens")
    sent = sent_tokens(docs, common_tokens(docs), spread).withColumn("kind", F.when(F.col("range").isNull(), "doc").otherwise("token"))
    sent.write.partitionBy("kind").parquet(path)
    whole = spark.read.schema(sent.schema).parquet(path)
    rows = whole.where("kind = 'doc'").select("doc_id", "digest", "cls", "n", "levels", "common")
    classes = stored(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("levels").alias("levels"), F.first("common").alias("common")), "classes")
    tokens = stored(prefix_tokens(classes, shared_tokens(whole.where("kind = 'token'"))), "prefixes")
    # all that is needed of the tokens is in the prefixes now
    delete(spark, f"{path}/kind=token")
    rows = spark.read.schema(whole.schema).parquet(path).where("kind = 'doc'").select(rows.columns)
    low = tokens.groupBy("token").agg(F.min("cls").alias("unit"), F.count("*").alias("k")).where("k > 1")
    led = stored(tokens.join(low.select("token", "unit"), "token").select("unit", "cls").distinct(), "led")
    sets = stored(class_sets(docs, classes.join(led.select("cls").distinct(), "cls", "left_semi").select("doc_id", "cls")), "sets")
    first = led.groupBy("cls").agg(F.min("unit").alias("unit")).withColumn("component", F.col("cls"))
    found = stored(verified(sets, dealt(first, classes)), "links")
    # a class is in one unit so far, and a unit's edges lead to the smallest class of each component
    joined = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if large_units(first, classes):
        # blocks of large units have met in themselves alone: some members of all blocks meet next
        some = with_components(first, joined).where(F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(16)) == 0)
        found = stored(found.unionByName(verified(sets, dealt(some, classes))), "links")
        joined = components(found, "joined")
    now = stored(with_components(led, joined), "now")
    mixed = now.groupBy("unit").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("unit")
    again = now.join(mixed, "unit", "left_semi")
    found = found.unionByName(verified(sets, dealt(again, classes, apart=True)))
    joined = components(found, "joined")
    ids = with_components(classes.select("cls", "doc_id"), joined)
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(least, "component").select("cls", "component_id", "component")
    return rows.join(ids, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class_id"), "digest", "component"
    )


def with_components(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows (with cls) and their component so far; a class without links is its own."""
    return rows.drop("component").join(joined.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("component", F.coalesce("root", "cls")).drop("root")


def unit_sizes(units: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units with n of each class, blocks of each unit that has two classes or more)."""
    members = units.join(classes.select("cls", "n"), "cls")
    sizes = members.groupBy("unit").agg(F.ceil(F.sum("n") * 8 / BLOCK).cast("long").alias("blocks"), F.count("*").alias("k"), F.sum(F.col("n") * 8).alias("bytes")).where("k > 1")
    return members, sizes


def large_units(units: DataFrame, classes: DataFrame) -> bool:
    return not unit_sizes(units, classes)[1].where("blocks > 1").isEmpty()


def dealt(units: DataFrame, classes: DataFrame, apart: bool = False) -> DataFrame:
    """cls, component, unit, side, part: classes dealt to tasks by unit, those of large units by block.

    apart: a unit's largest component is side 1 and stays in its own block; the rest is side 0 and goes to every block, in
    pieces, so that all pairs between components meet and nothing else has to."""
    members, sizes = unit_sizes(units, classes)
    # stored before it is grouped again: the join then stands between plain exchanges, and a unit with very many classes is split
    members = stored(members.join(sizes.select("unit", "blocks"), "unit"), "members")
    members = members.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / (2 << 20)))
    piece = F.lit(0).cast("long")
    if apart:
        counts = members.groupBy("unit", "component").agg(F.count("*").alias("k"))
        main = counts.groupBy("unit").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("k"), F.max("k").alias("inside"))
        # pieces of members outside: as many as keep a piece near a block's size
        main = main.select("unit", "main", F.greatest(F.lit(1), F.ceil((F.col("k") - F.col("inside")) / 4096)).cast("long").alias("pieces"))
        # stored for the same reason: joined to its own groups, a hot unit's members would have to meet in one task
        members = members.join(stored(main, "mains"), "unit")
        outside = F.col("component") != F.col("main")
        members = members.withColumn("side", F.when(outside, 0).otherwise(1))
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        pieces_ = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
        mine = F.pmod(F.xxhash64("cls", F.lit(2)), F.col("pieces"))
        # members outside meet every block with their own piece, and all other pieces where those are dealt as side 1
        spots = F.when(outside, F.flatten(F.transform(every, lambda b: F.transform(pieces_, lambda q: F.struct(b.alias("block"), q.alias("piece"), (q == mine).alias("own"))))))
        spots = spots.otherwise(F.transform(pieces_, lambda q: F.struct(F.col("block").alias("block"), q.alias("piece"), F.lit(False).alias("own"))))
        members = members.withColumn("spot", F.explode(spots)).withColumn("block", F.col("spot.block"))
        members = members.withColumn("side", F.when(F.col("spot.own"), 0).otherwise(1))
        piece = F.col("spot.piece")
    else:
        members = members.withColumn("side", F.lit(0))
    unit = F.when((F.col("blocks") > 1) | (piece > 0), F.xxhash64("unit", "block", piece)).otherwise(F.col("unit"))
    members = members.withColumn("task", unit)
    return members.select("cls", "component", F.col("task").alias("unit"), "side", F.pmod(F.xxhash64("task"), F.lit(parts)).alias("part"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("class_id", "digest", "component")


SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(r) AS c, min(doc_id) AS doc_id, list_sort(s) AS s, len(list_sort(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tokens AS MATERIALIZED (SELECT c, n, hash(t) AS t FROM (SELECT c, n, unnest(s) AS t FROM classes)),
links AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(c, root) AS (SELECT c, c FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.c),
comp AS (SELECT r.c, min(k.doc_id) AS component_id FROM reach r JOIN classes k ON k.c = r.root GROUP BY r.c)
SELECT x.doc_id, len(x.s)::BIGINT AS n_shingles, CASE WHEN len(x.s) = 0 THEN x.doc_id ELSE m.component_id END AS component_id
FROM sets x LEFT JOIN classes k ON k.s = list_sort(x.s) AND len(x.s) > 0 LEFT JOIN comp m ON m.c = k.c
"""


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each linked group does: the one with the smallest
    doc_id, null ids last, of several rows with it the one with the smallest text hash. Groups are told apart by their
    sets, not by ids. Documents without words are linked with nothing and stay."""
    found = jaccard_join(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("hash"))
    linked = found.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("least")).select("least.id", "least.hash")
    apart = found.where("n_shingles = 0").select(F.col("doc_id").alias("id"), F.col("digest").alias("hash"), F.lit(True).alias("repeats"))
    stay = linked.withColumn("repeats", F.lit(False)).unionByName(apart).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = rows.join(stay, rows.doc_id.eqNullSafe(stay.id) & (rows.digest == stay.hash))
    once = rows.where(~F.col("repeats")).dropDuplicates(["doc_id", "digest"])
    return once.unionByName(rows.where("repeats")).select("row.*")
