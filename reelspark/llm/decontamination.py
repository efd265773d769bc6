"""Op 3, benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, mix64, table

#: Characters that end words besides white space.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPLIT = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
#: Items that one pass looks for; more items take more passes.
ITEMS = 20_000
SCHEMA = "doc_id long, item_id long, distance long, item_words long, similarity double, start_word long, end_word long"
UNKNOWN, PAD = 0, 1
#: Letters of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han), each of them a word.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: Punctuation of these scripts.
MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; punctuation and white space of ASCII separate them, and each letter of a script without spaces is one."""
    text = (text or "").lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", MARKS.sub(" ", text)) if UNSPACED.search(text) else text
    return text.encode(errors="replace").translate(SPLIT).split()


def search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``pattern`` by edit distance, the first one of these: Myers' bit vectors."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text):
        eq = places.get(c, 0)
        vertical = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(flat | up)), up & flat
        score += bool(plus & high) - bool(minus & high)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score < best[0]:
            best = (score, at + 1)
    return best


class WindowIndex:
    """Benchmark items as word ids, their seeds, and LSH tables of their CGK embeddings."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float, repeats: int, sampled: int):
        self.similarity, self.repeats = similarity, repeats
        self.vocabulary = {w: i + 2 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.items = [(item_id, [self.vocabulary[w] for w in ws]) for item_id, ws in items]
        self.longest = max((len(x) for _, x in self.items), default=0)
        lengths = sorted({len(x) for _, x in self.items})
        #: Length classes share their sampled steps; lengths in one class differ by a quarter at most.
        self.classes: list[tuple[int, np.ndarray]] = []
        of: dict[int, int] = {}
        rng = np.random.default_rng(7)
        for n in lengths:
            if not self.classes or n > 1.25 * self.classes[-1][0]:
                self.classes.append((n, rng.integers(0, max(1, int(1.5 * n)), (repeats, sampled))))
            of[n] = len(self.classes) - 1
        steps = max((int(s.max()) for _, s in self.classes), default=0) + 1
        self.steps = steps
        symbols = np.arange(len(self.vocabulary) + 2, dtype=np.uint64)
        #: bits[r][b] holds for each symbol 64 random moves, those of steps 64 b and on, of repetition r.
        self.bits = [[mix64(symbols, 1000 * r + b + 1) for b in range(-(-steps // 64))] for r in range(repeats)]
        flat = np.full(sum(len(x) + 2 * self.longest + 2 for _, x in self.items), PAD, np.int64)
        starts, at = [], 0
        for _, x in self.items:
            flat[at : at + len(x)] = x
            starts.append(at)
            at += len(x) + 2 * self.longest + 2
        self.tables = []
        kind = np.array([of[len(x)] for _, x in self.items], np.int64)
        for r in range(repeats):
            keys = self.embed(flat, np.array(starts, np.int64), np.full(len(starts), len(flat)), r) if starts else np.zeros((0, 0), np.uint64)
            row = []
            for c in range(len(self.classes)):
                mine = np.flatnonzero(kind == c)
                by = np.argsort(keys[c][mine], kind="stable")
                row.append((keys[c][mine][by], mine[by]))
            self.tables.append(row)
        #: By length of a piece: hashes of the pieces in order, and the item and the place in it of each.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[list[int], int, int]]] = {}
        for i, (_, x) in enumerate(self.items):
            k = self.allowed(len(x))
            q = len(x) // (k + 1)
            for piece in range(k + 1):
                found.setdefault(q, []).append((x[piece * q : piece * q + q], i, piece * q))
        for q, grams in found.items():
            g = self.gram(np.array([w for w, _, _ in grams], np.int64).reshape(-1, q).T)
            by = np.argsort(g, kind="stable")
            self.seeds[q] = g[by], np.array([i for _, i, _ in grams], np.int64)[by], np.array([o for _, _, o in grams], np.int64)[by]

    def allowed(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    @staticmethod
    def gram(columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[1], np.uint64)
        for c in columns:
            h = mix64(h ^ c.astype(np.uint64), 3)
        return h

    def embed(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, r: int) -> np.ndarray:
        """LSH keys by length class and window for repetition r. A window's CGK walk writes the word it stands at, and a
        random bit of (step, word) says whether it moves on; past the document's end it reads padding."""
        wanted = [set(s[r].tolist()) for _, s in self.classes]
        keys = np.zeros((len(self.classes), len(starts)), np.uint64)
        at = starts.copy()
        for step in range(max(max(w) for w in wanted) + 1):
            symbol = np.where(at < ends, ids[np.minimum(at, len(ids) - 1)], PAD)
            for c, w in enumerate(wanted):
                if step in w:
                    keys[c] = mix64(keys[c] ^ symbol.astype(np.uint64), step + 5)
            at += ((self.bits[r][step // 64][symbol] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64)
        return keys

    def pieces(self, ids: np.ndarray) -> np.ndarray:
        """(place, item, place in the item) of all pieces that are in the texts, as columns. An item of n words with k edits
        leaves one of k + 1 equal pieces of it whole, moved by k places at most, so all matches have one here."""
        hits = [np.zeros((3, 0), np.int64)]
        known = ids > PAD
        for q, (seeds, items, offsets) in self.seeds.items():
            n = len(ids) - q + 1
            if n <= 0:
                continue
            run = known[:n].copy()
            for i in range(1, q):
                run &= known[i : n + i]
            at = np.flatnonzero(run)
            g = self.gram(np.stack([ids[at + i] for i in range(q)])) if len(at) else np.zeros(0, np.uint64)
            lo, hi = np.searchsorted(seeds, g, "left"), np.searchsorted(seeds, g, "right")
            some = np.flatnonzero(hi > lo)
            n = (hi - lo)[some]
            which = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hits.append(np.stack([np.repeat(at[some], n), items[which], offsets[which]]))
        return np.concatenate(hits, axis=1)

    def windows(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Starts of all windows that can be near an item: those that can hold one of its pieces, wherever the piece lies."""
        at = np.unique(places)
        reach = int(self.longest + self.allowed(self.longest))
        steps = np.zeros(len(ids) + 1, np.int64)
        np.add.at(steps, np.maximum(at - reach, 0), 1)
        np.add.at(steps, at + 1, -1)
        return np.flatnonzero((np.cumsum(steps[:-1]) > 0) & (ids != PAD))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, distance, item words, first word, word after the last) of the best match of each item in each text."""
        find = self.vocabulary.get
        rows = [[find(w, UNKNOWN) for w in words_of(t)] for t in texts]
        ends = np.cumsum([len(x) + 1 for x in rows])
        ids = np.array([w for x in rows for w in (*x, PAD)], np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(x) + 1 for x in rows])
        place, piece_of, offset = self.pieces(ids)
        starts = self.windows(ids, place)
        if not len(starts):
            return []
        stop = ends[doc[starts]] - 1
        # the walk misses edited copies, the more the longer they are; the pieces miss none
        pairs = [np.stack([place - offset, piece_of, doc[place]])]
        for r in range(self.repeats):
            keys = self.embed(ids, starts, stop, r)
            for c, (sorted_keys, which) in enumerate(self.tables[r]):
                lo, hi = np.searchsorted(sorted_keys, keys[c], "left"), np.searchsorted(sorted_keys, keys[c], "right")
                some = np.flatnonzero(hi > lo)
                n = (hi - lo)[some]
                item = which[np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                window = np.repeat(starts[some], n)
                pairs.append(np.stack([window, item, doc[window]]))
        both = np.concatenate(pairs, axis=1)
        begin = ends - np.array([len(x) + 1 for x in rows])
        # candidates of one item that overlap are verified as one stretch
        both = np.unique(both, axis=1)
        start, item, of = both[:, np.lexsort((both[0], both[2], both[1]))]
        size = np.array([len(x) for _, x in self.items], np.int64)
        fresh = np.r_[True, (item[1:] != item[:-1]) | (of[1:] != of[:-1]) | (start[1:] - start[:-1] > size[item[1:]])] if len(start) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(start)] - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for a, b in zip(first.tolist(), last.tolist()):
            i, d = int(item[a]), int(of[a])
            pattern = self.items[i][1]
            k = self.allowed(len(pattern))
            low = max(int(begin[d]), int(start[a]) - k)
            text = ids[low : min(int(ends[d]) - 1, int(start[b]) + len(pattern) + k)].tolist()
            distance, end = search(pattern, text)
            if distance <= k:
                back = search(pattern[::-1], text[:end][::-1])[1]
                found = (distance, low + end - back - int(begin[d]), low + end - int(begin[d]))
                best[d, i] = min(best.get((d, i), found), found)
        return [(d, self.items[i][0], x[0], len(self.items[i][1]), x[1], x[2]) for (d, i), x in sorted(best.items())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 1, repeats: int = 24, sampled: int = 3) -> DataFrame:
    """One row for each pair of a row of ``docs`` (doc_id, text) and an item of ``benchmark`` (item_id, text) where the
    document holds a stretch of words within ``(1 - similarity) * item words`` edits of the item: SCHEMA; the best match,
    of equals the first.

    Words are lower-cased and split at ASCII punctuation and white space, so layout and case do not hide a copy; each
    letter of a script without spaces is a word. Windows of the whole text are embedded ``repeats`` times by the CGK walk,
    and hashed by ``sampled`` symbols of the walk; what shares a piece with an item that no match can be without is a
    candidate too, so no match is missed; every pair that is returned is verified exactly. Items of under five words match
    their exact words; those of fewer than ``min_words`` words are left out, as are items without words; null and empty
    texts match nothing, texts of any length are searched whole; null ids, of items too, stay, and of repeated rows each
    has its own matches; empty tables give no rows. The benchmark is the small side: it goes to the tasks in
    blocks of ``ITEMS`` items, and each document is searched where it lies, so nothing is shuffled."""
    out = None
    for sent in indexes(docs.sparkSession, benchmark, similarity, min_words, repeats, sampled):

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch | None:
            index = sent.value
            found = index.matches(batch.column(1).to_pylist()) if index.items else []
            if not found:
                return None
            row, item, *rest = zip(*found)
            distance, words, start, end = (np.array(x, np.int64) for x in rest)
            columns = [batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(distance), pa.array(words), pa.array(1 - distance / words), pa.array(start), pa.array(end)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        found = by_batch(docs.select("doc_id", "text"), run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def indexes(spark: SparkSession, benchmark: DataFrame, similarity: float, min_words: int, repeats: int, sampled: int) -> list[Broadcast]:
    """The benchmark as broadcast indexes of about ITEMS items each."""
    blocks = max(1, -(-benchmark.count() // ITEMS))
    out = []
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r["item_id"], words_of(r["text"])) for r in part.select("item_id", "text").collect()]
        items = sorted(((i, w) for i, w in items if len(w) >= max(1, min_words)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out.append(spark.sparkContext.broadcast(WindowIndex(items, similarity, repeats, sampled)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 1, repeats: int = 24, sampled: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``decontaminate`` finds no item."""
    at = docs.columns.index("text")
    for sent in indexes(docs.sparkSession, benchmark, similarity, min_words, repeats, sampled):

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            index = sent.value
            bad = {m[0] for m in index.matches(batch.column(at).to_pylist())} if index.items else set()
            return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = by_batch(docs, run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
