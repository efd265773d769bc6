"""Op 10, toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, pieces, stored, table
from .quality_classifier import labelled_sample

#: Labelled rows in the index, at most; the ones with the smallest hashes of doc_id.
EXAMPLES = 2_000
MARKS = b".,;:!?\"'()[]{}#*$%&|<>"
SPACED = bytes(32 if b in MARKS else b for b in range(256))
#: Words whose terms and query vectors whose answers a worker keeps; beyond it starts anew.
KEPT = 300_000
BIAS = 3.0
#: Queries that are searched at a time, and of how many examples one at least has a frequent term.
BATCH, FREQUENT = 128, 16
#: A term's lift is shrunk towards 1 by so many examples at the base rate.
SHRINK = 8.0

#: A text's terms in rising order and how often each is in it.
Vector = tuple[np.ndarray, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    """A text's words in lower case, cut at white space and ``MARKS``."""
    return (text or "").lower().encode(errors="replace").translate(SPACED).split()


def word_terms(word: str) -> tuple[str, ...]:
    """A word's terms: itself, from three letters, and its first five letters, where it is longer."""
    return (word, "^" + word[:5]) if len(word) > 5 else (word,) if len(word) >= 3 else ()


class Terms(dict):
    """Word -> number of its pair of terms in the vocabulary, found once for each word; -1 stands for a term that is not in it."""

    def __init__(self, vocabulary: list[str]):
        self.at = {t: i for i, t in enumerate(vocabulary)}
        self.size = len(vocabulary)
        self.pairs = array("i", (-1, -1))

    def __missing__(self, word: bytes) -> int:
        find = self.at.get
        text = word.decode(errors="replace")
        pair = (find(text, -1), find("^" + text[:5], -1)) if len(text) > 5 else (find(text, -1), -1)
        self[word] = code = len(self.pairs) // 2 if pair != (-1, -1) else 0
        if code:
            self.pairs.extend(pair)
        return code

    def count_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, position of the term, how often it is in the whole text), sorted; texts without terms have no row."""
        if len(self) > KEPT:
            self.clear()
            self.pairs = array("i", (-1, -1))
        words = [Counter(words_of(t)) for t in texts]
        sizes = [len(x) for x in words]
        codes = np.fromiter((c for x in words for c in map(self.__getitem__, x)), np.int64, sum(sizes))
        often = np.fromiter((n for x in words for n in x.values()), np.int64, sum(sizes))
        terms = np.array(self.pairs, np.int64).reshape(-1, 2)[codes]
        real = terms >= 0
        key = (np.repeat(np.arange(len(texts)) * max(1, self.size), sizes)[:, None] + terms)[real]
        by = np.argsort(key)
        key, often = key[by], np.repeat(often, 2).reshape(-1, 2)[real][by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, n = key[first], np.add.reduceat(often, first) if len(first) else first
        return key // max(1, self.size), key % max(1, self.size), n

    def vectors(self, texts: list[str | None]) -> list[Vector]:
        place, term, n = self.count_all(texts)
        cuts = np.searchsorted(place, np.arange(len(texts) + 1)).tolist()
        term, n = term.astype(np.int32), n.astype(np.int32)
        return [(term[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]


def terms_of(sample: DataFrame) -> list[str]:
    """All terms of the examples' texts, sorted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = {w for text in batch.column(0).to_pylist() for w in words_of(text)}
        return pa.RecordBatch.from_arrays([pa.array(sorted({t for w in words for t in word_terms(w.decode(errors="replace"))}), pa.string())], ["term"])

    return sorted(by_batch(sample.select("text"), run, "term string").distinct().toArrow().column(0).to_pylist())


def lifts(vectors: list[Vector], y: np.ndarray, terms: int) -> np.ndarray:
    """How much more often than at the base rate an example with the term has label 1, shrunk by ``SHRINK``; no term gets 0."""
    if not 0 < y.sum() < len(y):
        return np.ones(terms)
    ones, every = np.zeros(terms), np.zeros(terms)
    for (t, _), label in zip(vectors, y.tolist()):
        every[t] += 1
        ones[t] += label
    base = y.sum() / len(y)
    return (ones + SHRINK * base) / (every + SHRINK) / base


class BlockMaxIndex:
    """Postings of the examples' unit vectors by term; of frequent terms in blocks of examples, with each term's largest
    weight in each block.

    ``nearest`` is exact and takes many queries at a time: postings of rare terms are added up in full, which with the
    frequent terms' largest weights bounds each block for each query. The blocks with the highest bounds are opened
    first, and none stays closed whose bound reaches the query's k-th best similarity. All vectors share one constant
    component, so that few weak terms are not a full match."""

    def __init__(self, vectors: list[Vector], y: np.ndarray, idf: np.ndarray, block: int = 64, k: int = 15):
        self.idf, self.width = idf, block
        n, terms = len(vectors), len(idf) + 1
        self.n, self.blocks, self.k = n, -(-n // block), min(k, n)
        of, term, weight = self.units(vectors) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # examples with like leading terms lie together, which keeps the bounds tight
        real = np.flatnonzero(term < len(idf))
        by = real[np.lexsort((term[real], -weight[real], of[real]))]
        first = np.searchsorted(of[by], np.arange(n + 1))
        lead = [tuple(term[by[a : min(a + 2, b)]].tolist()) for a, b in zip(first, first[1:])]
        self.order = np.array(sorted(range(n), key=lambda i: (lead[i], i)), np.int64)
        self.y = np.asarray(y, float)[self.order]
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        by = np.lexsort((place[of], term))
        self.starts = np.searchsorted(term[by], np.arange(terms + 1))
        self.place, self.weight = place[of[by]], weight[by]
        self.open()
        self.slope, self.shift = 1.0, 0.0
        self.base = float((self.y.sum() + 1) / (n + 2))

    def open(self) -> None:
        """Lays the frequent terms' weights out in blocks."""
        size = np.diff(self.starts)
        often = np.flatnonzero(size * FREQUENT > self.n)
        self.row = np.full(len(size), -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks, len(often), self.width))
        for r, t in enumerate(often.tolist()):
            mine = self.place[self.starts[t] : self.starts[t + 1]]
            self.dense[mine // self.width, r, mine % self.width] = self.weight[self.starts[t] : self.starts[t + 1]]
        self.most = self.dense.max(axis=2).T.copy() if self.blocks else np.zeros((len(often), 0))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "dense", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def units(self, vectors: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, term, weight) of all terms of all unit vectors; the constant component comes last in each."""
        size = np.array([len(t) + 1 for t, _ in vectors], np.int64)
        last = np.cumsum(size) - 1
        term, weight = np.full(size.sum(), len(self.idf), np.int64), np.full(size.sum(), BIAS)
        inner = np.ones(len(term), bool)
        inner[last] = False
        term[inner] = np.concatenate([t for t, _ in vectors])
        weight[inner] = (1 + np.log(np.concatenate([n for _, n in vectors]))) * self.idf[term[inner]]
        norm = np.sqrt(np.add.reduceat(weight * weight, last - size + 1))
        return np.repeat(np.arange(len(vectors)), size), term, weight / np.repeat(norm, size)

    def added(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """(queries, blocks, width): the part that these terms have in the similarities, from their whole postings."""
        cells = self.blocks * self.width
        low, size = self.starts[term], self.starts[term + 1] - self.starts[term]
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found = np.bincount(np.repeat(query * cells, size) + self.place[at], np.repeat(weight, size) * self.weight[at], minlength=queries * cells)
        return found.reshape(queries, self.blocks, self.width)

    def nearest(self, vectors: list[Vector], without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(queries, k) places and similarities of the most similar examples, best first, ties by place. ``without`` has
        for each query a place that is left out."""
        queries, cells = len(vectors), self.blocks * self.width
        if not queries or not self.n:
            return np.zeros((queries, 0), np.int64), np.zeros((queries, 0))
        query, term, weight = self.units(vectors)
        rare = self.row[term] < 0
        total = self.added(query[rare], term[rare], weight[rare], queries)
        common = np.zeros((queries, len(self.most)))
        common[query[~rare], self.row[term[~rare]]] = weight[~rare]
        bound = total.max(axis=2) + common @ self.most
        # similarity to nine digits, then the place: one number for each candidate, no two alike; 0 is none
        keys = np.zeros((queries, cells), np.int64)
        after = (cells - np.arange(cells)).reshape(self.blocks, self.width)
        opened = np.zeros((queries, self.blocks), bool)

        def open_blocks(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                who = np.flatnonzero(wanted[:, b])
                who = slice(None) if 2 * len(who) > queries else who  # a product with all costs less than a copy of most
                sims = total[who, b] + common[who] @ self.dense[b]
                keys[who, b * self.width : (b + 1) * self.width] = np.rint(sims * 1e9).astype(np.int64) * (cells + 1) + after[b]
            keys[:, self.n :] = 0
            if without is not None:
                keys[np.arange(queries), without] = 0
            opened[wanted] = True

        first = min(self.blocks, -(-(self.k + 1) // self.width) + 1)
        wanted = np.zeros_like(opened)
        wanted[np.arange(queries)[:, None], np.argpartition(-bound, first - 1, axis=1)[:, :first]] = True
        open_blocks(wanted)
        worst = np.partition(keys, cells - self.k, axis=1)[:, cells - self.k]
        open_blocks(~opened & (bound >= (worst // (cells + 1) / 1e9 - 1e-8)[:, None]))
        best = np.argpartition(keys, cells - self.k, axis=1)[:, cells - self.k :]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, 1), axis=1), 1)
        found = np.take_along_axis(keys, best, 1)
        return np.where(found > 0, best, -1), found // (cells + 1) / 1e9

    def vote(self, places: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Share of label 1 among each query's neighbours, by inverse distance, with one neighbour's weight at the base
        rate; place -1 is no neighbour."""
        weight = np.where(places >= 0, 1 / (np.maximum(1 - sims, 0) + 0.02), 0)
        return ((weight * self.y[places]).sum(axis=1) + self.base) / (weight.sum(axis=1) + 1)

    def calibrate(self, vectors: list[Vector]) -> None:
        """A logistic line through the examples' votes without themselves."""
        if not 0 < self.y.sum() < self.n:
            return
        places = [np.arange(a, min(a + BATCH, self.n)) for a in range(0, self.n, BATCH)]
        votes = np.concatenate([self.vote(*self.nearest([vectors[i] for i in self.order[at]], at)) for at in places])
        x = np.log(votes / (1 - votes))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            v = p * (1 - p) + 1e-6
            g = np.array([((self.y - p) * x).sum() - 0.5 * (a - 1), (self.y - p).sum()])
            h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum()]])
            da, db = np.linalg.solve(h, g)
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-9:
                break
        if a > 0:
            self.slope, self.shift = float(a), float(b)

    def score(self, vectors: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores, places and similarities."""
        if not self.n:
            return np.full(len(vectors), 0.5), *self.nearest(vectors)
        places, sims = self.nearest(vectors)
        v = self.vote(places, sims)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -30, 30))), places, sims


def pieces_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def document_frequencies(docs: DataFrame, vocabulary: Broadcast) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary is, and how many documents there are. Each task counts
    where its documents lie; what reaches the driver is one sum for each term of the examples."""
    size = len(vocabulary.value)

    def run(batches):
        terms, seen = Terms(vocabulary.value), np.zeros(size + 1, np.int64)
        for batch in pieces(batches):
            seen[:-1] += np.bincount(terms.count_all(batch.column(0).to_pylist())[1], minlength=size)[:size]
            seen[-1] += batch.num_rows
        at = np.flatnonzero(seen)
        for x in range(0, len(at), 10_000):
            part = at[x : x + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[part])], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df[:-1], int(df[-1])


def fit_index(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, k: int = 15) -> tuple[list[str], BlockMaxIndex, list[int]]:
    """(vocabulary, calibrated index, doc_id of each place) from at most ``examples`` labelled rows; the vocabulary is all
    terms of these, weighted by idf times lift, and document frequencies cover all documents."""
    sample = stored(labelled_sample(docs, labels, label, examples).select("doc_id", "text", "y"), "examples")
    vocabulary = terms_of(sample)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    df, n = document_frequencies(docs, sent)
    idf = np.maximum(np.log((n + 1) / (df + 0.5)), 0.01)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Terms(sent.value).vectors(batch.column(1).to_pylist())
        pairs = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *pairs], ["doc_id", "y", "terms", "counts"])

    rows = by_batch(sample, run, "doc_id long, y int, terms array<int>, counts array<int>").toArrow()
    ids, y = rows.column("doc_id").to_pylist(), rows.column("y").to_numpy()
    vectors = [(t.values.to_numpy(), c.values.to_numpy()) for t, c in zip(rows.column("terms"), rows.column("counts"))]
    by = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i][0].tobytes(), vectors[i][1].tobytes()))
    ids, y, vectors = [ids[i] for i in by], y[by].astype(float), [vectors[i] for i in by]
    index = BlockMaxIndex(vectors, y, idf * lifts(vectors, y, len(idf)), k=k)
    index.calibrate(vectors)
    return vocabulary, index, [ids[i] for i in index.order]


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, k: int = 15, evidence: int = 3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, evidence (the nearest
    examples: doc_id, similarity, label).

    Labels of rows whose crc32(doc_id) is divisible by 5 are never read. At most ``examples`` of the others make the
    index, with all their terms; it is bounded by their texts and goes to every task. Scores depend on the text alone,
    whole at any length; null and empty texts are scored as texts without any term. Of equally near examples the first
    in the index counts. Null ids are held out; repeated rows stay and are searched once; other columns are ignored;
    empty tables give no rows, and without labels every score is 1/2."""
    known = labels.where(~held_out(F.col("doc_id")))
    vocabulary, index, ids = fit_index(docs, known, label, examples, k)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, index, ids))
    near = "array<struct<doc_id:bigint,similarity:double,label:int>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        vocabulary, index, ids = sent.value
        terms, answers = Terms(vocabulary), {}
        for batch in (x for whole in pieces(batches) for x in pieces_of(whole, BATCH)):
            vectors = terms.vectors(batch.column(1).to_pylist())
            prints = [hashlib.blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() for t, n in vectors]
            # copies are searched once
            fresh = {x: v for x, v in zip(prints, vectors) if x not in answers}
            if len(answers) > KEPT // 10:
                answers = {x: answers[x] for x in prints if x in answers}
            scores, places, sims = index.score(list(fresh.values()))
            for x, score, at, near in zip(fresh, scores.tolist(), places[:, :evidence].tolist(), sims.tolist()):
                answers[x] = score, [{"doc_id": ids[p], "similarity": s, "label": int(index.y[p])} for p, s in zip(at, near) if p >= 0]
            found = [answers[x] for x in prints]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], kind)], ["doc_id", "score", "evidence"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, evidence {near}")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")
