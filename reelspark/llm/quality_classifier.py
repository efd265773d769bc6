"""Op 1, quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, stored, table

FEATURES = (
    "log_words", "symbols", "marks", "shouts", "capitals", "digits", "word_length", "distinct",
    "dup_lines", "commonest", "repeated_triples", "stops", "lines", "code",
)
CLASSES = ((1, b"#*$%&"), (2, b"|<>"), (3, b"!"), (4, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (5, b"0123456789"), (11, b"."), (13, b"{}()[];=_/@"))
#: Labelled rows that the document classifier is fitted on, at most; the ones with the smallest hashes of doc_id.
SAMPLE = 20_000
CLIP = 8.0


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text; those of a text without words are all 0."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    out = [0.0] * len(FEATURES)
    if not n:
        return out
    per = {4: len(raw), 5: len(raw), 13: len(raw)}
    for at, chars in CLASSES:
        out[at] = (len(raw) - len(raw.translate(None, chars))) / per.get(at, n)
    out[0] = float(np.log1p(n))
    out[6] = len(raw) / n
    counts = Counter(words)
    out[7] = len(counts) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[8] = 1 - len(set(lines)) / len(lines)
    out[9] = max(counts.values()) / n
    out[10] = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 0.0
    out[12] = len(lines) / n
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> dict:
    """Logistic regression by Newton's steps over standardised features; without both classes, the rate alone."""
    mean, spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    w = np.zeros(len(FEATURES) + 1)
    prior = (y.sum() + 1) / (len(y) + 2)
    w[0] = np.log(prior / (1 - prior))
    if 0 < y.sum() < len(y):
        z = np.c_[np.ones(len(x)), np.clip((x - mean) / spread, -CLIP, CLIP)]
        keep = np.r_[1e-6, np.full(len(FEATURES), ridge)]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * w)
            w += step
            if abs(step).max() < 1e-6:
                break
    return {"mean": mean, "spread": spread, "w": w, "prior": float(prior)}


def evidence(texts: list[str | None], model: dict) -> np.ndarray:
    """Log odds of good quality by the text alone."""
    x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
    return np.clip(model["w"][0] + np.clip((x - model["mean"]) / model["spread"], -CLIP, CLIP) @ model["w"][1:], -30, 30)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: Column, low: float = 2.0, high: float = 1000.0) -> float:
    """The beta prior's strength by moments from the spread of groups (n, k) about ``parent``; five sums for the driver."""
    s, total, squares, inner, count = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - parent, 2)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * parent * (1 - parent)), F.count("*")
    ).first()
    rho = 1e-6
    if count > 1 and inner and (spare := total - squares / total - (count - 1)):
        rho = max(rho, (s / (inner / total) - (count - 1)) / spare)
    return min(high, max(low, (1 - rho) / rho))


class Sites:
    """Beta posteriors of hosts and their paths, whose prior is the level above: all rows, host, path.

    outcomes: host, path, good (0 to 1), weight (how much of an outcome it is, 0 to 1). ``counts`` has one row a path:
    its n and k and its host's (sums of weight and of good times weight), stored once. Rows are summed on their own
    machines first, so a host with a third of all rows is a few partial sums."""

    def __init__(self, outcomes: DataFrame):
        paths = outcomes.groupBy("host", "path").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("good")).alias("k"))
        paths = stored(paths, "paths")
        hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts")
        n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
        self.root = ((k or 0.0) + 1) / ((n or 0.0) + 2)
        self.host_strength = _strength(hosts, F.lit(self.root))
        self.counts = paths.join(hosts.withColumnsRenamed({"n": "host_n", "k": "host_k"}), "host")
        rate = (self.host_strength * self.root + F.col("host_k")) / (self.host_strength + F.col("host_n"))
        self.path_strength = _strength(self.counts, rate)

    def rates(self, good: Column, weight: Column) -> tuple[Column, Column]:
        """(host, path) posterior means over ``counts`` without one outcome of their own."""
        own = good * weight
        host = (self.host_strength * self.root + F.col("host_k") - own) / (self.host_strength + F.col("host_n") - weight)
        return host, (self.path_strength * host + F.col("k") - own) / (self.path_strength + F.col("n") - weight)


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path section of a document: ``source`` up to the first slash and the section after it; where the source
    has no slash, its language sections stand for paths. Nulls are empty."""
    source = F.coalesce(source, F.lit(""))
    return F.substring_index(source, "/", 1), F.when(source.contains("/"), F.split(source, "/")[1]).otherwise(F.coalesce(lang, F.lit("")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows of ``docs`` (text, y), those with the smallest hashes of doc_id. A doc_id that is
    labelled twice takes its smallest label; null ids and labels are unlabelled."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def quality_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source, lang): doc_id, digest (xxhash64 of the text), doc_score,
    host_rate, path_rate, score, keep.

    A logistic model of the text is fitted on the driver on at most ``sample`` labelled rows. Outcomes of all documents
    are summed by host and path: a label counts as one outcome, a probability p of the model as (2 p - 1) ** 2 of one,
    so that undecided ones count little. Posteriors are shrunk from all rows to host to path, for each document without
    its own outcome. score: the text's log odds plus the log odds of the path's posterior over those of the global rate;
    keep: score >= threshold. Texts of any length are read whole; null and empty texts have no evidence but the features
    of an empty text, sites of null sources count as one host '', rows with null or repeated ids are judged one by one,
    other columns are ignored, empty tables give no rows, and without labels all scores are near 1/2."""
    fitted = by_batch(labelled_sample(docs, labels, label, sample).select("text", "y"), _sample_features, "x array<double>, y int").toPandas()
    x = np.array(fitted["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([fitted["y"].to_numpy(), *x.T])  # rows come in any order; the sums of the fit shall not
    model = fit(x[order], fitted["y"].to_numpy(float)[order])
    host, path = site(F.col("source"), F.col("lang"))

    rows = docs.select("text", "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), host.alias("host"), path.alias("path"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(evidence(batch.column(0).to_pylist(), model))], ["doc_id", "digest", "host", "path", "log_odds"])

    scored = stored(by_batch(rows, run, "doc_id long, digest long, host string, path string, log_odds double"), "quality")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    good, weight = F.coalesce("y", p), F.when(F.col("y").isNotNull(), 1.0).otherwise(F.pow(2 * p - 1, 2))
    rows = scored.join(known, "doc_id", "left").withColumns({"good": good, "weight": weight}).drop("y")
    sites = Sites(rows)
    host_rate, path_rate = sites.rates(F.col("good"), F.col("weight"))
    # one row a path; Spark broadcasts it where its measured size is small and splits hot hosts where not
    out = rows.join(sites.counts, ["host", "path"]).select("doc_id", "digest", p.alias("doc_score"), "log_odds", host_rate.alias("host_rate"), path_rate.alias("path_rate"))
    score = 1 / (1 + F.exp(-(F.col("log_odds") + _logit(F.col("path_rate")) - _logit(F.lit(sites.root)))))
    return out.withColumns({"score": score, "keep": score >= threshold}).drop("log_odds")


def _sample_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    stay = quality_classifier(docs, labels).where("keep").select(F.col("doc_id").alias("id"), F.col("digest").alias("hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    return rows.join(stay, rows.doc_id.eqNullSafe(stay.id) & (rows.digest == stay.hash), "left_semi").select("row.*")
