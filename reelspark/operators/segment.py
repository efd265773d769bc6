"""From sampled frames to scenes: adjacent similarity, minima, boundaries, scenes, merging, three vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def sampled(frames: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th frame."""
    return frames.where(F.col("frame_no") % step == 0)


def adjacent_similarity(samples: DataFrame) -> DataFrame:
    """Samples (video_path, frame_no, vec) with next_frame and sim, the product with the next sample; null for the last."""
    w = Window.partitionBy("video_path").orderBy("frame_no")
    return samples.withColumns({"next_frame": F.lead("frame_no").over(w), "next_vec": F.lead("vec").over(w)}).withColumn("sim", V.dot("vec", "next_vec")).drop("next_vec")


def local_minima(pairs: DataFrame, order: int = 2) -> DataFrame:
    """Adds is_min: sim is under the ``order`` values on either side, all of which must exist."""
    w = Window.partitionBy("video_path").orderBy("frame_no")
    before, after = w.rowsBetween(-order, -1), w.rowsBetween(1, order)
    low = (F.col("sim") < F.min("sim").over(before)) & (F.col("sim") < F.min("sim").over(after))
    full = (F.count("sim").over(before) == order) & (F.count("sim").over(after) == order)
    return pairs.withColumn("is_min", F.coalesce(low & full, F.lit(False)))


def boundaries(samples: DataFrame, threshold: float = 0.85, order: int = 2) -> DataFrame:
    """Samples with sim, next_frame and is_boundary: the first sample of a video, and the one after each minimum under the
    threshold; where a video has no such minimum, each sample whose own similarity to the next is under it."""
    pairs = local_minima(adjacent_similarity(samples), order)
    w = Window.partitionBy("video_path").orderBy("frame_no")
    video = Window.partitionBy("video_path")
    pairs = pairs.withColumn("cut", F.col("is_min") & (F.col("sim") < threshold) & (F.count("sim").over(video) > 2 * order))
    after_cut = F.coalesce(F.lag("cut").over(w), F.lit(False))
    any_cut = F.max("cut").over(video)
    weak = F.coalesce(F.col("sim") < threshold, F.lit(False))
    first = F.row_number().over(w) == 1
    return pairs.withColumn("is_boundary", first | F.when(any_cut, after_cut).otherwise(weak)).drop("cut")


def scene_samples(marked: DataFrame) -> DataFrame:
    """Adds scene_no, which counts boundaries."""
    w = Window.partitionBy("video_path").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("scene_no", F.sum(F.col("is_boundary").cast("int")).over(w))


def scene_spans(marked: DataFrame) -> DataFrame:
    """video_path, start_frame, end_frame of scenes; a scene of one sample has no length and goes."""
    spans = scene_samples(marked).groupBy("video_path", "scene_no").agg(F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"))
    return spans.where("end_frame > start_frame").drop("scene_no")


def triplets(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """Scenes with features: the vectors of their first, middle (position n // 2) and last sample. Two samples: the mean is in
    the middle, not normalised; one: three times the same; none: zeros.

    Each sample belongs to one scene, so samples take their scene from the last start at or before them: a window, no
    range join."""
    keys = ["video_path", "start_frame", "end_frame"]
    marks = spans.select("video_path", F.col("start_frame").alias("frame_no"), "start_frame", "end_frame", F.lit(0).alias("kind"), F.lit(None).cast("array<double>").alias("vec"))
    points = samples.select("video_path", "frame_no", F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"), F.lit(1).alias("kind"), V.doubles("vec").alias("vec"))
    w = Window.partitionBy("video_path").orderBy("frame_no", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(points).withColumns({"start_frame": F.last("start_frame", ignorenulls=True).over(w), "end_frame": F.last("end_frame", ignorenulls=True).over(w)})
    inside = both.where("kind = 1 and start_frame is not null and frame_no <= end_frame")
    s = Window.partitionBy(*keys)
    ranked = inside.withColumns({"rn": F.row_number().over(s.orderBy("frame_no")), "n": F.count("*").over(s)})

    def at(place) -> F.Column:
        return F.max(F.when(F.col("rn") == place, F.col("vec")))

    three = ranked.groupBy(*keys).agg(F.max("n").alias("n"), at(F.lit(1)).alias("a"), at(F.floor(F.col("n") / 2) + 1).alias("m"), at(F.col("n")).alias("z"))
    middle = F.when(F.col("n") >= 3, F.col("m")).otherwise(V.mean_of("a", "z"))
    three = three.select(*keys, F.col("n").alias("samples"), F.array("a", middle, "z").alias("features"))
    dim = samples.agg(F.max(F.size("vec")).alias("dim"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), F.col("dim")), 3)
    out = spans.join(three, keys, "left").crossJoin(F.broadcast(dim))
    return out.withColumns({"features": F.coalesce("features", zeros), "samples": F.coalesce("samples", F.lit(0))}).drop("dim")


def _middle(frames: np.ndarray, vecs: np.ndarray, start: int, end: int) -> np.ndarray:
    inside = np.flatnonzero((frames >= start) & (frames <= end))
    if not len(inside):
        return np.zeros(vecs.shape[1])
    if len(inside) < 3:
        return (vecs[inside[0]] + vecs[inside[-1]]) / 2
    return vecs[inside[len(inside) // 2]]


def merge_short(scenes: list[tuple[int, int]], frames: np.ndarray, vecs: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Passes from left to right until nothing changes: a scene shorter than ``shortest`` joins the neighbour whose middle
    vector is nearer, the one before it on a tie; neighbours that were taken in the same pass are not there."""
    for _ in range(len(scenes)):
        middles = [_middle(frames, vecs, a, b) for a, b in scenes]
        out: list[tuple[int, int]] = []
        taken: set[int] = set()
        changed = False
        for i, (a, b) in enumerate(scenes):
            if i in taken:
                continue
            if b - a >= shortest:
                out.append((a, b))
                continue
            left = float(middles[i] @ middles[i - 1]) if i and i - 1 not in taken and out else -1.0
            right = float(middles[i] @ middles[i + 1]) if i + 1 < len(scenes) else -1.0
            if left > -1 and left >= right:
                out[-1] = (out[-1][0], b)
                taken.add(i)
                changed = True
            elif right > -1:
                out.append((a, scenes[i + 1][1]))
                taken.add(i + 1)
                changed = True
            else:
                out.append((a, b))
        scenes = out
        if not changed:
            break
    return scenes


def merge_short_scenes(spans: DataFrame, samples: DataFrame, shortest: int = 7) -> DataFrame:
    """video_path, start_frame, end_frame after short scenes joined a neighbour.

    Each pass depends on what the one before it did, so a video's scenes go through Python together; a group is one
    video, whose length does not grow with the number of videos."""
    schema = "video_path string, start_frame long, end_frame long"

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["start_frame", "end_frame"])
        right = right.sort_values("frame_no")
        if not len(left) or not len(right):
            return left[["video_path", "start_frame", "end_frame"]]
        vecs = np.array(right["vec"].tolist(), float)
        merged = merge_short(list(zip(left["start_frame"], left["end_frame"])), right["frame_no"].to_numpy(), vecs, shortest)
        return pd.DataFrame({"video_path": key[0], "start_frame": [a for a, _ in merged], "end_frame": [b for _, b in merged]})

    long = spans.select("video_path", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))
    return long.groupBy("video_path").cogroup(samples.select("video_path", "frame_no", "vec").groupBy("video_path")).applyInPandas(one, schema)


def build_scenes(samples: DataFrame, threshold: float = 0.85, order: int = 2, shortest: int = 7) -> DataFrame:
    """Samples to scenes with three vectors each."""
    return triplets(merge_short_scenes(scene_spans(boundaries(samples, threshold, order)), samples, shortest), samples)


def live_frames(frames: DataFrame, black: float | None = 10, black_pct: float = 98, white: float | None = None, white_pct: float = 98) -> DataFrame:
    """Frames (with ``pixels``, gray values) that are neither black nor white."""
    return frames.where(V.dead_frame("pixels", black, black_pct, white, white_pct).isNull())
