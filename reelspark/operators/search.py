"""Prompts against scenes: scores, candidates, best prompts, thresholds, grouped limits, reranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as T
from ..functions import vectors as V
from ..plans.stages import stored
from ..sources.scenes import SCENE

#: Bytes of prompt vectors that one pass sends to the tasks; more prompts take more passes.
PROMPT_BYTES = 128 << 20


def query_scores(frames: DataFrame, query: DataFrame, scale: float = 100.0, threshold: float | None = None, scene: Sequence[str] = SCENE) -> DataFrame:
    """Scenes with similarity, the largest product of ``query`` (a row: qvec) with a vector of the scene, times ``scale``.

    Vectors of another length than the query's are left out. A threshold drops vectors in the task that multiplies them,
    which changes nothing for a largest value."""
    one = query.select(F.lit(0).alias("prompt_idx"), F.lit("query").alias("category"), F.col("qvec").alias("vec"))
    return prompt_scores(frames, one, scale, None, threshold, scene).groupBy(*scene).agg(F.max("sim").alias("similarity"))


def prompt_scores(frames: DataFrame, prompts: DataFrame, scale: float = 100.0, per_category: int | None = None, threshold: float | None = None, scene: Sequence[str] = SCENE) -> DataFrame:
    """Products of all frames with all prompts as matrix products in the tasks: scene, frame_idx, category, prompt_idx, sim.

    prompts: prompt_idx, category, vec. The prompt matrix goes to the tasks in parts of PROMPT_BYTES, so its size is
    bounded whatever the vocabulary's. per_category: only the best so many prompts of a category leave a frame; every
    prompt that is among the best for its scene is among the best for the frame where it has its largest value, so the
    scene's best are whole. Ties at the limit all leave."""
    spark = frames.sparkSession
    sized = prompts.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    blocks = max(1, -(-sized["n"] * max(1, sized["dim"]) * 8 // PROMPT_BYTES))
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in scene) + ", frame_idx int, category string, prompt_idx int, sim double"
    out = None
    for block in range(blocks):
        part = prompts.where(F.col("prompt_idx") % blocks == block).select("prompt_idx", F.coalesce("category", F.lit("?")).alias("category"), "vec")
        rows = sorted(part.collect(), key=lambda r: (r["category"], r["prompt_idx"]))
        matrix = np.array([r["vec"] for r in rows], float).reshape(len(rows), -1)
        index = np.array([r["prompt_idx"] for r in rows], np.int32)
        names = [r["category"] for r in rows]
        cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        sent = spark.sparkContext.broadcast((matrix, index, [(names[a], a, b) for a, b in zip(cuts, cuts[1:])]))

        def run(batches, sent=sent):
            matrix, index, groups = sent.value
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("vec"))
                sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
                good = np.flatnonzero(sizes == matrix.shape[1])
                for at in range(0, len(good), 2048):
                    rows_ = good[at : at + 2048]
                    vecs = column.take(pa.array(rows_)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows_), -1)
                    scores = vecs @ matrix.T * scale
                    for name, a, b in groups:
                        mine = scores[:, a:b]
                        keep = np.ones(mine.shape, bool) if threshold is None else mine >= threshold
                        if per_category is not None and per_category < b - a:
                            keep &= mine >= np.partition(mine, b - a - per_category, axis=1)[:, b - a - per_category, None]
                        x, y = np.nonzero(keep)
                        if len(x):
                            take = pa.array(rows_[x])
                            columns = [batch.column(batch.schema.get_field_index(c)).take(take) for c in (*scene, "frame_idx")]
                            columns[-1] = columns[-1].cast(pa.int32())
                            yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(x)), pa.array(index[a:b][y]), pa.array(mine[x, y])], [*scene, "frame_idx", "category", "prompt_idx", "sim"])

        found = frames.select(*scene, "frame_idx", "vec").mapInArrow(run, schema)
        if blocks > 1:
            # a part is multiplied and let go before the next one goes out
            found = stored(found, "scores")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def candidates(frames: DataFrame, prompts: DataFrame, k: int = 50, scale: float = 100.0, threshold: float | None = None, scene: Sequence[str] = SCENE) -> DataFrame:
    """The best k prompts of each scene and category: scene, category, prompt_idx, frame_idx, sim. A prompt counts with its
    best frame, of equals the first; prompts of equal value go by number. The result does not depend on how prompts are
    dealt into passes."""
    # dealt by scene and category once: grouping, ranking and what ranks the result again need no further exchange
    scored = prompt_scores(frames, prompts, scale, k, threshold, scene).repartition(*scene, "category")
    best = scored.groupBy(*scene, "category", "prompt_idx").agg(F.max("sim").alias("sim"), F.max_by("frame_idx", F.struct("sim", -F.col("frame_idx"))).alias("frame_idx"))
    w = Window.partitionBy(*scene, "category").orderBy(F.desc("sim"), "prompt_idx")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def best_prompts(found: DataFrame, scene: Sequence[str] = SCENE, value: str = "sim") -> DataFrame:
    """The best candidate of each scene and category; of equals the lowest prompt_idx."""
    w = Window.partitionBy(*scene, "category").orderBy(F.desc(value), "prompt_idx")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def best_frames(found: DataFrame, scene: Sequence[str] = SCENE) -> DataFrame:
    """Each scene's best frame and value over all its candidates; of equals the lowest prompt and frame."""
    order = F.struct("sim", -F.col("prompt_idx"), -F.col("frame_idx"))
    return found.groupBy(*scene).agg(F.max_by("frame_idx", order).alias("best_frame_idx"), F.max("sim").alias("best_sim"))


def above(rows: DataFrame, threshold: float, value: str = "similarity") -> DataFrame:
    return rows.where(F.col(value) >= threshold)


def shortlist(found: DataFrame, k: int = 3, scene: Sequence[str] = SCENE) -> DataFrame:
    """The k candidates of each scene and category that a reranker sees."""
    w = Window.partitionBy(*scene, "category").orderBy(F.desc("sim"), "prompt_idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reranked(listed: DataFrame, scores: DataFrame, weight: float, scene: Sequence[str] = SCENE) -> DataFrame:
    """The best of each scene and category by the blend of similarity and rerank score (scene, category, prompt_idx, score);
    what has no score keeps its similarity."""
    both = listed.join(scores, [*scene, "category", "prompt_idx"], "left")
    return best_prompts(both.withColumn("similarity", V.blended(F.col("sim"), F.col("score"), weight)), scene, "similarity")


def grouped_top_k(rows: DataFrame, k: int | None, mode: int = 1, scene: Sequence[str] = SCENE) -> DataFrame:
    """The k best rows of each video (mode -1), index (0) or overall (any other). Rows are results of a scene and category,
    so a limit can part the categories of a scene. Order: similarity, video, start frame, scene key, category."""
    if not k:
        return rows
    order = [F.desc("similarity"), "video_path", "start_frame", "source_index", "end_frame", "category"]
    if mode not in (-1, 0):
        return rows.orderBy(*order).limit(k)
    w = Window.partitionBy("video_path" if mode == -1 else "source_index").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def with_prompts(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds what prompts say; taken after limits, so only rows that stay carry texts."""
    return rows.join(prompts.drop("vec", "category"), "prompt_idx", "left")


def matches(scores: DataFrame, fps: Column | float = 25.0, start_offset: int = 0, end_offset: int = 0) -> DataFrame:
    """Scenes as matches: shifted frames, their originals, length in frames and seconds, display and time codes, similarity
    to four places."""
    fps = F.lit(fps) if isinstance(fps, float | int) else fps
    start, end = T.shifted_start(F.col("start_frame"), start_offset), T.shifted_end(F.col("start_frame"), F.col("end_frame"), start_offset, end_offset)
    length = end - start
    return scores.withColumns(
        {
            "original_start": F.col("start_frame").cast("long"),
            "original_end": F.col("end_frame").cast("long"),
            "start_frame": start,
            "end_frame": end,
            "duration_frames": length,
            "duration_seconds": F.round(T.seconds(length, fps), 2),
            "duration_display": T.duration_text(T.seconds(length, fps)),
            "start": T.timecode(T.seconds(start, fps)),
            "end": T.timecode(T.seconds(end, fps)),
            "similarity": F.round("similarity", 4),
        }
    )


def with_video_facts(rows: DataFrame, videos: DataFrame, fps: float = 25.0) -> DataFrame:
    """Adds fps, width and height of each row's video. videos: video_path, fps, width, height; of several rows of a path the
    one with the largest values counts. Unknown videos, and rates that are null or not positive, take ``fps``."""
    best = F.max(F.struct("fps", "width", "height"))
    facts = videos.groupBy("video_path").agg(best.alias("v")).select("video_path", "v.*")
    joined = rows.drop("fps", "width", "height").join(facts, "video_path", "left")
    return joined.withColumn("fps", F.when(F.col("fps") > 0, F.col("fps").cast("double")).otherwise(F.lit(fps)))


def by_similarity(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("similarity"), "source_index", "video_path", "start_frame")


def checked_head(rows: DataFrame, scores: DataFrame, k: int, threshold: float, key: Sequence[str] = SCENE) -> DataFrame:
    """The first k matches, checked by a second model's scores (key, score): those under the threshold go, those over it gain
    50 times the score, those without a score stay as they are. Rows after the first k are not returned."""
    head = rows.orderBy(F.desc("similarity"), *key).limit(k)
    both = head.join(scores, list(key), "left").withColumn("score", V.unit_score(F.col("score")))
    return both.where(F.col("score").isNull() | (F.col("score") >= threshold)).withColumn("similarity", F.coalesce(F.col("similarity") + 50 * F.col("score"), "similarity"))


def as_json(rows: DataFrame, facts: dict[str, str] | None = None) -> DataFrame:
    """One row ``json``: matches by similarity and the given facts. It is an answer to a user, so rows should be limited before."""
    order = F.struct(-F.col("similarity"), "video_path", "start_frame")
    listed = F.array_sort(F.collect_list(F.struct(order.alias("k"), F.struct(*rows.columns).alias("v"))))
    return rows.agg(F.to_json(F.struct(F.transform(listed, lambda x: x["v"]).alias("matches"), *[F.lit(v).alias(k) for k, v in (facts or {}).items()])).alias("json"))
