"""The three flows end to end: building an index, searching by a text, searching by all labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings, recall_threshold
from ..functions import names as N
from ..operators import refine, search, segment
from ..sources import scenes as S


def index_build(samples: DataFrame, known: DataFrame | None = None, source: Column | None = None, fps: Column | None = None, s: Settings = Settings()) -> DataFrame:
    """Samples of videos that ``known`` does not have as scenes with vectors."""
    fresh = samples if known is None else samples.join(known.select("video_path").distinct(), "video_path", "left_anti")
    built = segment.build_scenes(fresh, s.boundary_threshold, s.minima_order, s.min_scene)
    return built.select((source if source is not None else F.lit("")).alias("source_index"), "video_path", "start_frame", "end_frame", (fps if fps is not None else F.lit(25.0)).cast("float").alias("fps"), "features")


def text_search(scenes: DataFrame, query: DataFrame, s: Settings = Settings(), rerank: DataFrame | None = None, group: str = "source_index") -> DataFrame:
    """Matches of one query vector: recall threshold, optional second scores, near-copies on original frames, shifted frames,
    final threshold, by similarity."""
    frames = S.frames_of(scenes)
    found = search.query_scores(frames, query, s.logit_scale, recall_threshold(s.threshold, rerank is not None, s.rerank_weight))
    if rerank is not None:
        found = found.join(rerank, list(S.SCENE), "left")
        found = found.withColumn("similarity", F.coalesce(F.col("similarity") * (1 - s.rerank_weight) + F.col("score") * 100 * s.rerank_weight, "similarity")).drop("score")
    found = refine.with_features(search.above(found, s.threshold), scenes)
    order = [F.desc("similarity"), "video_path", "start_frame"]
    kept = refine.drop_near_copies(found, group, order, s.dedup_threshold, N.stem(F.col("video_path")))
    return search.by_similarity(search.matches(kept.drop("features"), start_offset=s.start_offset, end_offset=s.end_offset))


def label_search(scenes: DataFrame, prompts: DataFrame, s: Settings = Settings(), rerank: Callable[[DataFrame], DataFrame] | None = None, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scenes with all required labels: candidates of all prompts, the best of each category, threshold, grouped limit,
    intersection, near-copies of equal labels, adjacent scenes, verification.

    rerank: the shortlist to rows of scene, category, prompt_idx, score; verify: merged rows to those that stay."""
    found = search.candidates(S.frames_of(scenes), prompts.select("prompt_idx", "category", "vec"), s.candidates, s.logit_scale, None if rerank else s.threshold)
    if rerank:
        listed = search.shortlist(found, s.shortlist)
        best = search.reranked(listed, rerank(listed), s.rerank_weight)
    else:
        best = search.best_prompts(found).withColumn("similarity", F.col("sim"))
    best = search.grouped_top_k(search.above(best, s.threshold), s.top_k, s.search_mode)
    named = search.with_prompts(best, prompts)
    label = F.coalesce("label_cn", F.try_element_at("cat_cn", F.col("category")), F.lit("")) if "cat_cn" in prompts.columns else F.coalesce("label_cn", F.lit(""))
    whole = refine.intersect_categories(named.withColumn("label", label).select(*S.SCENE, "category", "similarity", "prompt_idx", "label"), s.required)
    whole = refine.with_features(whole.withColumn("label_key", F.array_join(F.map_values("labels_by_category"), "_")), scenes)
    whole = whole.withColumns({"scene_key": S.scene_key(), "group": F.md5(F.concat_ws("|", "source_index", "label_key"))})
    kept = refine.drop_near_copies(whole, "group", ["scene_key", "video_path", "end_frame"], s.dedup_threshold, N.stem(F.col("video_path"))).drop("features", "group")
    merged = refine.merge_adjacent(kept.withColumn("label", F.col("label_key")), s.merge_gap, ("label",), ("source_index", "video_path"))
    return verify(merged) if verify else merged
