"""Clips by name: order, tags, runs of one subject, names of merged clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def parsed(clips: DataFrame, name: str = "name") -> DataFrame:
    """Clips with series_name, episode, start_frame, tags, score and sort_frame."""
    parts = N.clip_parts(F.col(name))
    return clips.withColumn("_p", parts).select("*", "_p.*", N.clip_order(F.col(name)).alias("sort_frame")).drop("_p")


def classified(clips: DataFrame) -> DataFrame:
    """A row for each tag of each clip, with its category."""
    return clips.withColumn("tag", F.explode("tags")).withColumn("tag_category", N.tag_category(F.col("tag")))


def subject_runs(clips: DataFrame, same: str = "same_as_previous", part: str = "folder", order: tuple[str, ...] = ("sort_frame", "name")) -> DataFrame:
    """Adds run: clips of a folder in order belong together while ``same`` says the subject is that of the clip before."""
    w = Window.partitionBy(part).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.coalesce(F.col(same), F.lit(False)), 0).otherwise(1)
    return clips.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_names(clips: DataFrame, keys: list[str], order: tuple[str, ...] = ("sort_frame", "name")) -> DataFrame:
    """Name of each run: distinct tags by category and in it by name, the highest score, series and episode of the first clip,
    the earliest start frame; clips of a run alone keep their own name."""
    first = F.struct(*order)
    base = clips.groupBy(*keys).agg(
        F.min_by("series_name", first).alias("series_name"), F.min_by("episode", first).alias("episode"), F.min_by("name", first).alias("first_name"),
        F.min(F.col("start_frame").try_cast("long")).alias("start"), F.max("score").alias("score"), F.count("*").alias("members"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
    )
    tags = F.filter("tags", lambda t: (t != "") & (t != N.NONE_TAG))

    def of(category: str) -> F.Column:
        return F.filter(tags, lambda t: N.tag_category(t) == F.lit(category))

    ordered = F.flatten(F.array(*map(of, N.TAG_ORDER)))
    parts = F.concat(ordered, F.filter(F.array(F.concat(F.lit(N.SCORE_TAG), F.col("score").cast("string")), "series_name", "episode", F.col("start").cast("string")), lambda v: v.isNotNull() & (v != "")))
    return base.select(*keys, "members", F.when(F.col("members") == 1, F.col("first_name")).otherwise(F.array_join(parts, "_")).alias("merged_name"))


def renamed(clips: DataFrame) -> DataFrame:
    """new_name from an analysis: the scene's name, the score and the old name. clips: name, analysis, score_text, ext."""
    return clips.withColumn("new_name", F.concat(F.concat_ws("_", N.answer_name(F.col("analysis")), F.concat(F.lit(N.SCORE_TAG), N.answer_score(F.col("score_text")).cast("string")), "name"), F.col("ext")))
