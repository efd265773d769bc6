"""Scene tables: schema, writing, reading, vectors as halves of floats, and what a scan may leave out."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What names a scene. ``scene_key`` is for display alone, as equal file names in two folders have equal keys.
SCENE = ("source_index", "video_path", "start_frame", "end_frame")
SCHEMA = "source_index string, video_path string, start_frame int, end_frame int, fps float, feature_count int, features_blob binary"
#: Extensions of video files that are indexed, and of those that names are parsed for.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".avi", ".webm", ".flv")
NAME_EXTENSIONS = (*VIDEO_EXTENSIONS, ".wmv", ".m4v", ".mpg", ".mpeg", ".ts", ".m2ts", ".rmvb")


def scene_key(path: str | Column = "video_path", start: str | Column = "start_frame") -> Column:
    path, start = (F.col(c) if isinstance(c, str) else c for c in (path, start))
    return F.concat(start.cast("string"), F.lit("_"), F.regexp_extract(path, r"([^/\\]*)$", 1))


def encode(rows: DataFrame) -> DataFrame:
    """Scenes with ``features`` (array of vectors) as rows of SCHEMA: vectors as 16-bit floats in one binary. Scenes without vectors go."""
    rest = [c for c in rows.columns if c != "features"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", feature_count int, features_blob binary"

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("features")).to_pylist()
            blobs = [np.asarray(v, np.float32).astype("<f2").tobytes() if v else b"" for v in lists]
            kept = pa.array([bool(b) for b in blobs], pa.bool_())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(v or ()) for v in lists], pa.int32()), pa.array(blobs, pa.binary())], [*rest, "feature_count", "features_blob"]).filter(kept)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame) -> DataFrame:
    """Rows with feature_count and features_blob as rows with ``features``; the dimension is what the blob's length says."""
    rest = [c for c in rows.columns if c not in ("feature_count", "features_blob")]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", features array<array<float>>"
    rows = rows.where((F.col("feature_count") > 0) & (F.length("features_blob") > 0))

    def run(batches):
        for batch in batches:
            counts = batch.column(batch.schema.get_field_index("feature_count")).to_pylist()
            blobs = batch.column(batch.schema.get_field_index("features_blob")).to_pylist()
            lists = [np.frombuffer(b, "<f2").reshape(n, -1).astype(np.float32).tolist() for n, b in zip(counts, blobs)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.list_(pa.float32())))], [*rest, "features"])

    return rows.mapInArrow(run, schema)


def write_scenes(rows: DataFrame, path: str, resume: bool = True) -> None:
    """Appends scenes, in folders by index; without ``resume`` what is there goes first. Nothing is written where there are no rows."""
    rows.write.partitionBy("source_index").mode("append" if resume else "overwrite").parquet(path)


def read_scenes(spark: SparkSession, *paths: str, indexes: Sequence[str] | None = None) -> DataFrame:
    """Scenes of all paths; ``indexes`` prunes folders, and an index that is not there is an error."""
    rows = spark.read.parquet(*paths)
    if indexes is not None:
        rows = rows.where(F.col("source_index").isin(*indexes))
        missing = set(indexes) - {r[0] for r in rows.select("source_index").distinct().collect()}
        if missing:
            raise ValueError(f"no such index: {', '.join(sorted(missing))}")
    return rows


def frames_of(scenes: DataFrame) -> DataFrame:
    """A row for each vector of each scene: the scene's columns, frame_idx, vec."""
    rest = [c for c in scenes.columns if c != "features"]
    return scenes.select(*rest, F.posexplode("features").alias("frame_idx", "vec"))


def keyed_scenes(scenes: DataFrame, keys: DataFrame, on: Sequence[str] = SCENE[1:]) -> DataFrame:
    """Only the scenes that ``keys`` names; a semi join, which Spark broadcasts where the keys are measured as small."""
    return scenes.join(keys.select(*on).distinct(), list(on), "left_semi")


def indexed_videos(scenes: DataFrame) -> DataFrame:
    return scenes.select("video_path").distinct()


def new_videos(videos: DataFrame, scenes: DataFrame) -> DataFrame:
    """Videos that no scene has yet."""
    return videos.join(indexed_videos(scenes), "video_path", "left_anti")


def is_video(path: Column, extensions: Sequence[str] = VIDEO_EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)).isin(*extensions)


def find_videos(spark: SparkSession, folder: str, extensions: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """video_path and folder of the video files in a folder, or in the folders in it where it has none; sorted without case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("video_path"))
    files = files.where(is_video(F.col("video_path"), extensions)).distinct()
    root = folder.rstrip("/").split("://")[-1]
    inner = F.regexp_extract(F.col("video_path"), r"([^/]+)/[^/]+$", 1)
    files = files.withColumn("depth", F.size(F.split(F.substring_index(F.col("video_path"), root, -1), "/")) - 2).where("depth <= 1")
    top = files.agg(F.min("depth").alias("least"))
    return files.crossJoin(F.broadcast(top)).where("depth = least").select("video_path", inner.alias("folder")).orderBy(F.lower("video_path"))


def one_model(names: Column) -> Column:
    """An aggregate: the single model of all index names, or an error where there are several or none."""
    found = F.collect_set(names)
    return F.when((F.size(found) == 1) & (found[0] != ""), found[0]).otherwise(F.raise_error(F.concat(F.lit("indexes of one model are needed, not: "), F.array_join(F.array_sort(found), ", "))).cast("string"))


def same_dimension(frames: DataFrame, dim: int) -> DataFrame:
    return frames.where(F.size("vec") == dim)


def export_state(export: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds ``state``: unknown where ``videos`` does not have the path, missing where it says so, else present."""
    known = videos.select("video_path", F.col("exists").alias("_there"))
    state = F.when(F.col("_there").isNull(), "unknown").when(F.col("_there"), "present").otherwise("missing")
    return export.join(known, "video_path", "left").withColumn("state", state).drop("_there")
