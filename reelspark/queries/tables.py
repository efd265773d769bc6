"""Views of the driver's tables as frames, prompts, samples, clips and names; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated vocabulary: 24 prompts in four categories, which are searched for in all rows."""
    e = read(spark, sf_dir, "embeddings").where("vec_id < 24")
    return e.select(F.col("vec_id").cast("int").alias("prompt_idx"), F.concat(F.lit("c"), F.col("vec_id") % 4).alias("category"), F.col("embedding").alias("vec"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors a scene, eight scenes a video, three indexes; every seventh video is an opening."""
    e = read(spark, sf_dir, "embeddings")
    scene, video = F.floor(F.col("vec_id") / 3), F.floor(F.col("vec_id") / 24)
    start = ((scene % 8) * 100).cast("int")
    path = F.concat(F.lit("shows/ep"), video, F.when(video % 7 == 0, "_op").otherwise(""), F.lit(".mp4"))
    return e.select(
        F.concat(F.lit("s"), video % 3).alias("source_index"), path.alias("video_path"), start.alias("start_frame"), (start + 60 + (scene % 5) * 10).cast("int").alias("end_frame"),
        (F.col("vec_id") % 3).cast("int").alias("frame_idx"), F.col("embedding").alias("vec"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).groupBy("source_index", "video_path", "start_frame", "end_frame").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "vec"))).alias("v"))
    return rows.select("source_index", "video_path", "start_frame", "end_frame", F.transform("v", lambda x: x["vec"]).alias("features"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 50)).alias("video_path"), ((F.col("vec_id") % 50) * 5).alias("frame_no"), F.col("embedding").alias("vec"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scenes of a user's video; frames are minutes."""
    e = read(spark, sf_dir, "events")
    start = F.floor(F.unix_timestamp("ts") / 60)
    return e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id")).alias("video_path"), start.alias("start_frame"), (start + 1 + F.floor("value") % 30).alias("end_frame"),
        F.col("event_type").alias("label"), F.col("value").alias("similarity"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("scene_key"), (F.col("event_id") % 50).alias("prompt_idx"),
    )


FRAMES = """e AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings),
prompts AS (SELECT vec_id::INT AS prompt_idx, 'c' || (vec_id % 4) AS category, vec FROM e WHERE vec_id < 24),
frames AS (SELECT 's' || (vec_id // 24 % 3) AS source_index, 'shows/ep' || (vec_id // 24) || CASE WHEN vec_id // 24 % 7 = 0 THEN '_op' ELSE '' END || '.mp4' AS video_path,
  (vec_id // 3 % 8 * 100)::INT AS start_frame, (vec_id // 3 % 8 * 100 + 60 + vec_id // 3 % 5 * 10)::INT AS end_frame, (vec_id % 3)::INT AS frame_idx, vec FROM e)"""
S = "source_index, video_path, start_frame, end_frame"
SCORED = f"""scored AS (SELECT {S}, category, prompt_idx, frame_idx, 100 * list_inner_product(f.vec, p.vec) AS sim FROM frames f, prompts p),
per_prompt AS (SELECT {S}, category, prompt_idx, max(sim) AS sim, arg_max(frame_idx, sim) AS frame_idx FROM scored GROUP BY ALL),
best AS (SELECT * FROM per_prompt QUALIFY row_number() OVER (PARTITION BY {S}, category ORDER BY sim DESC, prompt_idx) = 1)"""
SAMPLES = """samples AS (SELECT 'v' || (vec_id // 50) AS video_path, vec_id % 50 * 5 AS frame_no, embedding::DOUBLE[] AS vec FROM embeddings),
pairs AS (SELECT *, lead(frame_no) OVER w AS next_frame, list_inner_product(vec, lead(vec) OVER w) AS sim FROM samples WINDOW w AS (PARTITION BY video_path ORDER BY frame_no)),
minima AS (SELECT *, coalesce(sim < min(sim) OVER (PARTITION BY video_path ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
  AND sim < min(sim) OVER (PARTITION BY video_path ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)
  AND count(sim) OVER (PARTITION BY video_path ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) = 2
  AND count(sim) OVER (PARTITION BY video_path ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) = 2, FALSE) AS is_min FROM pairs),
cuts AS (SELECT *, is_min AND sim < -0.1 AND count(sim) OVER (PARTITION BY video_path) > 4 AS cut FROM minima),
marked AS (SELECT video_path, frame_no, vec, sim, row_number() OVER (PARTITION BY video_path ORDER BY frame_no) = 1 OR CASE WHEN bool_or(cut) OVER (PARTITION BY video_path)
  THEN coalesce(lag(cut) OVER (PARTITION BY video_path ORDER BY frame_no), FALSE) ELSE coalesce(sim < -0.1, FALSE) END AS is_boundary FROM cuts),
numbered AS (SELECT *, sum(is_boundary::INT) OVER (PARTITION BY video_path ORDER BY frame_no) AS scene_no FROM marked),
spans AS (SELECT video_path, min(frame_no) AS start_frame, max(frame_no) AS end_frame FROM numbered GROUP BY video_path, scene_no HAVING max(frame_no) > min(frame_no))"""
CLIPS = """clips AS (SELECT event_id, 'u' || user_id AS video_path, floor(epoch(ts::TIMESTAMP) / 60)::BIGINT AS start_frame, floor(epoch(ts::TIMESTAMP) / 60)::BIGINT + 1 + floor(value)::BIGINT % 30 AS end_frame,
  event_type AS label, value AS similarity, lpad(event_id::VARCHAR, 12, '0') AS scene_key, event_id % 50 AS prompt_idx FROM events)"""
