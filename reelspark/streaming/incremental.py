"""Structured Streaming: frames that arrive become scenes once, candidates stay the best seen, events become sessions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import segment
from ..sources.scenes import SCENE

SAMPLES = "video_path string, frame_no long, vec array<float>"


def frame_stream(spark: SparkSession, folder: str, schema: str = SAMPLES, files: int | None = None) -> DataFrame:
    """Samples from Parquet files as they come; ``files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def index_new_videos(samples: DataFrame, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = segment.build_scenes) -> StreamingQuery:
    """Scenes of every video exactly once: a micro-batch leaves out videos that ``target`` has and writes the rest into a folder
    of its own number, which a repeated batch writes anew. A video's samples come in one file.

    The query takes what is there and ends."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        fresh = batch
        if fs.exists(root) and fs.listStatus(root):
            done = spark.read.parquet(target).where(F.col("batch") != number).select("video_path").distinct()
            fresh = batch.join(done, "video_path", "left_anti")
        build(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_best(scores: DataFrame, k: int, key: Sequence[str] = (*SCENE, "category")) -> DataFrame:
    """The best k prompts of each key over all that came so far, as an update for every key that a micro-batch touches:
    key, rank, prompt_idx, sim. State is k rows for each key; a prompt that comes again counts with its larger value."""
    kinds = dict(scores.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in key)

    def step(name, frames, state: GroupState):
        best = dict(state.get[0]) if state.exists else {}
        best = {int(p): float(s) for p, s in best.items()}
        for frame in frames:
            for prompt, sim in zip(frame["prompt_idx"], frame["sim"]):
                best[int(prompt)] = max(best.get(int(prompt), float("-inf")), float(sim))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        state.update((list(top),))
        out = pd.DataFrame({"rank": range(1, len(top) + 1), "prompt_idx": [p for p, _ in top], "sim": [s for _, s in top]})
        for column, value in zip(reversed(key), reversed(name)):
            out.insert(0, column, value)
        yield out

    return scores.groupBy(*key).applyInPandasWithState(step, f"{keys}, rank int, prompt_idx int, sim double", "best array<struct<prompt:int,sim:double>>", "update", GroupStateTimeout.NoTimeout)


def best_upserts(scores: DataFrame, k: int, target: str, checkpoint: str, key: Sequence[str] = (*SCENE, "category")) -> StreamingQuery:
    """The same without state: each micro-batch is reduced with what ``target`` held after the batch before it, and written to a
    folder of its own number; the highest number is the result."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*key, "prompt_idx", "sim")
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{target}/{number - 1}"))
        best = rows.groupBy(*key, "prompt_idx").agg(F.max("sim").alias("sim"))
        w = Window.partitionBy(*key).orderBy(F.desc("sim"), "prompt_idx")
        best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn").write.mode("overwrite").parquet(f"{target}/{number}")

    return scores.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """Events of a key that follow each other within ``gap`` as one row: start, end (last event and gap), count and mean. On a
    stream rows come when ``late`` has passed; on a table at once."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    grouped = marked.groupBy(key, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("events"), F.avg(value).alias("mean_value")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "mean_value")
