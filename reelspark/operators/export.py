"""Plans of what to cut and under which name; cutting itself is a callable for each row of the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import frames as T
from ..functions import names as N


def clip_plan(rows: DataFrame, sources: DataFrame, existing: DataFrame, debug: bool = False) -> DataFrame:
    """target name and state of each result. rows: result_name, video_path, start_frame, end_frame, similarity, shot, movement;
    sources and existing: video_path, file_name. A source that is not there or a target that is there skips the row."""
    known = [F.when(F.coalesce(F.col(c), F.lit(N.UNKNOWN)) != N.UNKNOWN, F.col(c)) for c in ("shot", "movement")]
    prefix = [F.format_string("%.4f", "similarity")] if debug else []
    target = F.concat(F.concat_ws("_", *prefix, *known, N.sanitise(F.col("result_name"))), N.extension(F.col("video_path")))
    plan = rows.withColumn("target", target)
    plan = plan.join(sources.select("video_path").distinct().withColumn("_source", F.lit(True)), "video_path", "left")
    plan = plan.join(existing.select(F.col("file_name").alias("target")).distinct().withColumn("_there", F.lit(True)), "target", "left")
    state = F.when(F.col("_source").isNull(), "no_source").when(F.col("_there"), "exists").otherwise("cut")
    return plan.withColumn("state", state).drop("_source", "_there")


def export_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "cut").alias("to_cut"), F.count_if(F.col("state") == "exists").alias("skipped"), F.count_if(F.col("state") == "no_source").alias("failed"))


def numbered(rows: DataFrame, base: Column, ext: Column, order: list) -> DataFrame:
    """target: base and extension; equal names after the first get ``_1``, ``_2`` and so on, in order."""
    rows = rows.withColumns({"_base": base, "_ext": ext})
    n = F.row_number().over(Window.partitionBy("_base", "_ext").orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("target", F.concat(F.col("_base"), F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.col("_ext"))).drop("_base", "_ext", "_n")


def picked_clips(rows: DataFrame, stamp: Column) -> DataFrame:
    """target and problem of clips that a user picked (video_path, start_frame, end_frame, exists)."""
    whole = F.col("video_path").isNotNull() & (F.col("video_path") != "") & F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull()
    problem = F.when(~whole, "incomplete").when(~F.coalesce("exists", F.lit(False)), "missing")
    base = F.concat_ws("_", F.col("start_frame").cast("string"), N.video_name(F.col("video_path"), stamp))
    return numbered(rows.withColumn("problem", problem), base, N.extension(F.col("video_path")), ["problem", "end_frame", "video_path"])


def cut_interval(start: Column, end: Column, fps: Column, copy: bool, first: int = -2, last: int = 2) -> dict[str, Column]:
    """Seconds of a cut whose end is included; a copy only shifts its end, a new encoding both."""
    a = F.greatest(F.lit(0).cast("long"), start.cast("long") + (0 if copy else first))
    b = F.greatest(a + 1, end.cast("long") + last + 1)
    return {"cut_start": F.format_string("%.9f", T.seconds(a, fps)), "cut_end": F.format_string("%.9f", T.seconds(b, fps)), "cut_frames": b - a}


def segments(total: Column, size: int) -> Column:
    """array of (frame_offset, frame_count) that cover ``total`` frames."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total.cast("long") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    return F.when(total > 0, F.transform(starts, lambda s: F.struct(s.alias("frame_offset"), F.least(F.lit(size).cast("long"), total - s).alias("frame_count")))).otherwise(
        F.array().cast("array<struct<frame_offset:bigint,frame_count:bigint>>")
    )


def cache_name(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))


def run_plan(plan: DataFrame, cut: Callable[[Row], bool]) -> DataFrame:
    """Applies ``cut`` to rows of state ``cut`` on the executors: target, ok, error. A row that fails does not stop the rest."""

    def go(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append((row["target"], bool(cut(Row(**row))), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row["target"], False, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.bool_(), pa.string()))], ["target", "ok", "error"])

    return plan.where("state = 'cut'").mapInArrow(go, "target string, ok boolean, error string")


def run_ways(plan: DataFrame, ways: dict[str, Callable[[Row], bool]]) -> DataFrame:
    """Tries the ``ways`` to cut, in order, for each row of state ``cut``: target, way (the first that succeeds, null where none
    does), tried, error (of the last that failed). Ways are, say, copy, encode, direct and video only. What a row does not
    allow (columns of its own, such as ``has_audio``) is for the way to refuse by returning False."""

    def go(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                done, tried, error = None, 0, None
                for name, cut in ways.items():
                    tried += 1
                    try:
                        if cut(Row(**row)):
                            done = name
                            break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                out.append((row["target"], done, tried, error))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["target", "way", "tried", "error"])

    return plan.where("state = 'cut'").mapInArrow(go, "target string, way string, tried int, error string")


def frame_requests(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """video_path, frame_no of pictures to decode for (video_path, start_frame, end_frame, frame_idx), each once and only those
    that ``cached`` does not have."""
    wanted = rows.select("video_path", T.target_frame(F.col("start_frame"), F.col("end_frame"), F.col("frame_idx")).alias("frame_no")).distinct()
    return wanted.join(cached.select("video_path", "frame_no"), ["video_path", "frame_no"], "left_anti")
