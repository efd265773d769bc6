"""Vocabularies, prompt tables, stages, streams, seams and whole flows."""

import json
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelspark import seams
from reelspark.config import Settings
from reelspark.functions import paths
from reelspark.functions import arguments
from reelspark.operators import export, prompts, refine, search, shots
from reelspark.plans import retrieval, stages
from reelspark.sources import scenes as S
from reelspark.sources import vocabulary
from reelspark.streaming import incremental

TREE = {
    "标签": {"_note": "x", "主体": {"生物": {"狼": "wolf", "鸟": "bird"}, "物体": {"车": "car"}}, "动作": {"生物行为": {"跑": "running"}, "物理运动": {"碎": "crashing", "倒": "falling"}}, "情绪": {"所有情绪": {"恐怖": "scary"}}},
    "自动提纯prompt": {"_note": "x", "主体": [{"以{主体}": "with {主体}"}], "动作": [{"{生物}在{动作}": "a {生物} {动作}"}], "情绪": [{"{情绪}": "a {情绪} mood"}, {"{没有}": "{没有}"}]},
    "其他参数设置": {"必有标签": ["主体", "动作", "场景"], "MiniCPM验证Prompt": {"zh": {"_instruction": "q", "主体": "以{val}", "光": "y"}}},
}


def test_vocabulary(spark):
    v = vocabulary.Vocabulary.parse(json.dumps(TREE, ensure_ascii=False))
    assert v.categories == ["主体", "动作", "情绪"] and len(v.labels) == 7
    assert v.warnings() == ["required but not in the tree: 场景", "required but without a verification text: 动作", "verification text without a category: 光"]
    rows = {r.prompt_idx: r for r in prompts.prompt_table(spark, v).collect()}
    assert [rows[i].prompt for i in range(len(rows))] == ["with wolf", "with bird", "with car"] + [f"a {a} {m}" for a in ("wolf", "bird") for m in ("running", "crashing", "falling")] + ["a scary mood"]
    assert rows[3].label_cn is None and rows[3].labels == {"生物": "狼", "动作": "跑"} and rows[3].cat_cn == {"动作": "跑"} and rows[0].label_en == "wolf"
    counts = {r.category: r.n_prompts for r in prompts.prompt_counts(prompts.prompt_table(spark, v, "zh")).collect()}
    assert counts == {"主体": 3, "动作": 6, "情绪": 1}
    tree = spark.createDataFrame([(json.dumps(TREE["标签"] | {"_note": {}}, ensure_ascii=False),)], "json string")
    assert {tuple(r) for r in vocabulary.labels_from_json(tree).collect()} == set(v.labels)
    assert {(r.category, r.label_cn): r.ord for r in prompts.category_labels(v.label_rows(spark)).collect()}["动作", "倒"] == 2
    with pytest.raises(ValueError):
        vocabulary.Vocabulary.parse("{}")


def test_prompt_cache(spark, tmp_path):
    rows = spark.createDataFrame([(i, "c", [1.0, 0.0]) for i in range(5)], "prompt_idx int, category string, vec array<float>")
    stamp = vocabulary.cache_hash("text", "en")
    assert len(stamp) == 8 and stamp != vocabulary.cache_hash("text", "zh")
    assert tuple(vocabulary.prompt_info(rows).first()) == (5, 1, 2)
    assert vocabulary.write_prompts(rows, str(tmp_path), stamp) == 5
    assert vocabulary.read_prompts(spark, str(tmp_path), stamp, 5).count() == 5
    assert vocabulary.read_prompts(spark, str(tmp_path), "other") is None and vocabulary.read_prompts(spark, str(tmp_path), stamp, 6) is None


def test_scene_tables(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a.mp4", 0, 10, 25.0, [[1.0, 0.5], [0.25, 2.0]]), ("s2", "b.mp4", 5, 9, 25.0, [[0.1, 0.2]]), ("s2", "c.mp4", 5, 9, 25.0, [])], "source_index string, video_path string, start_frame int, end_frame int, fps float, features array<array<float>>")
    S.write_scenes(S.encode(rows), str(tmp_path))
    S.write_scenes(S.encode(rows.limit(1)), str(tmp_path))
    back = S.read_scenes(spark, str(tmp_path))
    assert back.count() == 3 and S.indexed_videos(back).count() == 2
    assert S.decode(back.where("video_path = 'a.mp4'")).first().features == [[1.0, 0.5], [0.25, 2.0]]
    assert "PartitionFilters: [isnotnull(source_index" in S.read_scenes(spark, str(tmp_path), indexes=["s2"])._jdf.queryExecution().toString() or S.read_scenes(spark, str(tmp_path), indexes=["s2"]).count() == 1
    with pytest.raises(ValueError):
        S.read_scenes(spark, str(tmp_path), indexes=["s9"])


def test_video_discovery(spark, tmp_path):
    for name in ("x/a.MP4", "x/b.txt", "y/c.mkv", "y/z/d.mkv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [(r.folder, r.video_path[-5:]) for r in S.find_videos(spark, str(tmp_path)).collect()] == [("x", "a.MP4"), ("y", "c.mkv")]
    (tmp_path / "top.avi").write_bytes(b"x")
    assert [r.video_path[-7:] for r in S.find_videos(spark, str(tmp_path)).collect()] == ["top.avi"]


def test_resume(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    for n, settings in ((3, {"a": 1}), (9, {"a": 1}), (4, {"a": 2})):
        got = stages.resumed(spark, str(tmp_path), "x", settings, partial(make, n)).count()
        assert got == {3: 3, 9: 3, 4: 4}[n]
    assert made == [3, 4]


def test_running_best(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "log"
    parts = [[("a", 1, 0.5), ("a", 2, 0.9), ("b", 1, 0.1)], [("a", 3, 0.7), ("a", 1, 0.8), ("b", 2, 0.1)]]
    last = {}
    for rows in parts:
        spark.createDataFrame(rows, "k string, prompt_idx int, sim double").coalesce(1).write.mode("append").parquet(str(source))
        stream = incremental.running_best(incremental.frame_stream(spark, str(source), "k string, prompt_idx int, sim double"), 2, ["k"])

        def keep(batch, _):
            for r in batch.collect():
                last[r.k, r["rank"]] = (r.prompt_idx, r.sim)

        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(out)).trigger(availableNow=True).start().awaitTermination()
    assert last == {("a", 1): (2, 0.9), ("a", 2): (1, 0.8), ("b", 1): (1, 0.1), ("b", 2): (2, 0.1)}


def test_stream_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:05:00", 3.0), (1, "2024-01-01 02:00:00", 5.0), (2, "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.sessions(incremental.frame_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp, value double"), "10 minutes", "1 hour")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.user_id, r.events, r.mean_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2, 2.0), (1, 1, 5.0)}  # the last one waits for later events
    assert incremental.sessions(df, "10 minutes", "1 hour").count() == 3


def test_seams(spark):
    rows = spark.createDataFrame([(1, "a", b"x"), (2, "b", None), (3, None, b"z")], "i int, t string, f binary")
    vecs = {r.i: r.vec for r in seams.encoded(rows, "t", partial(seams.hashed_encoder, 8)).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in vecs.values()) and len(vecs[1]) == 8
    scores = {r.i: r.score for r in seams.rerank_scores(rows.fillna("", ["t"]), "f", "t", lambda: seams.hashed_score).collect()}
    assert scores[2] is None and 0 <= scores[1] <= 1

    def ask():
        return lambda frames, questions: [q * 2 if q else "" for q in questions]

    assert {r.i: r.answer for r in seams.answered(rows, "f", "t", ask).collect()} == {1: "aa", 2: None, 3: ""}

    def look():
        def f(frames):
            if frames[0] == b"z":
                raise ValueError
            return [("近景", None)]

        return f

    assert {r.i: (r.shot, r.movement) for r in seams.analysed(rows, "f", look).collect()} == {1: ("近景", "未知"), 2: ("未知", "未知"), 3: ("未知", "未知")}


def test_frames_and_flow(spark):
    wanted = spark.createDataFrame([("a", 3), ("a", 3), ("a", 5), ("b", 1)], "video_path string, frame_no long")

    def load():
        return lambda path, frames: {n: f"{path}{n}".encode() for n in frames if n != 5}

    assert sorted(bytes(r.picture) for r in seams.decoded_frames(wanted, load).collect()) == [b"a3", b"b1"]
    rng = np.random.default_rng(1)
    before = rng.integers(0, 255, (24, 32), np.uint8)
    after = np.roll(before, 2, axis=1)
    pairs = spark.createDataFrame([("c", 0, bytearray(before.tobytes()), bytearray(after.tobytes()))], "clip string, pair_no long, before binary, after binary")
    cells = seams.flow_cells(pairs, lambda: seams.block_motion, 32, 24)
    stats = shots.flow_statistics(cells).first()
    assert stats.mean_dx > 0.7 and abs(stats.mean_dy) < 0.5
    vote = shots.pair_vote(shots.flow_statistics(cells)).first()
    assert vote.vote in shots.MOVEMENTS and 0 < vote.score <= 0.95


def plain_statistics(dx, dy, g=5):
    h, w = dx.shape
    mag = np.hypot(dx, dy)
    cells = np.array([[mag[y * (h // g) : (y + 1) * (h // g) if y < g - 1 else h, x * (w // g) : (x + 1) * (w // g) if x < g - 1 else w].mean() for x in range(g)] for y in range(g)])
    left, right, top, bot = dx[:, : w // 2].mean(), dx[:, w // 2 :].mean(), dy[: h // 2].mean(), dy[h // 2 :].mean()
    my, mx = int(h * 0.15), int(w * 0.15)
    strips = [np.s_[:my, :], np.s_[h - my :, :], np.s_[:, :mx], np.s_[:, w - mx :]]
    edge = np.mean([mag[s].mean() for s in strips])
    ex, ey = abs(np.mean([dx[s].mean() for s in strips])), abs(np.mean([dy[s].mean() for s in strips]))
    return {
        "mean_mag": mag.mean(), "push_score": ((right - left) + (bot - top)) / 2, "pan_score": (left + right) / 2, "tilt_score": (top + bot) / 2, "tracking_cv": cells.std() / cells.mean(),
        "edge_mag": edge, "center_edge_ratio": mag[my : h - my, mx : w - mx].mean() / max(edge, 1e-8), "edge_consistency": max(ex, ey) / (ex + ey),
    }


def test_flow_statistics_equal_numpy(spark):
    rng = np.random.default_rng(2)
    dx, dy = rng.normal(size=(23, 31)), rng.normal(1, 1, size=(23, 31))
    rows = pd.DataFrame([("c", 0, x, y, dx[y, x], dy[y, x]) for y in range(23) for x in range(31)], columns=["clip", "pair_no", "x", "y", "dx", "dy"])
    got = shots.flow_statistics(spark.createDataFrame(rows)).first()
    for key, value in plain_statistics(dx, dy).items():
        assert abs(got[key] - value) < 1e-9, key


def test_text_flow_dedups_on_original_frames(spark):
    rows = spark.createDataFrame([("s", "a.mp4", 0, 10, [[1.0, 0.0]]), ("s", "b.mp4", 0, 10, [[1.0, 0.0]]), ("s", "c.mp4", 0, 10, [[0.6, 0.8]]), ("s", "d.mp4", 0, 10, [[0.0, 1.0]])], "source_index string, video_path string, start_frame int, end_frame int, features array<array<double>>")
    query = spark.createDataFrame([([1.0, 0.0],)], "qvec array<double>")
    got = retrieval.text_search(rows, query, Settings(threshold=21)).collect()
    answer = json.loads(search.as_json(retrieval.text_search(rows, query, Settings(threshold=21)), {"model_used": "clip"}).first().json)
    assert [m["video_path"] for m in answer["matches"]] == ["a.mp4", "c.mp4"] and answer["model_used"] == "clip"
    assert [(r.video_path, r.start_frame, r.end_frame, r.similarity) for r in got] == [("a.mp4", 0, 12, 100.0), ("c.mp4", 0, 12, 60.0)]


def test_intersection(spark):
    rows = spark.createDataFrame([("s", "v", i, i + 1, c, float(n), n, f"l{n}") for i, cats in enumerate(["ABCD", "ABC"]) for n, c in enumerate(cats)], "source_index string, video_path string, start_frame int, end_frame int, category string, similarity double, prompt_idx int, label string")
    got = refine.intersect_categories(rows, list("ABCD")).collect()
    assert [(r.start_frame, r.similarity, r.category) for r in got] == [(0, 3.0, "D")]
    assert refine.intersect_categories(rows.where("category = 'A'"), list("ABCD")).count() == 2
    maps = spark.createDataFrame([(1, 1, {"a": "x"}), (1, 2, {"a": "y", "b": "z"})], "k int, o int, m map<string,string>")
    assert refine.merge_maps(maps, ["k"], "m", ["o"]).first().m == {"a": "x", "b": "z"}
    assert refine.merge_maps(maps, ["k"], "m", ["o"], first=False).first().m == {"a": "y", "b": "z"}


def test_limit_modes(spark):
    rows = spark.createDataFrame([("s", f"v{i % 2}", i, i + 1, "A", float(i)) for i in range(6)], "source_index string, video_path string, start_frame int, end_frame int, category string, similarity double")
    assert [search.grouped_top_k(rows, 2, m).count() for m in (-1, 0, 1, 7)] == [4, 2, 2, 2] and search.grouped_top_k(rows, None).count() == 6


def test_export(spark):
    plan = spark.createDataFrame([("a", "cut"), ("b", "cut"), ("c", "exists")], "target string, state string")

    def cut(row):
        if row.target == "b":
            raise OSError("no")
        return True

    assert sorted((r.target, r.ok, r.error) for r in export.run_plan(plan, cut).collect()) == [("a", True, None), ("b", False, "no")]
    rows = spark.createDataFrame([("/x/Show - 05.mp4", 10, 20, True), ("/y/Show - 05.mp4", 10, 30, True), (None, 1, 2, True), ("/z.mp4", 1, 2, False)], "video_path string, start_frame int, end_frame int, exists boolean")
    got = export.picked_clips(rows, F.lit("0")).collect()
    assert sorted(r.target for r in got if r.problem is None) == ["10_Show_E05.mp4", "10_Show_E05_1.mp4"]
    assert {r.problem for r in got} == {None, "incomplete", "missing"}


def test_paths(tmp_path):
    assert paths.resolve('"a/b"', str(tmp_path)) == str(tmp_path / "a" / "b")
    assert paths.resolve("/x/../y", str(tmp_path)) == "/y" and paths.resolve("", str(tmp_path)) == str(tmp_path)
    assert paths.resolve("hdfs://h/a", str(tmp_path)) == "hdfs://h/a"


def test_frame_requests(spark):
    rows = spark.createDataFrame([("a", 0, 10, 0), ("a", 0, 10, 1), ("a", 0, 10, 1), ("a", 0, 10, 2), ("b", 4, 9, 7)], "video_path string, start_frame int, end_frame int, frame_idx int")
    cached = spark.createDataFrame([("a", 10)], "video_path string, frame_no long")
    assert sorted(map(tuple, export.frame_requests(rows, cached).collect())) == [("a", 0), ("a", 5), ("b", 6)]


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            return self.value or default

    class Session:
        conf = Conf("hdfs://h/shared/")

    assert stages.shared_dir(Session) == "hdfs://h/shared"
    Session.conf = Conf(None)
    monkeypatch.setattr(stages, "OWN", [])
    first = stages.shared_dir(Session)
    assert first == stages.shared_dir(Session) and "reelspark-" in first


def test_ways_to_cut(spark):
    plan = spark.createDataFrame([("a", "cut", 1), ("b", "cut", 2), ("c", "cut", 3), ("d", "exists", 1)], "target string, state string, n int")

    def copy(row):
        if row.n > 1:
            raise OSError("no copy")
        return True

    ways = {"copy": copy, "encode": lambda row: row.n == 2, "video only": lambda row: False}
    assert sorted((r.target, r.way, r.tried, r.error) for r in export.run_ways(plan, ways).collect()) == [("a", "copy", 1, None), ("b", "encode", 2, "no copy"), ("c", None, 3, "no copy")]


def test_arguments(spark):
    assert arguments.encoder("h264", "slow") == (None, "h264", "slow")
    assert arguments.encoder("HEVC", "fast", "qsv") == ("qsv", "hevc_qsv", "fast")
    crf = F.lit(23)
    got = spark.range(1).select(arguments.quality_arguments(crf, "libx264"), arguments.quality_arguments(crf, "libx264", "cuda"), arguments.quality_arguments(crf, "h264_amf", "amf"), arguments.filter_path(F.lit("a\\b'[1]"))).first()
    assert got[0] == ["-crf", "23"] == got[1] and got[2] == ["-rc", "cqp", "-qp_i", "23", "-qp_p", "23", "-qp_b", "23"]
    assert got[3] == "'a/b'\\''\\[1\\]'"
