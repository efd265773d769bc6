"""Names by hand-derived expectations."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions import names as N
from reelspark.operators import clips as C

TS = "202601010000"
VIDEOS = {
    "[Judas] Anne Shirley - S01E01v2.mkv": "Anne Shirley_S01E01",
    "MyShow S1E1.mp4": "MyShow_S01E01",
    "Show Season 1 E01.mp4": "Show_S01E01",
    "Show season_1 E_01.mp4": "Show_S01E01",
    "Show - 05.mp4": "Show_E05",
    "[Group] Anime - 12 [1080p].mkv": "Anime_E12",
    "MyAnime NCOP2.mkv": "MyAnime_NCOP2",
    "Anime Opening Theme.mp4": "Anime_OP",
    "Show ED.mp4": "Show_ED",
    "Anime OVA.mp4": "Anime_OVA",
    "Anime OVA2.mp4": "Anime_OVA2",
    "Show Special 3.mp4": "Show_SP3",
    "Movie Film.mp4": "Movie_Movie",
    "Show PV2.mp4": f"Show_PV{TS}",
    "Anime MV.mp4": f"Anime_MV{TS}",
    "Show Trailer.mp4": f"Show_PV{TS}",
    "Random File.mp4": f"Random File_PV{TS}",
}


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_video_names(spark):
    got = column(spark, VIDEOS, lambda v: N.video_name(v, F.lit(TS)))
    assert dict(zip(VIDEOS, got)) == VIDEOS


def test_op_ed(spark):
    cases = {"show_op": True, "show_op01_x": True, "ncop": True, "ncop.mp4": False, "Show_OP1A": False, "S02OP": False, "aop": False, None: False}
    assert column(spark, cases, N.is_op_ed) == list(cases.values())


def test_result_name(spark):
    row = spark.createDataFrame([("恐怖", "城市", "男人", "奔跑", 1234, "Show_E05")], "a string, b string, c string, d string, f int, v string")
    form = "{情绪}_{场景}_{主体}_{动作}_{起始帧}_{视频解析名}"
    values = dict(zip(("情绪", "场景", "主体", "动作", "起始帧", "视频解析名"), map(F.col, "abcdfv")))
    assert row.select(N.result_name(form, values)).first()[0] == "恐怖_城市_男人_奔跑_1234_Show_E05"
    assert row.select(N.result_name(form, values | {"场景": F.lit(None)})).first()[0] == "恐怖_男人_奔跑_1234_Show_E05"
    assert row.select(N.label_key(F.lit("恐怖_城市_男人_奔跑_1234_Show_E05"), form)).first()[0] == "恐怖_城市_男人_奔跑"


def test_verdicts(spark):
    text = 'ok {"主体":"是","动作":"No"} end'
    assert column(spark, [text, "none", '{"主体": "不是"}', None], lambda v: N.verdicts(v, ["主体", "动作", "情绪"])) == [{"主体": True, "动作": False, "情绪": False}, None, {"主体": False, "动作": False, "情绪": False}, None]
    assert column(spark, ['{"主体": "不是"}'], lambda v: N.verdicts(v, ["主体"], exact=False)) == [{"主体": True}]
    with pytest.raises(Exception, match="JSON"):
        column(spark, ["none"], lambda v: N.verdicts(v, ["主体"], strict=True))


def test_clip_names(spark):
    got = column(spark, ["近景_孤独_女孩_分值7_Show_E05_1200_2", "a_b", "x_score3_S_E_77"], N.clip_parts)
    assert got[0].asDict() == {"series_name": "Show", "episode": "E05", "start_frame": "1200", "tags": ["近景", "孤独", "女孩"], "score": 7}
    assert got[1].tags == ["a", "b"] and got[1].score is None and got[1].series_name == ""
    assert got[2].tags == ["x"] and got[2].score == 3
    assert column(spark, ["近景_Show_E05_1200_2", "a_b_7", "a_9_b", "none"], N.clip_order) == [1200, 7, 9, 0]
    assert column(spark, ["近景", "孤独", "女孩", "zzz", "推"], N.tag_category) == ["shot_scale", "emotion", "subject", "other", "camera_movement"]


def test_merged_clip_name(spark):
    rows = [("f", "近景_孤独_女孩_分值7_Show_E05_1200", None), ("f", "近景_喜悦_分值9_Show_E05_1300", True), ("f", "无_Show_E06_1400", False)]
    clips = C.parsed(spark.createDataFrame(rows, "folder string, name string, same_as_previous boolean"))
    got = [r.merged_name for r in C.merged_names(C.subject_runs(clips), ["folder", "run"]).orderBy("run").collect()]
    assert got == ["近景_喜悦_孤独_女孩_分值9_Show_E05_1200", "无_Show_E06_1400"]


def test_answers(spark):
    assert column(spark, ["景别：【近景】\n情绪: 孤独\n主体：无\n", ""], N.answer_name) == ["近景_孤独", "未知"]
    assert column(spark, ["score 12", "3/10", "none", None], N.answer_score) == [10, 3, 4, 4]


def test_sanitise(spark):
    assert column(spark, [' a<b>:"/\\|?*c '], N.sanitise) == ["a_b________c"]
    assert column(spark, ["_a?_"], N.sanitise_result) == ["a"]
    assert column(spark, ["...", "a/b. "], N.sanitise_folder) == ["export", "a_b"]


def test_guessed_names(spark):
    rows = [("A S1 - 03", "B", 2, "4"), ("A S1 - 03", "", None, "4"), ("A - 03", None, None, "4.5"), ("A S2 NCOP1", "B", 2, "4"), ("A - 03", None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, t string, s int, e string")
    guessed = F.struct(F.col("t").alias("title"), F.col("s").alias("season"), F.col("e").alias("episode"))
    got = [r[0] for r in df.orderBy("i").select(N.video_name(F.concat("name", F.lit(".mkv")), F.lit(TS), guessed=guessed)).collect()]
    assert got == ["B_S02E04", "A_E04", "A_E4.5", "B_S02NCOP1", "A_E03"]
