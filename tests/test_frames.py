"""Frame arithmetic and segmentation by hand-derived expectations and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark import config
from reelspark.functions import frames as T
from reelspark.functions import vectors as V
from reelspark.operators import refine, search, segment, shots


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_times(spark):
    assert one(spark, T.timecode(F.lit(3661.5)), T.duration_text(F.lit(3661.5)), T.duration_text(F.lit(59.9)), T.timecode(F.lit(-1.0))) == ("01:01:01.500", "01:01:01", "00:59", "00:00:00.000")
    assert one(spark, T.seconds(F.lit(50), F.lit(0.0)), T.rational_seconds(F.lit(24), F.lit(24000), F.lit(1001))) == (2.0, "1.001000000")


def test_offsets_and_plans(spark):
    for (s, e), want in {(1, 1): (0, 3), (10, 20): (8, 22)}.items():
        assert one(spark, T.shifted_start(F.lit(s), -2), T.shifted_end(F.lit(s), F.lit(e), -2, 2)) == want
    plan = lambda a, b: one(spark, T.window_plan(F.lit(a), F.lit(b)))[0]
    assert plan(100, 110) == list(range(100, 110)) and plan(0, 100) == list(range(35, 65)) and plan(7, 7) == [7]
    assert one(spark, T.even_picks(F.lit(10), 5), T.even_picks(F.lit(3), 5)) == ([0, 2, 4, 6, 9], [0, 1, 2])


def test_sizes(spark):
    assert one(spark, *T.scaled(F.lit(1920), F.lit(1080), 256), *T.scaled(F.lit(1920), F.lit(1080), 256, True)) == (454, 256, 456, 256)
    assert one(spark, T.frame_count(F.lit(0), F.lit(2.0), F.lit(25.0), F.lit(7)), T.frame_count(F.lit(0), F.lit(0.0), F.lit(25.0), F.lit(7))) == (50, 7)


def test_scores(spark):
    assert one(spark, V.blended(F.lit(20.0), F.lit(0.8), 0.6), V.boosted(F.lit(20.0), F.lit(85.0)), V.boosted(F.lit(20.0), F.lit(0.85))) == (56.0, 62.5, 62.5)
    assert config.threshold_for("ViT-clip", True, weight=1) == 51 and config.threshold_for("fgclip2") == 14
    assert config.recall_threshold(21, True, 0.6) == 10.5 and config.recall_threshold(21, False, 0.6) == 21
    assert [config.optional_int(x) for x in (None, "auto", "默认", 0, "7", -1)] == [None, None, None, None, 7, None]


def samples(spark, sims, step=5):
    """Vectors in a plane whose neighbours have the given products."""
    angle, rows = 0.0, [("v", 0, [1.0, 0.0])]
    for i, s in enumerate(sims):
        angle += float(np.arccos(s))
        rows.append(("v", (i + 1) * step, [float(np.cos(angle)), float(np.sin(angle))]))
    return spark.createDataFrame(rows, "video_path string, frame_no long, vec array<double>")


def spans(df):
    return sorted((r.start_frame, r.end_frame) for r in df.collect())


def test_boundaries(spark):
    s = samples(spark, [0.99, 0.98, 0.40, 0.97, 0.99, 0.96, 0.30, 0.95, 0.99])
    assert spans(segment.scene_spans(segment.boundaries(s))) == [(0, 10), (15, 30), (35, 45)]
    s = samples(spark, [0.5, 0.9, 0.9])
    assert spans(segment.scene_spans(segment.boundaries(s))) == [(0, 15)] or spans(segment.scene_spans(segment.boundaries(s))) == [(5, 15)]


def test_triplets(spark):
    rows = spark.createDataFrame([("v", i, [float(i)]) for i in range(0, 40, 10)], "video_path string, frame_no long, vec array<double>")
    for (a, b), want in {(0, 30): [0, 20, 30], (0, 20): [0, 10, 20], (0, 10): [0, 5, 10], (10, 10): [10, 10, 10], (50, 60): [0, 0, 0]}.items():
        scene = spark.createDataFrame([("v", a, b)], "video_path string, start_frame long, end_frame long")
        assert [x[0] for x in segment.triplets(scene, rows).first().features] == want


def test_short_merge():
    frames = np.arange(0, 50, 5)
    vecs = np.tile([1.0, 0.0], (10, 1))
    assert segment.merge_short([(0, 5), (10, 30), (35, 45)], frames, vecs, 7) == [(0, 30), (35, 45)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.integers(0, 20))
def test_short_merge_keeps_frames(lengths, seed):
    rng = np.random.default_rng(seed)
    at, scenes = 0, []
    for n in lengths:
        scenes.append((at, at + (n - 1) * 5))
        at += n * 5
    frames = np.arange(0, at, 5)
    merged = segment.merge_short(scenes, frames, rng.normal(size=(len(frames), 3)), 7)
    assert merged[0][0] == 0 and merged[-1][1] == scenes[-1][1]
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))


def greedy(items, threshold):
    kept = []
    for i, (video, v) in enumerate(items):
        if all(items[j][0] == video or float(np.dot(items[j][1], v)) <= threshold for j in kept):
            kept.append(i)
    return kept


def test_greedy_dedup(spark):
    rng = random.Random(3)
    items = []
    for i in range(60):
        v = np.array([rng.gauss(0, 1) for _ in range(3)])
        items.append((f"v{rng.randrange(9)}", v / np.linalg.norm(v)))
    rows = spark.createDataFrame([("s", v, i, i + 1, [x.tolist()]) for i, (v, x) in enumerate(items)], "source_index string, video_path string, start_frame int, end_frame int, features array<array<double>>")
    got = sorted(r.start_frame for r in refine.drop_near_copies(rows, "source_index", ["start_frame"], 0.6).collect())
    assert got == greedy(items, 0.6)
    again = refine.drop_near_copies(rows.where(F.col("start_frame").isin(got)), "source_index", ["start_frame"], 0.6)
    assert again.count() == len(got)


def test_greedy_blocks(spark, monkeypatch):
    monkeypatch.setattr(refine, "BLOCK", 7)
    test_greedy_dedup(spark)


def near(items, threshold):
    """Pairs (a, b) -> best product, by plain loops; items: (group, ord, video, vectors)."""
    out = {}
    for g, i, v, xs in items:
        for h, j, w, ys in items:
            if g == h and i < j and v != w:
                best = [float(np.dot(x, y)) for x in xs or [] for y in ys or [] if x and len(x) == len(y)]
                best = [s for s in best if s > threshold]
                if best:
                    out[g, i, j] = max(best)
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.0, -0.5, 3.0])
def test_conflicts_equal_plain_loops(spark, monkeypatch, threshold):
    """Vectors of any length, several a scene, of two dimensions, empty, null and not finite."""
    monkeypatch.setattr(refine, "BLOCK", 6)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 4))
    items = []
    for i in range(90):
        xs = [(centres[i % 5] * rng.choice([0.3, 1.0]) + rng.normal(size=4) * 0.1).tolist() for _ in range(i % 3 + 1)]
        items.append((f"g{i % 2}", i, f"v{i % 7}", xs if i % 11 else [x[:2] for x in xs]))
    items += [("g0", 90, "w", [[float("nan")] * 4]), ("g0", 91, "w", []), ("g0", 92, "w", None), ("g0", 93, "w", [[]])]
    rows = spark.createDataFrame(items, "grp string, ord long, video_path string, features array<array<double>>")
    got = {(r.grp, r.a, r.b): r.sim for r in refine.conflicts(rows, "grp", threshold).collect()}
    wanted = near([x for x in items if x[1] != 90], threshold)
    assert set(got) == set(wanted)
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    none = rows.where("false")
    assert refine.conflicts(none, "grp", threshold).count() == 0


def test_blocks_far_apart_do_not_meet(spark, monkeypatch):
    """64 sets of near copies far from each other: blocks grow with the rows, and each meets only a few."""
    monkeypatch.setattr(refine, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(64, 16))
    x = np.repeat(centres, 20, axis=0) + rng.normal(size=(1280, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([("g", i, f"v{i}", [v.tolist()]) for i, v in enumerate(x)], "grp string, ord long, video_path string, features array<array<double>>")
    vectors = refine.placed(rows, "grp").cache()
    blocks = vectors.select("blk").distinct().count()
    pairs = refine.block_pairs(vectors, 0.95).count()
    assert blocks >= 64 and pairs < 4 * blocks < blocks * blocks / 8
    found = refine.conflicts(rows, "grp", 0.95).count()
    assert found == int((np.triu(x @ x.T, 1) > 0.95).sum())


def test_missing_vectors_stay(spark):
    rows = spark.createDataFrame([("s", "a", 0, 1, None), ("s", "b", 0, 1, [[1.0]]), ("s", "c", 0, 1, [[1.0]])], "source_index string, video_path string, start_frame int, end_frame int, features array<array<double>>")
    assert sorted(r.video_path for r in refine.drop_near_copies(rows, "source_index", ["video_path"]).collect()) == ["a", "b"]


def test_adjacent_merge(spark):
    rows = spark.createDataFrame([("v", 0, 10, 1.0, "a"), ("v", 12, 20, 3.0, "b"), ("v", 23, 30, 5.0, "a"), ("w", 0, 5, 1.0, None)], "video_path string, start_frame int, end_frame int, similarity double, label string").withColumn("scene_key", F.col("start_frame").cast("string"))
    got = {(r.video_path, r.start_frame): (r.end_frame, r.similarity, r.label) for r in refine.merge_adjacent(rows, 2).collect()}
    assert got == {("v", 0): (20, 2.0, "a_b"), ("v", 23): (30, 5.0, "a"), ("w", 0): (5, 1.0, "")}
    assert refine.merge_adjacent(rows, None).count() == 4


def test_candidates_do_not_depend_on_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("s", f"v{i // 6}", i // 3 * 10, i // 3 * 10 + 5, i % 3, rng.normal(size=4).tolist()) for i in range(30)]
    frames = spark.createDataFrame(rows, "source_index string, video_path string, start_frame int, end_frame int, frame_idx int, vec array<double>")
    prompts = spark.createDataFrame([(i, f"c{i % 3}", rng.normal(size=4).tolist()) for i in range(20)], "prompt_idx int, category string, vec array<double>")
    whole = sorted(map(tuple, search.candidates(frames, prompts, 2).collect()))
    monkeypatch.setattr(search, "PROMPT_BYTES", 5 * 4 * 8)
    assert sorted(map(tuple, search.candidates(frames, prompts, 2).collect())) == whole
    assert len(whole) == 10 * 3 * 2


def test_clip_vote_ties(spark):
    rows = spark.createDataFrame([("a", shots.PUSH, 1.0), ("a", shots.PULL, 1.0), ("b", shots.STATIC, 1.0), ("c", shots.PAN, 0.0)], "clip string, vote string, score double")
    got = {r.clip: (r.movement, r.confidence) for r in shots.clip_vote(rows).collect()}
    assert got == {"a": (shots.PUSH, 1.0), "b": (shots.STATIC, 1.0), "c": (shots.STATIC, 0.0)}


def test_directions_do_not_depend_on_row_order(spark, tmp_path):
    """Sums at the bound: the query gives what its SQL gives row by row, however the table lies."""
    import duckdb

    from reelspark.queries import ORACLE_SQL, QUERIES

    rng = random.Random(1)
    # the pan scores of each user's seven events are 50 of 500 together
    ids = {e * 7919 % 101 - 50: e for e in range(101)}
    rows = []
    for user in range(40):
        scores = [rng.randint(-20, 30) for _ in range(6)]
        while abs(50 - sum(scores)) > 50:
            scores = [rng.randint(-20, 30) for _ in range(6)]
        rows += [(ids[s] + 101 * rng.randint(0, 10**6), user, rng.randint(0, 500) / 100) for s in (*scores, 50 - sum(scores))]
    rows.sort()
    got = []
    for name, lie, parts in (("up", rows, 1), ("down", rows[::-1], 1), ("mixed", rng.sample(rows, len(rows)), 3)):
        spark.createDataFrame(lie, "event_id long, user_id long, value double").repartitionByRange(parts, F.rand(1) if parts > 1 else F.lit(0)).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got.append(sorted(map(tuple, QUERIES["direction"](spark, f"{tmp_path}/{name}").collect())))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE TABLE events AS SELECT * FROM '{tmp_path}/up/events.parquet/*.parquet' ORDER BY event_id")
    wanted = sorted(con.execute(ORACLE_SQL["direction"]).fetchall())
    assert got == [wanted] * 3
    assert {r[1] for r in wanted} == {None, "left"}


def test_directions_of_missing_values(spark):
    schema = "clip string, pan_score double, tilt_score double, mean_dx double, mean_dy double, mean_mag double"
    rows = [(None, 0.1, -0.1, 0.1, -0.1, 1.0), (None, None, None, None, None, None), ("a", 0.0, 5.0, 3.0, -3.0, 1.0), ("b", 0.05, 0.0, -1.0, 0.5, None)]
    got = {r.clip: tuple(r)[1:] for r in shots.directions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: ("left", "down", "down"), "a": (None, "up", "down"), "b": (None, None, None)}


def shortened(spans, vec, least):
    """Plain replay of merging: pass after pass over [start, end] lists; vec: frame -> vector."""

    def middle(a, b):
        inside = sorted(f for f in vec if a <= f <= b)
        return (vec[inside[0]] + vec[inside[-1]]) / 2 if len(inside) < 3 else vec[inside[len(inside) // 2]]

    spans, again = [list(s) for s in sorted(spans)], True
    while again:
        again, i, out, mids = False, 0, [], [middle(*s) for s in spans]
        before_taken = False
        while i < len(spans):
            a, b = spans[i]
            left = float(mids[i] @ mids[i - 1]) if out and not before_taken else -1.0
            right = float(mids[i] @ mids[i + 1]) if i + 1 < len(spans) else -1.0
            step, before_taken = 1, False
            if b - a >= least or max(left, right) <= -1:
                out.append([a, b])
            elif left > -1 and left >= right:
                out[-1][1], before_taken, again = b, True, True
            else:
                out.append([a, spans[i + 1][1]])
                step, before_taken, again = 2, True, True
            i += step
        spans = out
    return [tuple(s) for s in spans]


def test_short_scenes_against_plain_replay(spark):
    """The queries short_scene_merge and index_build_flow over their whole table; the spans have SQL of their own."""
    from reelspark.queries import tables, vectors

    folder = "/root/testdata/sf0.001"
    vec, spans, got = {}, {}, {}
    for r in tables.samples(spark, folder).collect():
        vec.setdefault(r.video_path, {})[r.frame_no] = np.array(r.vec, float)
    for r in vectors.scene_spans(spark, folder).collect():
        spans.setdefault(r.video_path, []).append((r.start_frame, r.end_frame))
    for r in vectors.short_scene_merge(spark, folder).collect():
        got.setdefault(r.video_path, []).append((r.start_frame, r.end_frame))
    wanted = {v: shortened(s, vec[v], 12) for v, s in spans.items()}
    assert {v: sorted(s) for v, s in got.items()} == wanted and wanted != {v: sorted(s) for v, s in spans.items()}
    built = vectors.index_build_flow(spark, folder).collect()
    assert sorted((r.video_path, r.start_frame, r.end_frame) for r in built) == sorted((v, *s) for v, x in wanted.items() for s in x)
    assert {r.feature_count for r in built} == {3}
