"""Queries over clips and events: merging, votes, frame plans, export plans, streams, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arguments as A
from ..functions import frames as X
from ..functions import names as N
from ..operators import export, refine, search, shots
from ..plans.stages import stage_path
from ..sources import scenes as SC
from ..streaming import incremental
from . import tables as T
from .tables import CLIPS, clips

QUERIES, ORACLE_SQL = {}, {}
LABELS = ("view", "click", "error", "purchase", "signup", "scroll")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CLIPS}, marked AS (SELECT *, CASE WHEN start_frame - lag(end_frame) OVER w <= 720 THEN 0 ELSE 1 END AS fresh FROM clips WINDOW w AS (PARTITION BY video_path ORDER BY start_frame, scene_key)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY video_path ORDER BY start_frame, scene_key ROWS UNBOUNDED PRECEDING) AS island FROM marked),
lab AS (SELECT video_path, island, string_agg(label, '_' ORDER BY k) AS label FROM (SELECT video_path, island, label, min((start_frame, scene_key)) AS k FROM isl GROUP BY ALL) GROUP BY ALL)
SELECT i.video_path, min(start_frame) AS start_frame, arg_max(end_frame, (start_frame, scene_key)) AS end_frame, round(sum(similarity), 2) AS similarity_sum, count(*) AS members, any_value(l.label) AS label,
  string_agg(prompt_idx, ',' ORDER BY start_frame, scene_key) AS prompts
FROM isl i JOIN lab l ON l.video_path = i.video_path AND l.island = i.island GROUP BY i.video_path, i.island""")
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refine.merge_adjacent(clips(spark, sf_dir), 720)
    return rows.select("video_path", "start_frame", "end_frame", F.round(F.col("similarity") * F.col("members"), 2).alias("similarity_sum"), "members", "label", F.array_join(F.transform("prompt_idx", lambda x: x.cast("string")), ",").alias("prompts"))


@query("""SELECT event_id, greatest(0, event_id % 100 - 2)::BIGINT AS a, greatest(greatest(0, event_id % 100 - 2) + 1, event_id % 90 + 2)::BIGINT AS b FROM events""")
def offset_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events")
    start, end = F.col("event_id") % 100, F.col("event_id") % 90
    return e.select("event_id", X.shifted_start(start, -2).alias("a"), X.shifted_end(start, end, -2, 2).alias("b"))


@query("""WITH t AS (SELECT event_id, event_id * 37 AS frame FROM events), s AS (SELECT *, frame * 40 AS ms FROM t)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code,
  CASE WHEN ms >= 3600000 THEN printf('%02d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%02d:%02d', ms // 60000, ms // 1000 % 60) END AS display, frame // 25 AS whole_seconds FROM s""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.col("event_id") * 37
    at = X.seconds(frame, F.lit(0.0))
    return T.read(spark, sf_dir, "events").select("event_id", X.timecode(at).alias("code"), X.duration_text(at).alias("display"), F.floor(at).cast("long").alias("whole_seconds"))


@query("""WITH w AS (SELECT user_id, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS w0, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS w1, coalesce(sum(value) FILTER (event_type = 'error'), 0) AS w2,
  coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS w3, coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS w4, coalesce(sum(value) FILTER (event_type = 'scroll'), 0) AS w5, sum(value) AS total FROM events GROUP BY user_id),
s AS (SELECT *, (w1 + w2) / total AS p, w3 / total AS t, (w4 + w5) / total AS m, w0 / total AS z FROM w),
b AS (SELECT *, greatest(CASE WHEN p >= .15 THEN p END, CASE WHEN t >= .2 THEN t END, CASE WHEN m >= .2 THEN m END, CASE WHEN z > .5 THEN z END) AS best FROM s)
SELECT user_id, CASE WHEN p >= .15 AND p = best THEN CASE WHEN w1 >= w2 THEN 'click' ELSE 'error' END WHEN t >= .2 AND t = best THEN 'purchase'
  WHEN m >= .2 AND m = best THEN CASE WHEN w4 >= w5 THEN 'signup' ELSE 'scroll' END ELSE 'view' END AS movement, round(coalesce(best, greatest(z, 0.5)), 4) AS confidence FROM b""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = T.read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("vote"), F.col("value").alias("score"))
    return shots.clip_vote(votes, "user_id", labels=LABELS).withColumn("confidence", F.round("confidence", 4))


@query("""WITH w AS (SELECT user_id, event_type AS label, sum(value) AS weight FROM events GROUP BY ALL)
SELECT user_id, label, round(weight / total, 4) AS share FROM (SELECT *, sum(weight) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, label) AS rn FROM w) WHERE rn = 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), F.col("value").alias("confidence"))
    return shots.majority(rows, "user_id").withColumn("share", F.round("share", 4))


@query("""WITH p AS (SELECT user_id, (event_id * 7919 % 101 - 50) / 500.0::DOUBLE AS pan, (event_id * 104729 % 97 - 48) / 500.0::DOUBLE AS tilt, value / 100 AS mag FROM events),
s AS (SELECT user_id, sum(pan) AS pan, sum(tilt) AS tilt, sum(pan * greatest(mag, .01)) AS tx, sum(tilt * greatest(mag, .01)) AS ty FROM p GROUP BY user_id)
SELECT user_id, CASE WHEN abs(pan) < .1 THEN NULL WHEN pan > 0 THEN 'left' ELSE 'right' END AS pan_direction, CASE WHEN abs(tilt) < .1 THEN NULL WHEN tilt > 0 THEN 'up' ELSE 'down' END AS tilt_direction,
  CASE WHEN abs(tx) > abs(ty) AND abs(tx) >= .1 THEN CASE WHEN tx > 0 THEN 'left' ELSE 'right' END WHEN abs(ty) >= .1 THEN CASE WHEN ty > 0 THEN 'up' ELSE 'down' END END AS track_direction FROM s""")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pan, tilt = (F.col("event_id") * 7919 % 101 - 50) / 500.0, (F.col("event_id") * 104729 % 97 - 48) / 500.0
    rows = T.read(spark, sf_dir, "events").select("user_id", "event_id", pan.alias("pan_score"), tilt.alias("tilt_score"), pan.alias("mean_dx"), tilt.alias("mean_dy"), (F.col("value") / 100).alias("mean_mag"))
    return shots.directions(rows, "user_id", order=("event_id",))


@query("""WITH c AS (SELECT vec_id, unnest(range(25)) AS i, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id, i % 5 AS x, i // 5 AS y, v[i + 1] AS dx, v[i + 33] AS dy FROM c),
m AS (SELECT *, sqrt(dx * dx + dy * dy) AS mag FROM d)
SELECT vec_id, round(avg(dx), 6) AS mean_dx, round(avg(dy), 6) AS mean_dy, round(avg(mag), 6) AS mean_mag,
  round(((avg(dx) FILTER (x >= 2) - avg(dx) FILTER (x < 2)) + (avg(dy) FILTER (y >= 2) - avg(dy) FILTER (y < 2))) / 2, 6) AS push_score,
  round((avg(dx) FILTER (x >= 2) + avg(dx) FILTER (x < 2)) / 2, 6) AS pan_score, round((avg(dy) FILTER (y >= 2) + avg(dy) FILTER (y < 2)) / 2, 6) AS tilt_score,
  round(stddev_pop(mag) / avg(mag), 6) AS tracking_cv, round(avg(mag) FILTER (x IN (0, 4) OR y IN (0, 4)), 6) AS edge_mean FROM m GROUP BY vec_id""")
def flow_grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.flow_statistics(_cells(spark, sf_dir), ("vec_id",)).select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean_dx", "mean_dy", "mean_mag", "push_score", "pan_score", "tilt_score", "tracking_cv", "edge_mean")])


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    return e.select("vec_id", (F.col("i") % 5).alias("x"), F.floor(F.col("i") / 5).cast("int").alias("y"), F.element_at("v", F.col("i") + 1).alias("dx"), F.element_at("v", F.col("i") + 33).alias("dy"))


@query("""WITH c AS (SELECT vec_id, unnest(range(25)) AS i, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT vec_id, i % 5 AS x, i // 5 AS y, v[i + 1] AS dx, v[i + 33] AS dy FROM c),
s AS (SELECT vec_id, avg(sqrt(dx * dx + dy * dy)) AS mag, greatest(sqrt(avg(dx * dx) + avg(dy * dy)), 1e-8) AS energy,
  avg(dx) FILTER (x < 2) AS l, avg(dx) FILTER (x >= 2) AS r, avg(dy) FILTER (y < 2) AS t, avg(dy) FILTER (y >= 2) AS b FROM d GROUP BY vec_id),
f AS (SELECT *, ((r - l) + (b - t)) / 2 AS push, (l + r) / 2 AS pan, (t + b) / 2 AS tilt, least(abs(r), abs(l)) / greatest(abs(r), abs(l), 1e-8) > 0.15 AND least(abs(b), abs(t)) / greatest(abs(b), abs(t), 1e-8) > 0.15 AS even FROM s),
q AS (SELECT *, abs(push) / energy >= 0.22 AND even AND (abs(push) > 1.5 * greatest(abs(pan), abs(tilt)) OR greatest(abs(pan), abs(tilt)) < 0.05) AS radial FROM f),
g AS (SELECT vec_id, least(0.6 / (1 + mag / 0.05), 0.98) AS still, CASE WHEN radial AND push > 0 THEN abs(push) / energy END AS push, CASE WHEN radial AND NOT push > 0 THEN abs(push) / energy END AS pull,
  CASE WHEN abs(pan) / energy >= 0.35 THEN abs(pan) / energy END AS pan, CASE WHEN abs(tilt) / energy >= 0.35 THEN abs(tilt) / energy END AS tilt FROM q),
h AS (SELECT *, greatest(still, push, pull, pan, tilt) AS best, still + coalesce(push, 0) + coalesce(pull, 0) + coalesce(pan, 0) + coalesce(tilt, 0) + 0.01 AS total FROM g)
SELECT vec_id, CASE best WHEN still THEN '固定镜头' WHEN push THEN '推镜头' WHEN pull THEN '拉镜头' WHEN pan THEN '摇镜头' WHEN tilt THEN '移镜头' END AS vote, round(least(best / total, 0.95), 6) AS score FROM h""")
def flow_pair_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.pair_vote(shots.flow_statistics(_cells(spark, sf_dir), ("vec_id",)), shots.Flow(static=0.05)).select("vec_id", "vote", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT event_id, event_id % 1000 AS a, event_id % 1000 + floor(value)::BIGINT % 60 AS b FROM events), p AS (SELECT *, (a + b) // 2 AS mid, least(30, b - a) AS n FROM s)
SELECT event_id, CASE WHEN n <= 0 THEN mid::VARCHAR ELSE array_to_string([least(b, greatest(a, mid - n // 2) + i) FOR i IN range(n)], ',') END AS plan FROM p""")
def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("event_id") % 1000
    plan = X.window_plan(a, a + F.floor("value") % 60)
    return T.read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(plan, lambda x: x.cast("string")), ",").alias("plan"))


@query("""WITH s AS (SELECT event_id, event_id % 40 AS n FROM events)
SELECT event_id, array_to_string(CASE WHEN n <= 5 THEN range(n) ELSE [floor(i * (n - 1) / 4)::BIGINT FOR i IN range(5)] END, ',') AS picks FROM s""")
def linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = X.even_picks(F.col("event_id") % 40, 5)
    return T.read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(picks, lambda x: x.cast("string")), ",").alias("picks"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 500 WHEN 2 THEN event_id % 500 + 40 ELSE (2 * (event_id % 500) + 40) // 2 END AS frame,
  printf('%.9f', (event_id % 500)::DOUBLE * 1001 / 24000) AS at FROM events""")
def frame_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("event_id") % 500
    return T.read(spark, sf_dir, "events").select("event_id", X.target_frame(a, a + 40, F.col("event_id") % 3).alias("frame"), X.rational_seconds(a, F.lit(24000), F.lit(1001)).alias("at"))


@query("""WITH s AS (SELECT event_id, 640 + event_id % 50 * 32 AS w, 360 + event_id % 40 * 18 AS h FROM events), f AS (SELECT *, 256::DOUBLE / least(w, h) AS k FROM s),
x AS (SELECT event_id, w, h, floor(greatest(w, h) * k)::BIGINT AS lo, floor(greatest(w, h) * k + 0.5)::BIGINT AS hi FROM f)
SELECT event_id, CASE WHEN w >= h THEN lo - lo % 2 ELSE 256 END AS w_down, CASE WHEN w >= h THEN 256 ELSE lo - lo % 2 END AS h_down, CASE WHEN w >= h THEN hi + hi % 2 ELSE 256 END AS w_up, CASE WHEN w >= h THEN 256 ELSE hi + hi % 2 END AS h_up FROM x""")
def scaled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = 640 + F.col("event_id") % 50 * 32, 360 + F.col("event_id") % 40 * 18
    (a, b), (c, d) = X.scaled(w, h, 256), X.scaled(w, h, 256, True)
    return T.read(spark, sf_dir, "events").select("event_id", a.alias("w_down"), b.alias("h_down"), c.alias("w_up"), d.alias("h_up"))


@query("""SELECT DISTINCT o_custkey AS customer FROM orders ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') d USING (o_custkey)""")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders").withColumn("video_path", F.col("o_custkey"))
    return SC.new_videos(o.select("video_path").distinct(), o.where("o_orderstatus = 'F'")).select(F.col("video_path").alias("customer"))


@query("""WITH r AS (SELECT p_partkey, p_brand || '_' || p_type AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS n FROM r)
SELECT p_partkey, base || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.mp4' AS target FROM n""")
def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    return export.numbered(p, F.concat_ws("_", "p_brand", "p_type"), F.lit(".mp4"), ["p_partkey"]).select("p_partkey", "target")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    rows = p.select(
        "p_partkey", F.concat("p_brand", F.lit(":"), "p_name", F.lit(" ")).alias("result_name"), F.concat(F.lit("v"), F.col("p_size"), F.lit(".mkv")).alias("video_path"), (F.col("p_retailprice") / 100).alias("similarity"),
        F.when(F.col("p_size") % 3 == 0, "未知").otherwise("近景").alias("shot"), F.when(F.col("p_size") % 2 == 0, F.lit(None).cast("string")).otherwise("推镜头").alias("movement"),
    )
    sources = p.where("p_size <> 7").select(F.concat(F.lit("v"), F.col("p_size"), F.lit(".mkv")).alias("video_path"))
    there = p.where("p_partkey % 10 = 0 and p_size % 6 = 0").select(F.concat("p_brand", F.lit("_"), "p_name", F.lit(".mkv")).alias("file_name"))
    return export.clip_plan(rows, sources, there)


PLAN = """p AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE '近景_' END || CASE WHEN p_size % 2 = 0 THEN '' ELSE '推镜头_' END || p_brand || '_' || p_name || '.mkv' AS target FROM part),
plan AS (SELECT p_partkey, target, CASE WHEN p_size = 7 THEN 'no_source' WHEN target IN (SELECT p_brand || '_' || p_name || '.mkv' FROM part WHERE p_partkey % 10 = 0 AND p_size % 6 = 0) THEN 'exists' ELSE 'cut' END AS state FROM p)"""


@query(f"WITH {PLAN} SELECT * FROM plan")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("p_partkey", "target", "state")


@query(f"WITH {PLAN} SELECT count(*) AS total, count(*) FILTER (state = 'cut') AS to_cut, count(*) FILTER (state = 'exists') AS skipped, count(*) FILTER (state = 'no_source') AS failed FROM plan")
def export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_totals(_plan(spark, sf_dir))


@query("SELECT event_id, md5('u' || user_id || '_' || event_id) AS preview, md5('u' || user_id || '_' || event_id || '_' || (event_id + 9)) AS clip FROM events")
def md5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.lit("u"), F.col("user_id"))
    return T.read(spark, sf_dir, "events").select("event_id", export.cache_name(u, F.col("event_id")).alias("preview"), export.cache_name(u, F.col("event_id"), F.col("event_id") + 9).alias("clip"))


@query("""SELECT o_orderkey, i * 40 AS frame_offset, least(40, o_orderkey % 170 - i * 40) AS frame_count FROM orders, range(5) AS r(i) WHERE i * 40 < o_orderkey % 170""")
def segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.explode(export.segments(F.col("o_orderkey") % 170, 40)).alias("s")).select("o_orderkey", "s.*")


@query("""SELECT event_id, printf('%.9f', greatest(0, event_id % 50 - 2) / 25.0::DOUBLE) AS cut_start, printf('%.9f', greatest(greatest(0, event_id % 50 - 2) + 1, event_id % 50 + 13) / 25.0::DOUBLE) AS cut_end,
  greatest(greatest(0, event_id % 50 - 2) + 1, event_id % 50 + 13) - greatest(0, event_id % 50 - 2) AS cut_frames FROM events""")
def cut_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("event_id") % 50
    return T.read(spark, sf_dir, "events").withColumns(export.cut_interval(a, a + 10, F.lit(25.0), False)).select("event_id", "cut_start", "cut_end", "cut_frames")


@query("""WITH a AS (SELECT event_id, (props::JSON ->> 'k')::INT AS k, event_type, user_id FROM events)
SELECT user_id, event_type AS category, k % 2 = 0 AS is_match, count(*) AS n FROM a GROUP BY ALL""")
def json_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    answer = F.concat(F.lit('so {"'), F.col("event_type"), F.lit('": "'), F.when(k % 2 == 0, F.lit("是")).otherwise("不是"), F.lit('"} done'))
    found = N.verdicts(answer, list(LABELS))
    rows = T.read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("category"), found[F.col("event_type")].alias("is_match"))
    return rows.groupBy("user_id", "category", "is_match").agg(F.count("*").alias("n"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    key = ["user_id"]
    rows = e.select("user_id", F.col("event_type").alias("category"), F.when(F.col("k") % 11 == 0, " ").otherwise(F.col("event_type")).alias("label"), F.col("event_id").alias("ord"))
    asked = refine.asked_labels(rows, ["view", "click", "error", "purchase"], key)
    answers = e.groupBy("user_id", F.col("event_type").alias("category")).agg((F.max("k") % 3 != 0).alias("is_match"))
    state = e.select("user_id").distinct().withColumns({"file_exists": F.col("user_id") % 13 != 0, "frame_read": F.col("user_id") % 7 != 0})
    return refine.verified(asked, answers, state, 2, key)


VERIFY = """e AS (SELECT *, (props::JSON ->> 'k')::INT AS k FROM events),
asked AS (SELECT DISTINCT user_id, event_type AS category FROM e WHERE k % 11 <> 0 AND event_type IN ('view', 'click', 'error', 'purchase')),
answers AS (SELECT user_id, event_type AS category, max(k) % 3 <> 0 AS ok FROM e GROUP BY ALL),
j AS (SELECT user_id, count(*) FILTER (ok) AS matched, count(*) AS asked, string_agg(category, ',' ORDER BY category) FILTER (NOT ok) AS bad FROM asked JOIN answers USING (user_id, category) GROUP BY user_id),
judged AS (SELECT u.user_id, coalesce(matched, 0) AS matched, CASE WHEN u.user_id % 7 <> 0 THEN coalesce(bad, '') END AS false_categories,
  CASE WHEN u.user_id % 13 = 0 OR asked IS NULL THEN 'dropped' WHEN u.user_id % 7 = 0 THEN 'unverified' WHEN matched >= 2 THEN 'kept' ELSE 'dropped' END AS state
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN j USING (user_id))"""


@query(f"WITH {VERIFY} SELECT * FROM judged")
def verify_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("user_id", "matched", F.array_join("false_categories", ",").alias("false_categories"), "state")


@query(f"""WITH {VERIFY}, l AS (SELECT DISTINCT user_id, event_type AS c FROM events)
SELECT user_id, coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT list_contains(string_split(coalesce(false_categories, ''), ','), c)), '') AS labels FROM l JOIN judged USING (user_id) WHERE state <> 'dropped' GROUP BY user_id""")
def strip_false_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("event_type").alias("c")).distinct().groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", F.col("c").alias("v"))))).alias("labels"))
    kept = rows.join(_verified(spark, sf_dir).where("state <> 'dropped'"), "user_id")
    return kept.select("user_id", F.array_join(F.array_sort(F.map_keys(refine.strip_labels(F.col("labels"), F.col("false_categories")))), ",").alias("labels"))


@query("""WITH h AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS similarity FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200), s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 85.0::DOUBLE ELSE 0.4::DOUBLE END AS raw FROM labels),
n AS (SELECT h.*, CASE WHEN raw > 1 THEN raw / 100 ELSE raw END AS score FROM h LEFT JOIN s USING (doc_id))
SELECT doc_id, score, round(coalesce(similarity + 50 * score, similarity), 4) AS similarity FROM n WHERE score IS NULL OR score >= 0.6""")
def score_boost_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 10).alias("similarity"))
    scores = T.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 85.0).otherwise(0.4).alias("score"))
    return search.checked_head(rows, scores, 200, 0.6, ["doc_id"]).select("doc_id", "score", F.round("similarity", 4).alias("similarity"))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), f AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, round(avg(value), 4) AS mean_value FROM f GROUP BY user_id, s""")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "events")
    return incremental.sessions(e, "30 minutes", "1 hour").withColumn("mean_value", F.round("mean_value", 4))


@query("""WITH s AS (SELECT 'v' || (vec_id // 50) AS video_path, vec_id % 50 * 5 AS frame_no FROM embeddings) SELECT video_path, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS samples FROM s GROUP BY video_path""")
def streaming_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples come in two deliveries, the second with videos of the first; each video is indexed once."""
    at = stage_path(spark, "stream")
    rows = T.samples(spark, sf_dir)
    video = F.substring("video_path", 2, 9).cast("int")

    def build(df: DataFrame) -> DataFrame:
        return df.groupBy("video_path").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count("*").alias("samples"))

    for part in (rows.where(video % 2 == 0), rows.where((video % 2 == 1) | (video % 4 == 0))):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
        incremental.index_new_videos(incremental.frame_stream(spark, f"{at}/in"), f"{at}/out", f"{at}/log", build).awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("""WITH p AS (SELECT user_id, event_id % 50 AS prompt_idx, max(value) AS sim FROM events GROUP BY ALL)
SELECT user_id, prompt_idx, sim FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, prompt_idx) <= 3""")
def streaming_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that come in deliveries; the best three of each user over all of them."""
    at = stage_path(spark, "stream")
    rows = T.read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 50).alias("prompt_idx"), F.col("value").alias("sim"))
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).drop("event_id").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = incremental.frame_stream(spark, f"{at}/in", "user_id long, prompt_idx long, sim double", 1)
        incremental.best_upserts(stream, 3, f"{at}/best", f"{at}/log", ["user_id"]).awaitTermination()
    return spark.read.parquet(f"{at}/best/2")



@query(r"""WITH p AS (SELECT p_partkey, 'C:\films\' || p_name || ' [' || p_brand || ']: it''s; ' || p_size || ',x.mkv' AS path FROM part)
SELECT p_partkey, chr(39) || regexp_replace(replace(replace(path, '\', '/'), chr(39), chr(39) || '\' || chr(39) || chr(39)), '([:;,\[\]])', '\\\1', 'g') || chr(39) AS path,
  printf('%.9f', p_size * 1001 / 24000::DOUBLE) AS seconds, 'h264_nvenc p5 -rc:v vbr -cq:v ' || p_size || ' -qmin ' || p_size || ' -qmax ' || (p_size + 2) || ' -spatial_aq 1 -temporal_aq 1 -rc-lookahead 20' AS fast,
  '-b:v ' || CASE p_size WHEN 18 THEN '8M' WHEN 20 THEN '6M' WHEN 26 THEN '3M' WHEN 28 THEN '2M' ELSE '4M' END AS rate FROM p JOIN part USING (p_partkey)""")
def cut_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("C:\\films\\"), "p_name", F.lit(" ["), "p_brand", F.lit("]: it's; "), "p_size", F.lit(",x.mkv"))
    _, chosen, preset = A.encoder("libx264", "medium", "cuda")
    other = A.encoder("h265", "medium", "videotoolbox")[1]
    fast = F.concat_ws(" ", F.lit(chosen), F.lit(preset), A.quality_arguments(F.col("p_size"), chosen, "cuda"))
    return T.read(spark, sf_dir, "part").select(
        "p_partkey", A.filter_path(path).alias("path"), A.seconds_argument(F.col("p_size"), 24000, 1001).alias("seconds"), fast.alias("fast"),
        F.concat_ws(" ", A.quality_arguments(F.col("p_size"), other, "videotoolbox")).alias("rate"),
    )


@query("""WITH v AS (SELECT c_custkey % 40 AS video, max({'k': c_nationkey, 'w': c_custkey % 5}) AS f FROM customer GROUP BY 1)
SELECT event_id, CASE WHEN f.k > 0 THEN f.k ELSE 25 END::DOUBLE AS fps, coalesce(f.w * 100, 0)::BIGINT AS width FROM events LEFT JOIN v ON video = user_id""")
def video_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of videos by path; those of nation 0 and of videos without a row are unknown."""
    c = T.read(spark, sf_dir, "customer")
    videos = c.select((F.col("c_custkey") % 40).cast("string").alias("video_path"), F.col("c_nationkey").alias("fps"), (F.col("c_custkey") % 5 * 100).cast("long").alias("width"), F.lit(1).alias("height"))
    rows = T.read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("video_path"))
    return search.with_video_facts(rows, videos).select("event_id", "fps", F.coalesce("width", F.lit(0)).alias("width"))
