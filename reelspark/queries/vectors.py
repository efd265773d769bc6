"""Queries over vectors: segmentation, search, near-copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import names as N
from ..functions import vectors as V
from ..operators import refine, search, segment
from ..plans import retrieval
from ..sources import scenes as X
from ..sources import vocabulary
from . import tables as T
from .tables import FRAMES, SAMPLES, SCORED, S, frames, prompts, samples, scenes

QUERIES, ORACLE_SQL = {}, {}
KEY = list(X.SCENE)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Scenes ``m`` as matches.
MATCHES = """SELECT source_index, video_path, a AS start_frame, b AS end_frame, start_frame::BIGINT AS original_start, end_frame::BIGINT AS original_end, b - a AS duration_frames,
  round((b - a) / 25.0, 2)::DOUBLE AS duration_seconds, printf('%02d:%02d', ((b - a) // 25) // 60, ((b - a) // 25) % 60) AS duration_display,
  printf('%02d:%02d:%02d.%03d', (a * 40) // 3600000, (a * 40) // 60000 % 60, (a * 40) // 1000 % 60, (a * 40) % 1000) AS start,
  printf('%02d:%02d:%02d.%03d', (b * 40) // 3600000, (b * 40) // 60000 % 60, (b * 40) // 1000 % 60, (b * 40) % 1000) AS end, round(sim, 4) AS similarity"""


def shifted(name: str) -> str:
    return f"m AS (SELECT *, greatest(0, start_frame - 2)::BIGINT AS a, greatest(greatest(0, start_frame - 2) + 1, end_frame + 2)::BIGINT AS b FROM {name})"


def greedy(group: str) -> str:
    """kept (group, ord): rows of ``ordered`` (group, ord, video_path, vs) that are not near an earlier kept row of another video."""
    return f"""flat AS (SELECT {group}, ord, video_path, unnest(vs) AS v FROM ordered),
sims AS (SELECT a.{group}, a.ord AS i, b.ord AS j, max(list_inner_product(a.v, b.v)) AS sim FROM flat a JOIN flat b ON a.{group} = b.{group} AND a.ord < b.ord AND a.video_path <> b.video_path GROUP BY ALL),
close AS (SELECT * FROM sims WHERE sim > 0.35),
conf AS (SELECT {group}, j AS ord, list(i) AS c FROM close GROUP BY ALL),
walk({group}, ord, kept) AS (SELECT {group}, 0::BIGINT, [0::BIGINT] FROM ordered WHERE ord = 0
  UNION ALL SELECT w.{group}, o.ord, CASE WHEN len(list_intersect(w.kept, coalesce(c.c, []::BIGINT[]))) = 0 THEN list_append(w.kept, o.ord) ELSE w.kept END
  FROM walk w JOIN ordered o ON o.{group} = w.{group} AND o.ord = w.ord + 1 LEFT JOIN conf c ON c.{group} = o.{group} AND c.ord = o.ord),
kept AS (SELECT {group}, unnest(arg_max(kept, ord)) AS ord FROM walk GROUP BY {group})"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_prompts(search.candidates(frames(spark, sf_dir), prompts(spark, sf_dir), 1))


@query(f"WITH {FRAMES}, {SCORED} SELECT {S}, category, prompt_idx, frame_idx, round(sim, 4) AS similarity FROM best WHERE sim >= 5")
def best_prompt_per_scene_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.above(best(spark, sf_dir), 5, "sim").select(*KEY, "category", "prompt_idx", "frame_idx", F.round("sim", 4).alias("similarity"))


@query(f"""WITH {FRAMES}, {SCORED} SELECT {S}, category, prompt_idx, frame_idx, round(sim, 4) AS similarity FROM per_prompt
QUALIFY row_number() OVER (PARTITION BY {S}, category ORDER BY sim DESC, prompt_idx) <= 3""")
def scene_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.candidates(frames(spark, sf_dir), prompts(spark, sf_dir), 3)
    return found.select(*KEY, "category", "prompt_idx", "frame_idx", F.round("sim", 4).alias("similarity"))


@query(f"""WITH {FRAMES}, q AS (SELECT vec AS qvec FROM e WHERE vec_id = 0),
found AS (SELECT {S}, max(100 * list_inner_product(vec, qvec)) AS sim FROM frames, q GROUP BY ALL HAVING max(100 * list_inner_product(vec, qvec)) >= 5),
{shifted("found")} {MATCHES} FROM m ORDER BY sim DESC, source_index, video_path, start_frame LIMIT 20""")
def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.read(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("qvec"))
    found = search.by_similarity(search.query_scores(frames(spark, sf_dir), q, threshold=5)).limit(20)
    return search.matches(found, start_offset=-2, end_offset=2)


@query(f"WITH {FRAMES}, {SCORED} SELECT {S}, arg_max(frame_idx, (sim, -prompt_idx, -frame_idx)) AS best_frame_idx, round(max(sim), 4) AS best_sim FROM best GROUP BY ALL")
def scene_best_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_frames(best(spark, sf_dir)).withColumn("best_sim", F.round("best_sim", 4))


@query(f"""WITH {FRAMES}, cut AS (SELECT vec_id, vec[1:32] AS v FROM e), unit AS (SELECT vec_id, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS v FROM cut),
q AS (SELECT v AS q FROM unit WHERE vec_id = 0) SELECT vec_id, round(100 * list_inner_product(v, q), 4) AS similarity FROM unit, q WHERE list_inner_product(v, q) >= 0.1""")
def truncate_renormalize_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings").select("vec_id", V.truncate("embedding", 32).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    sim = V.dot("v", "q")
    return e.crossJoin(F.broadcast(q)).where(sim >= 0.1).select("vec_id", F.round(100 * sim, 4).alias("similarity"))


def _top(mode: int, k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = best(spark, sf_dir).withColumn("similarity", F.col("sim"))
        return search.grouped_top_k(rows, k, mode).select(*KEY, "category", "prompt_idx", F.round("similarity", 4).alias("similarity"))

    return run


for _name, _mode, _k, _part in (("topk_by_video", -1, 3, "PARTITION BY video_path"), ("topk_by_source", 0, 10, "PARTITION BY source_index"), ("topk_global", 1, 25, "")):
    QUERIES[_name] = _top(_mode, _k)
    ORACLE_SQL[_name] = f"""WITH {FRAMES}, {SCORED} SELECT {S}, category, prompt_idx, round(sim, 4) AS similarity FROM best
QUALIFY row_number() OVER ({_part} ORDER BY sim DESC, video_path, start_frame, source_index, end_frame, category) <= {_k}"""


@query(f"""WITH {FRAMES}, {SCORED}, listed AS (SELECT * FROM per_prompt QUALIFY row_number() OVER (PARTITION BY {S}, category ORDER BY sim DESC, prompt_idx) <= 3),
blend AS (SELECT *, CASE WHEN prompt_idx % 5 = 0 THEN sim ELSE sim * 0.4 + (prompt_idx % 7 / 7.0::DOUBLE) * 100 * 0.6 END AS similarity FROM listed)
SELECT {S}, category, prompt_idx, round(similarity, 4) AS similarity FROM blend QUALIFY row_number() OVER (PARTITION BY {S}, category ORDER BY similarity DESC, prompt_idx) = 1""")
def rerank_shortlist_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = search.shortlist(search.candidates(frames(spark, sf_dir), prompts(spark, sf_dir), 3), 3)
    scores = listed.where("prompt_idx % 5 <> 0").select(*KEY, "category", "prompt_idx", (F.col("prompt_idx") % 7 / F.lit(7.0)).alias("score"))
    return search.reranked(listed, scores, 0.6).select(*KEY, "category", "prompt_idx", F.round("similarity", 4).alias("similarity"))


@query(f"""WITH {FRAMES}, {SCORED}, good AS (SELECT *, 'l' || prompt_idx AS label FROM best WHERE sim >= 15)
SELECT {S}, round(max(sim), 4) AS similarity, arg_max(category, (sim, -prompt_idx)) AS category, arg_max(prompt_idx, (sim, -prompt_idx)) AS prompt_idx,
  string_agg(category, ',' ORDER BY category) AS categories, string_agg(label, ',' ORDER BY category) AS labels
FROM good GROUP BY {S} HAVING count(DISTINCT category) = 4""")
def category_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.above(best(spark, sf_dir), 15, "sim").select(*KEY, "category", F.col("sim").alias("similarity"), "prompt_idx", F.concat(F.lit("l"), "prompt_idx").alias("label"))
    whole = refine.intersect_categories(rows, ["c0", "c1", "c2", "c3"])
    return whole.select(*KEY, F.round("similarity", 4).alias("similarity"), "category", "prompt_idx", F.array_join("categories", ",").alias("categories"), F.array_join(F.map_values("labels_by_category"), ",").alias("labels"))


@query(f"WITH {SAMPLES} SELECT video_path, frame_no, next_frame, round(sim, 4) AS sim FROM pairs WHERE next_frame IS NOT NULL")
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.adjacent_similarity(samples(spark, sf_dir)).where("next_frame is not null").select("video_path", "frame_no", "next_frame", F.round("sim", 4).alias("sim"))


@query(f"WITH {SAMPLES} SELECT video_path, frame_no, round(sim, 4) AS sim FROM minima WHERE is_min AND sim < 0.0")
def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.local_minima(segment.adjacent_similarity(samples(spark, sf_dir)))
    return rows.where("is_min and sim < 0").select("video_path", "frame_no", F.round("sim", 4).alias("sim"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundaries(samples(spark, sf_dir), -0.1, 2)


@query(f"WITH {SAMPLES} SELECT video_path, frame_no FROM marked WHERE is_boundary")
def scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).where("is_boundary").select("video_path", "frame_no")


@query(f"WITH {SAMPLES} SELECT * FROM spans")
def scene_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.scene_spans(marked(spark, sf_dir))


@query(f"""WITH {SAMPLES}, ranked AS (SELECT s.*, x.vec, row_number() OVER w AS rn, count(*) OVER (PARTITION BY s.video_path, s.start_frame) AS n FROM spans s
  JOIN samples x ON x.video_path = s.video_path AND x.frame_no BETWEEN s.start_frame AND s.end_frame WINDOW w AS (PARTITION BY s.video_path, s.start_frame ORDER BY x.frame_no)),
three AS (SELECT video_path, start_frame, end_frame, max(n) AS n, max(vec) FILTER (rn = 1) AS a, max(vec) FILTER (rn = n // 2 + 1) AS m, max(vec) FILTER (rn = n) AS z FROM ranked GROUP BY ALL)
SELECT video_path, start_frame, end_frame, n AS samples, round(a[1], 4) AS first_0, round(CASE WHEN n >= 3 THEN m[1] ELSE (a[1] + z[1]) / 2 END, 4) AS middle_0, round(z[1], 4) AS last_0,
  round(list_inner_product(a, z), 4) AS first_last, round(CASE WHEN n >= 3 THEN list_inner_product(m, a) ELSE (list_inner_product(a, a) + list_inner_product(z, a)) / 2 END, 4) AS middle_first FROM three""")
def scene_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.triplets(segment.scene_spans(marked(spark, sf_dir)), samples(spark, sf_dir))
    f = F.col("features")
    return rows.select("video_path", "start_frame", "end_frame", "samples", *[F.round(f[i][0], 4).alias(n) for i, n in enumerate(("first_0", "middle_0", "last_0"))], F.round(V.dot(f[0], f[2]), 4).alias("first_last"), F.round(V.dot(f[1], f[0]), 4).alias("middle_first"))


@query()
def short_scene_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.merge_short_scenes(segment.scene_spans(marked(spark, sf_dir)), samples(spark, sf_dir), 12)


@query()
def index_build_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = retrieval.index_build(samples(spark, sf_dir), s=Settings(boundary_threshold=-0.1, min_scene=12))
    return built.select("video_path", "start_frame", "end_frame", F.size("features").alias("feature_count"))


NODES = f"""nodes AS (SELECT {S}, list(vec ORDER BY frame_idx) AS vs FROM frames GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source_index ORDER BY start_frame || '_' || video_path, end_frame) - 1 AS ord FROM nodes),
{greedy("source_index")}"""


def _order() -> list:
    return [F.concat(F.col("start_frame").cast("string"), F.lit("_"), F.col("video_path")), F.col("end_frame")]


@query(f"""WITH RECURSIVE {FRAMES}, {NODES} SELECT c.source_index, a.video_path AS video_a, a.start_frame AS start_a, b.video_path AS video_b, b.start_frame AS start_b, round(sim, 4) AS sim
FROM close c JOIN ordered a ON a.source_index = c.source_index AND a.ord = i JOIN ordered b ON b.source_index = c.source_index AND b.ord = j""")
def cross_video_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refine.stored(scenes(spark, sf_dir).orderBy("source_index", *_order()).withColumn("ord", F.monotonically_increasing_id()), "pairs")
    pairs = refine.conflicts(rows, "source_index", 0.35)

    def side(n: str) -> DataFrame:
        return rows.select(F.col("source_index").alias("grp"), F.col("ord").alias(n), F.col("video_path").alias(f"video_{n}"), F.col("start_frame").alias(f"start_{n}"))

    out = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    return out.select(F.col("grp").alias("source_index"), "video_a", "start_a", "video_b", "start_b", F.round("sim", 4).alias("sim"))


@query(f"WITH RECURSIVE {FRAMES}, {NODES} SELECT {S} FROM ordered JOIN kept USING (source_index, ord)")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.drop_near_copies(scenes(spark, sf_dir), "source_index", _order(), 0.35).select(*KEY)


def one_opening(rows: DataFrame) -> DataFrame:
    """Only videos of the first index are openings, so that both ways to drop near-copies are taken."""
    return rows.withColumn("video_path", F.when(F.col("source_index") == "s0", F.col("video_path")).otherwise(F.replace("video_path", F.lit("_op"), F.lit(""))))


ONE_OPENING = FRAMES.replace("frames AS (", "every AS (") + """,
frames AS (SELECT * REPLACE (CASE WHEN source_index = 's0' THEN video_path ELSE replace(video_path, '_op', '') END AS video_path) FROM every)"""


@query(f"""WITH RECURSIVE {ONE_OPENING}, nodes AS (SELECT {S}, list(vec) AS vs FROM frames GROUP BY {S}), grouped AS (SELECT *, 'g' || (start_frame // 300) || source_index AS grp, contains(video_path, '_op.') AS oped FROM nodes),
named AS (SELECT *, bool_or(oped) OVER (PARTITION BY grp) AS any_oped FROM grouped),
ordered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY start_frame || '_' || video_path, end_frame) - 1 AS ord FROM named WHERE NOT any_oped), {greedy("grp")}
SELECT {S}, grp FROM named WHERE oped UNION ALL SELECT {S}, grp FROM ordered JOIN kept USING (grp, ord)""")
def oped_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_opening(scenes(spark, sf_dir)).withColumn("grp", F.concat(F.lit("g"), F.floor(F.col("start_frame") / 300), "source_index"))
    return refine.drop_near_copies(rows, "grp", _order(), 0.35, N.stem(F.col("video_path"))).select(*KEY, "grp")


@query(f"""WITH RECURSIVE {ONE_OPENING}, q AS (SELECT vec AS qvec FROM e WHERE vec_id = 0),
found AS (SELECT {S}, max(100 * list_inner_product(vec, qvec)) AS sim, list(vec ORDER BY frame_idx) AS vs FROM frames, q GROUP BY ALL HAVING max(100 * list_inner_product(vec, qvec)) >= 5),
named AS (SELECT *, contains(video_path, '_op.') AS oped, bool_or(contains(video_path, '_op.')) OVER (PARTITION BY source_index) AS any_oped FROM found),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source_index ORDER BY sim DESC, video_path, start_frame) - 1 AS ord FROM named WHERE NOT any_oped), {greedy("source_index")},
stay AS (SELECT {S}, sim FROM named WHERE oped UNION ALL SELECT {S}, sim FROM ordered JOIN kept USING (source_index, ord)), {shifted("stay")} {MATCHES} FROM m""")
def text_search_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.read(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("qvec"))
    return retrieval.text_search(one_opening(scenes(spark, sf_dir)), q, Settings(threshold=5, dedup_threshold=0.35))


@query(f"""WITH RECURSIVE {ONE_OPENING}, {SCORED}, good AS (SELECT *, 'l' || (prompt_idx % 3) AS label FROM best WHERE sim >= 15),
whole AS (SELECT {S}, max(sim) AS sim, arg_max(prompt_idx, (sim, -prompt_idx)) AS prompt_idx, string_agg(label, '_' ORDER BY category) AS label,
  start_frame || '_' || split_part(video_path, '/', 2) AS scene_key FROM good GROUP BY {S} HAVING count(DISTINCT category) = 4),
named AS (SELECT *, source_index || '|' || label AS grp, contains(video_path, '_op.') AS oped, bool_or(contains(video_path, '_op.')) OVER (PARTITION BY source_index, label) AS any_oped
  FROM whole JOIN (SELECT {S}, list(vec) AS vs FROM frames GROUP BY {S}) USING ({S})),
ordered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY scene_key, video_path, end_frame) - 1 AS ord FROM named WHERE NOT any_oped), {greedy("grp")},
stay AS (SELECT {S}, sim, prompt_idx, label, scene_key FROM named WHERE oped UNION ALL SELECT {S}, sim, prompt_idx, label, scene_key FROM ordered JOIN kept USING (grp, ord)),
fresh AS (SELECT *, coalesce((start_frame - lag(end_frame) OVER w > 40)::INT, 1) AS new FROM stay WINDOW w AS (PARTITION BY source_index, video_path ORDER BY start_frame, scene_key)),
isles AS (SELECT *, sum(new) OVER (PARTITION BY source_index, video_path ORDER BY start_frame, scene_key ROWS UNBOUNDED PRECEDING) AS island FROM fresh),
labels AS (SELECT source_index, video_path, island, label, min(start_frame) AS at FROM isles GROUP BY ALL)
SELECT source_index, video_path, min(start_frame) AS start_frame, arg_max(end_frame, start_frame) AS end_frame, round(avg(sim), 4) AS similarity, count(*) AS members,
  string_agg(prompt_idx, ',' ORDER BY start_frame) AS prompts, (SELECT string_agg(l.label, '_' ORDER BY l.at) FROM labels l WHERE l.source_index = i.source_index AND l.video_path = i.video_path AND l.island = i.island) AS label
FROM isles i GROUP BY source_index, video_path, island""")
def label_search_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompts(spark, sf_dir).withColumn("label_cn", F.concat(F.lit("l"), F.col("prompt_idx") % 3))
    s = Settings(threshold=15, dedup_threshold=0.35, merge_gap=40, required=("c0", "c1", "c2", "c3"))
    merged = retrieval.label_search(one_opening(scenes(spark, sf_dir)), p, s)
    return merged.select("source_index", "video_path", "start_frame", "end_frame", F.round("similarity", 4).alias("similarity"), "members", F.array_join(F.transform("prompt_idx", lambda x: x.cast("string")), ",").alias("prompts"), "label")


@query(f"""WITH {FRAMES} SELECT {S}, count(*) AS feature_count, (SELECT len(vec) FROM e LIMIT 1)::BIGINT AS dim, TRUE AS close FROM frames GROUP BY {S}""")
def scene_blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes as blobs and back; close: all values are within what 16 bits keep."""
    whole = scenes(spark, sf_dir)
    rows = X.decode(X.encode(whole)).join(whole.withColumnRenamed("features", "before"), KEY)
    near = F.forall(F.arrays_zip(F.flatten("features").alias("x"), F.flatten("before").alias("y")), lambda p: F.abs(p["x"] - p["y"]) <= 5e-4)
    return rows.select(*KEY, near.alias("close"), F.size("features").cast("long").alias("feature_count"), F.size(F.col("features")[0]).cast("long").alias("dim"))


@query("""SELECT vec_id, CASE WHEN len([x FOR x IN embedding::DOUBLE[] IF x < -0.05]) / 64.0 >= 0.4 THEN 'black' WHEN len([x FOR x IN embedding::DOUBLE[] IF x > 0.05]) / 64.0 >= 0.4 THEN 'white' END AS dead FROM embeddings""")
def black_white_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.read(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.dead_frame("embedding", -0.05, 40, 0.05, 40).alias("dead"))


@query(f"WITH {FRAMES} SELECT category, count(*) AS n, string_agg(prompt_idx, ',' ORDER BY prompt_idx) AS prompts FROM prompts GROUP BY category")
def prompts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.prompts_by_category(prompts(spark, sf_dir)).select("category", "n", F.array_join(F.transform("prompts", lambda x: x.cast("string")), ",").alias("prompts"))


@query(f"""WITH {FRAMES} SELECT prompt_idx, (prompt_idx // 10)::BIGINT AS batch_idx, (prompt_idx // 10 * 10)::BIGINT AS start_idx, least(prompt_idx // 10 * 10 + 10, 24)::BIGINT AS end_idx, 3::BIGINT AS num_batches FROM prompts""")
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.prompt_batches(prompts(spark, sf_dir), 10).select("prompt_idx", "batch_idx", "start_idx", "end_idx", "num_batches")


@query(f"WITH {FRAMES}, w AS (SELECT DISTINCT (event_id % 40 - 5)::INT AS prompt_idx FROM events) SELECT w.prompt_idx, category FROM w LEFT JOIN prompts USING (prompt_idx) WHERE w.prompt_idx >= 0")
def take_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.read(spark, sf_dir, "events").select((F.col("event_id") % 40 - 5).cast("int").alias("prompt_idx"))
    return vocabulary.take_prompts(wanted, prompts(spark, sf_dir)).select("prompt_idx", "category")


@query(f"WITH {FRAMES}, k AS (SELECT DISTINCT video_path, start_frame, end_frame FROM frames WHERE start_frame >= 500) SELECT {S}, frame_idx FROM frames SEMI JOIN k USING (video_path, start_frame, end_frame)")
def keyed_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return X.keyed_scenes(rows, rows.where("start_frame >= 500")).select(*KEY, "frame_idx")


@query(f"WITH {FRAMES} SELECT DISTINCT video_path FROM frames")
def distinct_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.indexed_videos(frames(spark, sf_dir))
