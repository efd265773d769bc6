"""Queries over names, templates and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as X
from ..functions import names as N
from ..operators import clips as C
from ..operators import prompts as P
from ..sources.scenes import one_model
from ..sources.vocabulary import Vocabulary
from . import tables as T

QUERIES, ORACLE_SQL = {}, {}
STAMP = "202601010000"
FORMAT = "{情绪}_{场景}_{起始帧}_{视频解析名}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Names of videos by part key, the episode and title that they have by how they are made, and whether they are openings.
FORMS = [
    ("'[Judas] Blue ' || w || ' - S' || a || 'E' || b || 'v2'", "'S' || a2 || 'E' || b2", "'Blue ' || w"),
    ("w || ' Season ' || a || ' E' || b", "'S' || a2 || 'E' || b2", "w"),
    ("w || ' - ' || b2", "'E' || b2", "w"),
    ("w || ' NCOP' || a", "'NCOP' || a", "w"),
    ("w || ' Opening Theme'", "'OP'", "w"),
    ("w || ' S' || a || 'ED'", "'S' || a2 || 'ED'", "w || ' S' || a || 'ED'"),
    ("w || ' OVA' || a", "'OVA' || a", "w"),
    ("w || ' Special ' || a", "'SP' || a", "w"),
    ("w || ' Film'", "'Movie'", "w"),
    ("w || ' Trailer'", "'PV202601010000'", "w"),
    ("w || ' Music Video ' || a", "'MV' || a", "w || ' Music Video'"),
    ("w || ' [1080p] HEVC (2024)'", "'PV202601010000'", "w"),
]
WORDS = "'Tulip', 'Mimic', 'Boring', 'Light'"
NAMES = f"""w AS (SELECT p_partkey AS k, p_partkey % 12 AS form, [{WORDS}][p_partkey % 4 + 1] AS w, (p_partkey % 9 + 1)::VARCHAR AS a, (p_partkey % 97 + 1)::VARCHAR AS b FROM part),
x AS (SELECT *, lpad(a, 2, '0') AS a2, lpad(b, 2, '0') AS b2 FROM w)"""


def _case(i: int) -> str:
    return "CASE form " + " ".join(f"WHEN {n} THEN {f[i]}" for n, f in enumerate(FORMS)) + " END"


def video_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    w = p.select(
        F.col("p_partkey").alias("k"), (F.col("p_partkey") % 12).alias("form"), F.expr(f"element_at(array({WORDS}), cast(p_partkey % 4 + 1 as int))").alias("w"),
        (F.col("p_partkey") % 9 + 1).cast("string").alias("a"), (F.col("p_partkey") % 97 + 1).cast("string").alias("b"),
    )
    x = w.withColumns({"a2": F.lpad("a", 2, "0"), "b2": F.lpad("b", 2, "0")})
    return x.select("k", F.expr(_case(0)).alias("name"))


@query(f"WITH {NAMES} SELECT k, {_case(1)} AS episode FROM x")
def episode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_names(spark, sf_dir).select("k", N.episode(F.col("name"), F.lit(STAMP)).alias("episode"))


@query(f"WITH {NAMES} SELECT k, {_case(2)} AS title FROM x")
def title_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_names(spark, sf_dir).select("k", N.title(F.col("name")).alias("title"))


@query(f"WITH {NAMES} SELECT k, {_case(2)} || '_' || {_case(1)} AS parsed FROM x")
def video_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video_names(spark, sf_dir).select("k", N.video_name(F.concat(F.lit("/shows/a/"), "name", F.lit(".mkv")), F.lit(STAMP)).alias("parsed"))


@query(r"""WITH n AS (SELECT p_partkey, ' <' || p_name || '>: "' || p_brand || '" | a/b\c?* ' AS raw FROM part)
SELECT p_partkey, regexp_replace(translate(raw, '<>:"/\|?*', '_________'), '^\s+|\s+$', '', 'g') AS plain, regexp_replace(translate(raw, '<>:"/\|?*', '_________'), '^_+|_+$', '', 'g') AS result,
  rtrim(regexp_replace(trim(raw), '[<>:"/\\|?*]', '_', 'g'), '. ') AS preset, trim(left(regexp_replace(raw, '[<>:"/\\|?*]', '_', 'g'), 80), '_. ') AS folder, trim(regexp_replace(raw, '[^A-Za-z0-9 ._-]', '', 'g')) AS word FROM n""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" <"), F.col("p_name"), F.lit('>: "'), F.col("p_brand"), F.lit('" | a/b\\c?* '))
    return T.read(spark, sf_dir, "part").select(
        "p_partkey", N.sanitise(raw).alias("plain"), N.sanitise_result(raw).alias("result"), N.sanitise_preset(raw).alias("preset"), N.sanitise_folder(raw).alias("folder"), N.sanitise_word(raw).alias("word")
    )


@query("""SELECT p_partkey, CASE WHEN p_size <= 25 THEN CASE WHEN p_partkey % 3 = 0 THEN 'vit_m' ELSE 'm' END || p_size ELSE p_type || CASE WHEN p_partkey % 3 = 0 THEN '_vit_m' ELSE '_m' END || p_size END AS model,
CASE WHEN p_partkey % 2 = 0 THEN 256 ELSE -1 END::INT AS dim FROM part""")
def index_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a mode, a dimension, both or neither; models of size 25 or less are known, with and without a ``vit_``."""
    part = T.read(spark, sf_dir, "part")
    mode = F.element_at(F.array(F.lit(""), *[F.lit(f"_{m}") for m in N.INDEX_MODES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    model = F.concat(F.when(F.col("p_partkey") % 3 == 0, "_vit_m").otherwise("_m"), F.col("p_size").cast("string"))
    name = F.concat(F.lit("Shows_"), "p_type", model, F.when(F.col("p_partkey") % 2 == 0, "_d256").otherwise(""), mode, F.lit(".lance"))
    known = [f"{p}m{n}" for p in ("", "vit_") for n in range(1, 26)]
    return part.select("p_partkey", N.index_model(name, known).alias("model"), F.coalesce(N.index_dim(name), F.lit(-1)).alias("dim"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type || '_' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE replace(p_name, ' ', '-') || '_' END || p_size || '_' || p_brand AS name FROM part""")
def result_name_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select("p_partkey", _name().alias("name"))


def _name() -> F.Column:
    kind = F.when(F.col("p_partkey") % 4 != 0, F.col("p_type"))
    place = F.when(F.col("p_partkey") % 3 != 0, F.replace("p_name", F.lit(" "), F.lit("-")))
    return N.result_name(FORMAT, {"情绪": kind, "场景": place, "起始帧": F.col("p_size"), "视频解析名": F.col("p_brand")})


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 0 THEN NULL ELSE p_type || '_' || replace(p_name, ' ', '-') END AS label_key, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS parsed_name FROM part""")
def label_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = (F.col("p_partkey") % 4 != 0) & (F.col("p_partkey") % 3 != 0)
    return T.read(spark, sf_dir, "part").select("p_partkey", F.when(whole, N.label_key(_name(), FORMAT)).alias("label_key"), F.when(whole, N.parsed_part(_name(), FORMAT)).alias("parsed_name"))


@query("""WITH n AS (SELECT p_partkey, ['show_op', 'show_op01_x', 'ncop', 'ncop.mp4', 'Show_OP1A', 'S02OP', 'aop', 'x_ED_2', 'ed', 'NCED_01_b'][p_partkey % 10 + 1] AS name FROM part)
SELECT p_partkey, name, regexp_matches(lower(name), '(?:^|_)nc(?:op|ed)(?:\\d+|_\\d+)?(?:_|$)') OR regexp_matches(lower(name), '(?:^|_)(?:op|ed)(?:\\d+|_\\d+)(?:_|$)') OR regexp_matches(lower(name), '(?:^|_)(?:op|ed)(?:_|$)') AS oped FROM n""".replace("\\\\", "\\"))
def op_ed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("element_at(array('show_op', 'show_op01_x', 'ncop', 'ncop.mp4', 'Show_OP1A', 'S02OP', 'aop', 'x_ED_2', 'ed', 'NCED_01_b'), cast(p_partkey % 10 + 1 as int))")
    return T.read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), N.is_op_ed(name).alias("oped"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    tags = F.expr("element_at(array('近景_孤独_女孩', '远景_喜悦_城市', '奔跑_无_夜晚', 'x'), cast(p_partkey % 4 + 1 as int))")
    name = F.concat_ws("_", tags, F.concat(F.lit("分值"), F.col("p_size") % 11), F.lit("Show"), F.concat(F.lit("E"), F.col("p_partkey") % 5), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 6 == 0, "2"))
    return p.select("p_partkey", F.col("p_brand").alias("folder"), name.alias("name"), (F.col("p_partkey") % 3 != 0).alias("same_as_previous"))


CLIPS = """t AS (SELECT p_partkey, p_brand AS folder, p_partkey % 3 <> 0 AS same, ['近景_孤独_女孩', '远景_喜悦_城市', '奔跑_无_夜晚', 'x'][p_partkey % 4 + 1] AS tags, p_size % 11 AS score, 'E' || (p_partkey % 5) AS episode, p_size AS start,
  [['近景', '孤独', '女孩'], ['远景', '喜悦', '城市'], ['奔跑', '夜晚'], ['x']][p_partkey % 4 + 1] AS good, CASE WHEN p_partkey % 6 = 0 THEN '_2' ELSE '' END AS again FROM part),
c AS (SELECT *, tags || '_分值' || score || '_Show_' || episode || '_' || start || again AS name FROM t)"""


@query(f"WITH {CLIPS} SELECT p_partkey, 'Show' AS series_name, episode, start::VARCHAR AS start_frame, replace(tags, '_', ',') AS tags, score::INT AS score, start::BIGINT AS sort_frame FROM c")
def clip_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parsed(_clips(spark, sf_dir)).select("p_partkey", "series_name", "episode", "start_frame", F.array_join("tags", ",").alias("tags"), "score", "sort_frame")


RUNS = """r AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND same THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY folder ORDER BY start, name, p_partkey)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY start, name, p_partkey ROWS UNBOUNDED PRECEDING) AS run FROM r)"""


@query(f"WITH {CLIPS}, {RUNS} SELECT p_partkey, folder, run::BIGINT AS run FROM runs")
def same_subject_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.subject_runs(C.parsed(_clips(spark, sf_dir)), order=("sort_frame", "name", "p_partkey")).select("p_partkey", "folder", "run")


@query(f"""WITH {CLIPS}, {RUNS}, cat AS (SELECT DISTINCT folder, run, unnest(good) AS tag FROM runs),
ranked AS (SELECT *, CASE tag WHEN '近景' THEN 1 WHEN '远景' THEN 1 WHEN '孤独' THEN 2 WHEN '喜悦' THEN 2 WHEN '女孩' THEN 3 WHEN '城市' THEN 3 WHEN '奔跑' THEN 4 WHEN '夜晚' THEN 5 ELSE 7 END AS o FROM cat),
tags AS (SELECT folder, run, string_agg(tag, '_' ORDER BY o, tag) AS tags FROM ranked GROUP BY ALL),
g AS (SELECT folder, run, count(*) AS members, max(score) AS score, min(start) AS start, arg_min(episode, (start, name, p_partkey)) AS episode, arg_min(name, (start, name, p_partkey)) AS first_name FROM runs GROUP BY ALL)
SELECT folder, run::BIGINT AS run, members, CASE WHEN members = 1 THEN first_name ELSE tags || '_分值' || score || '_Show_' || episode || '_' || start END AS merged_name FROM g JOIN tags USING (folder, run)""")
def clip_name_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("sort_frame", "name", "p_partkey")
    return C.merged_names(C.subject_runs(C.parsed(_clips(spark, sf_dir)), order=order), ["folder", "run"], order)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '未知' ELSE '近景_' || left(p_brand, 4) END AS name, greatest(1, least(10, p_size))::INT AS score, p_partkey % 2 = 0 AS same FROM part""")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 5 == 0, "no fields").otherwise(F.concat(F.lit("景别：【近景】\n情绪: "), F.col("p_brand"), F.lit("\n主体：无\n")))
    same = F.when(F.col("p_partkey") % 2 == 0, " 相 同 ").otherwise("不同，不是相同")
    return T.read(spark, sf_dir, "part").select("p_partkey", N.answer_name(text).alias("name"), N.answer_score(F.concat(F.lit("score: "), F.col("p_size"))).alias("score"), N.answer_same(same).alias("same"))


@query("""WITH r AS (SELECT r_name AS cn, row_number() OVER (ORDER BY r_regionkey) - 1 AS o FROM region), n AS (SELECT n_name AS cn, row_number() OVER (ORDER BY n_nationkey) - 1 AS o FROM nation), k AS (SELECT count(*) AS c FROM nation)
SELECT (r.o * k.c + n.o)::INT AS prompt_idx, 'move' AS category, 'a ' || lower(r.cn) || ' that does ' || lower(n.cn) AS prompt FROM r, n, k
UNION ALL SELECT ((SELECT count(*) FROM r) * k.c + r.o)::INT, 'place', 'at ' || lower(r.cn) FROM r, k""")
def template_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prompt_table(spark, _vocabulary(spark, sf_dir)).select("prompt_idx", "category", "prompt")


def _vocabulary(spark: SparkSession, sf_dir: str) -> Vocabulary:
    r = [x[0] for x in T.read(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    n = [x[0] for x in T.read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    labels = [("move", "acts", x, x.lower(), i) for i, x in enumerate(n)] + [("place", "all places", x, x.lower(), i) for i, x in enumerate(r)]
    return Vocabulary(tuple(labels), (("move", 0, "{places}-{acts}", "a {places} that does {acts}"), ("place", 0, "{place}", "at {place}"), ("place", 1, "{nowhere}", "{nowhere}")), {})


@query("SELECT 'move' AS category, (SELECT count(*) FROM region) * (SELECT count(*) FROM nation) AS n_prompts UNION ALL SELECT 'place', count(*) FROM region")
def prompt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prompt_counts(P.prompt_table(spark, _vocabulary(spark, sf_dir)))


@query("""WITH w AS (SELECT DISTINCT 'N_' || (n_nationkey % 12) AS ph FROM nation UNION SELECT r_name FROM region), i AS (SELECT n_name AS name, n_nationkey AS ord FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region)
SELECT ph AS placeholder, name FROM w LEFT JOIN i ON contains(name, ph) QUALIFY row_number() OVER (PARTITION BY ph ORDER BY name = ph DESC NULLS LAST, ord NULLS LAST) = 1""")
def fuzzy_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = T.read(spark, sf_dir, "nation"), T.read(spark, sf_dir, "region")
    wanted = n.select(F.concat(F.lit("N_"), F.col("n_nationkey") % 12).alias("placeholder")).union(r.select("r_name")).distinct()
    index = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.lit("n").alias("parent")).union(r.select("r_name", F.col("r_regionkey") + 100, F.lit("r")))
    return P.resolve(wanted, index).select("placeholder", "name")


@query("""WITH r AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey % 2 = 0), t AS (SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_nationkey < 20), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey % 3 <> 0)
SELECT 'not_in_tree' AS problem, k::VARCHAR AS category FROM (SELECT k FROM r EXCEPT SELECT k FROM t) UNION ALL SELECT 'without_template', k::VARCHAR FROM (SELECT k FROM r INTERSECT SELECT k FROM t EXCEPT SELECT k FROM s)
UNION ALL SELECT 'without_category', k::VARCHAR FROM (SELECT k FROM s EXCEPT SELECT k FROM t)""")
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.read(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_nationkey").cast("string").alias("category"))
    t = T.read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("category"))
    s = T.read(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").select(F.col("s_nationkey").cast("string").alias("category"))
    return P.consistency(r, t, s)


@query("SELECT 'clip' AS model, count(*) AS n FROM nation")
def one_model_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.read(spark, sf_dir, "nation").select(N.index_model(F.concat(F.lower("n_name"), F.lit("_clip_d64")), ["clip"]).alias("model"))
    return names.agg(one_model(F.col("model")).alias("model"), F.count("*").alias("n"))


@query("""SELECT n_nationkey, [c FOR c IN ['AFRICA', 'NATION_1', 'NATION_2', 'N'] IF contains(n_name, c) OR contains(c, n_name)][1] AS found FROM nation""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "nation").select("n_nationkey", N.first_match(F.col("n_name"), ["AFRICA", "NATION_1", "NATION_2", "N"]).alias("found"))


@query("""SELECT n_nationkey, 'look:' || chr(10) || 'a ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '- where: ' || n_regionkey ELSE '' END || chr(10)
  || 'Format: {"who": "yes/no"' || CASE WHEN n_nationkey % 2 = 0 THEN ', "where": "yes/no"' ELSE '' END || '}' AS question FROM nation""")
def verification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string"))
    text = P.verification_text({"who": F.col("n_name"), "where": where}, {"who": "a {val}"}, "look:")
    return T.read(spark, sf_dir, "nation").select("n_nationkey", text.alias("question"))


@query("SELECT p_partkey, CASE WHEN n <= 128 THEN 128 WHEN n <= 256 THEN 256 WHEN n <= 576 THEN 576 WHEN n <= 784 THEN 784 ELSE 1024 END::INT AS patches FROM (SELECT p_partkey, (p_size * 20 // 16) * (p_partkey % 700 // 16) AS n FROM part)")
def patch_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select("p_partkey", X.patch_bucket(F.col("p_size") * 20, F.col("p_partkey") % 700).alias("patches"))
