"""After the search: intersection of categories, near-copies, adjacent scenes, verification of labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..plans.stages import stored
from ..sources.scenes import SCENE

#: Vectors in a block of pairwise products.
BLOCK = 2048
#: Vectors that directions and cuts are taken from. They decide what can be skipped, never what is found.
GUIDES = 4096
#: Directions in which blocks have bounds; cuts on the way to a cell.
DIRECTIONS, CUTS = 16, 10


def intersect_categories(rows: DataFrame, required: Sequence[str], required_subs: Sequence[str] = (), required_labels: Sequence[str] = (), scene: Sequence[str] = SCENE) -> DataFrame:
    """Scenes that have all required categories: scene, similarity and category of the best row, categories, labels by
    category. rows: scene, category, similarity, prompt_idx, label and, where subcategories or labels are required, labels
    (map of subcategory to label). With fewer than two categories in all rows, nothing is asked of scenes."""
    best = F.struct("similarity", -F.col("prompt_idx"), F.col("category"))
    one = rows.groupBy(*scene, "category").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in scene]), best).alias("r")).select(*scene, "r.*")
    extra = [F.flatten(F.collect_list(F.map_keys("labels"))).alias("subs"), F.flatten(F.collect_list(F.map_values("labels"))).alias("names")] if "labels" in rows.columns else []
    per = one.groupBy(*scene).agg(
        F.max("similarity").alias("similarity"), F.max_by("category", best).alias("category"), F.max_by("prompt_idx", best).alias("prompt_idx"),
        F.array_sort(F.collect_set("category")).alias("categories"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "label")))).alias("labels_by_category"), *extra,
    )
    kinds = rows.agg(F.count_distinct("category").alias("kinds"))
    per = per.crossJoin(F.broadcast(kinds))

    def holds(column: str, wanted: Sequence[str]) -> F.Column:
        return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(column))) == 0 if wanted else F.lit(True)

    keep = holds("categories", required)
    if extra:
        keep = keep & holds("subs", required_subs) & holds("names", required_labels)
    return per.where((F.col("kinds") < 2) | keep).drop("kinds", "subs", "names")


def guide(scenes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, axes, cuts) from the first vectors of at most GUIDES scenes: orthonormal directions of largest spread, and
    a tree of CUTS levels that halves the widest direction at the median, as arrays by node (children of i: 2 i + 1, 2 i + 2)."""
    first = scenes.where(F.size("features") > 0).select("ord", F.col("features")[0].alias("vec"))
    rows = [r.vec for r in first.orderBy(F.xxhash64("ord"), "ord").limit(GUIDES).select("vec").collect() if r.vec and None not in r.vec]
    dims = [len(v) for v in rows]
    dim = max(set(dims), key=lambda d: (dims.count(d), d), default=0)
    x = np.array([v for v in rows if len(v) == dim and np.isfinite(v).all()], float)
    axes, cuts = np.zeros(2**CUTS - 1, int), np.zeros(2**CUTS - 1)
    if not len(x):
        return np.zeros((0, dim)), axes, cuts
    directions = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:DIRECTIONS]
    at = x @ directions.T
    members = {0: at}
    for node in range(len(axes)):
        mine = members.pop(node)
        if len(mine):
            axes[node] = np.argmax(np.ptp(mine, axis=0))
            cuts[node] = np.median(mine[:, axes[node]])
        right = mine[:, axes[node]] > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = mine[~right], mine[right]
    return directions, axes, cuts


def placed(scenes: DataFrame, group: str) -> DataFrame:
    """grp, dim, blk, ord, video_path, at, norm, vec (packed) of each vector of ``scenes``: its place along the directions of
    ``guide``, its squared length, and a block of BLOCK vectors or so that lie near each other.

    A group gets as many levels of cuts as it has blocks for; a cell that holds more than BLOCK vectors for all that, such
    as one of many copies, is split by hash. Vectors of a length that has no directions are only split by hash. Empty
    vectors and those with a null or a value that is not finite are left out: they are near nothing."""
    directions, axes, cuts = guide(scenes)
    wide = dict(scenes.dtypes)["features"] != "array<array<float>>"

    def place(batches):
        for batch in batches:
            column = batch.column(3)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]):
                picked = np.flatnonzero(sizes == dim)
                x = column.take(pa.array(picked)).flatten().to_numpy(zero_copy_only=False).reshape(len(picked), dim)
                norm = np.square(x.astype(float)).sum(1)
                picked, x, norm = picked[np.isfinite(norm)], x[np.isfinite(norm)], norm[np.isfinite(norm)]
                at, node = np.zeros((len(x), len(directions))), np.zeros(len(x), int)
                if dim == directions.shape[1] and len(directions):
                    at = x.astype(float) @ directions.T
                    for _ in range(CUTS):
                        node = 2 * node + 1 + (at[np.arange(len(x)), axes[node]] > cuts[node])
                    node -= len(axes)
                bits = x.astype("<f8" if wide else "<f4")
                take = pa.array(picked)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(3)), pa.array(np.full(len(x), dim), pa.int32()), pa.array(node, pa.int32()), pa.array(list(at), pa.list_(pa.float64())), pa.array(norm), pa.array([v.tobytes() for v in bits], pa.binary())],
                    ["grp", "ord", "video_path", "dim", "leaf", "at", "norm", "vec"],
                )

    vectors = scenes.select(F.col(group).cast("string").alias("grp"), F.col("ord").cast("long").alias("ord"), "video_path", F.explode("features").alias("vec"))
    rows = stored(vectors.mapInArrow(place, "grp string, ord long, video_path string, dim int, leaf int, at array<double>, norm double, vec binary"), "vectors")
    key = ["grp", "dim"]
    leaves = rows.groupBy(*key, "leaf").agg(F.count("*").alias("n"))
    levels = F.least(F.lit(CUTS), F.greatest(F.lit(0), F.ceil(F.log2(F.sum("n") / BLOCK))))
    leaves = leaves.join(leaves.groupBy(*key).agg(levels.alias("levels")), key).withColumn("cell", F.floor(F.col("leaf") / F.pow(F.lit(2), CUTS - F.col("levels"))).cast("long"))
    parts = leaves.groupBy(*key, "cell").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("parts"))
    cells = leaves.join(parts, [*key, "cell"]).select(*key, "leaf", "cell", "parts")
    blk = F.col("cell") + 2**CUTS * F.pmod(F.xxhash64("ord", "vec"), F.col("parts"))
    return rows.join(cells, [*key, "leaf"]).select(*key, blk.alias("blk"), "ord", "video_path", "at", "norm", "vec")


def block_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """grp, dim, ba, bb (ba <= bb): blocks of ``placed`` that can hold two vectors with a product over ``threshold``.

    2 x.y = |x|^2 + |y|^2 - |x - y|^2, and no projection on orthonormal directions makes a distance longer. So where the
    boxes of two blocks are further apart than their longest vectors allow, no product is over the threshold. Blocks of a
    group are dealt by 1024 with a copy of all its boxes, so no task tests more than 1024 of them against the group."""
    key = ["grp", "dim"]
    corners = [f(F.get("at", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(DIRECTIONS) for f in (F.min, F.max)]
    boxes = stored(vectors.groupBy(*key, "blk").agg(F.max("norm").alias("norm"), *corners), "boxes")
    shares = boxes.groupBy(*key).agg(F.ceil(F.count("*") / 1024).cast("long").alias("shares"))
    left = boxes.join(shares, key).withColumn("share", F.pmod(F.xxhash64("blk"), F.col("shares"))).drop("shares")
    right = boxes.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    a, b = left.alias("a"), right.alias("b")
    apart = F.lit(0.0)
    for i in range(DIRECTIONS):
        gap = F.greatest(F.col(f"a.min{i}") - F.col(f"b.max{i}"), F.col(f"b.min{i}") - F.col(f"a.max{i}"), F.lit(0.0))
        apart = apart + F.coalesce(gap * gap, F.lit(0.0))
    lengths = F.col("a.norm") + F.col("b.norm")
    same = F.expr("a.grp <=> b.grp and a.dim = b.dim and a.share = b.share")
    return a.join(b, same & (F.col("a.blk") <= F.col("b.blk")) & (apart <= lengths * (1 + 1e-6) - 2 * threshold + 1e-6)).select("a.grp", "a.dim", F.col("a.blk").alias("ba"), F.col("b.blk").alias("bb"))


def conflicts(scenes: DataFrame, group: str, threshold: float, other_video: bool = True) -> DataFrame:
    """grp, a, b, sim (ordinals, a < b): pairs of scenes of one group whose best product of vectors is over ``threshold``; only
    of different videos where ``other_video``. scenes: group, ord, video_path, features (array of vectors). Vectors of
    different lengths have no product; a null video counts as an empty name.

    Vectors lie in blocks of near ones (``placed``); a task multiplies two blocks that can meet (``block_pairs``), and only
    pairs over the threshold leave it. How many blocks meet depends on how the vectors spread: groups of near ones far from
    each other meet few, vectors without any structure meet all."""
    vectors = stored(placed(scenes, group), "blocks")
    wide = dict(scenes.dtypes)["features"] != "array<array<float>>"
    packed = vectors.groupBy("grp", "dim", "blk").agg(F.collect_list(F.struct("ord", "video_path", "vec")).alias("rows"))
    near = block_pairs(vectors, threshold)
    left, right = packed.withColumnsRenamed({"blk": "ba", "rows": "ra"}), packed.withColumnsRenamed({"blk": "bb", "rows": "rb"})
    pairs = near.join(left, ["grp", "dim", "ba"]).join(right, ["grp", "dim", "bb"]).repartition("grp", "dim", "ba", "bb")

    def side(rows: pa.StructArray):
        x = np.frombuffer(b"".join(rows.field(2).to_pylist()), "<f8" if wide else "<f4").astype(float).reshape(len(rows), -1)
        return x, rows.field(0).to_numpy(zero_copy_only=False), pc.fill_null(rows.field(1), "")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (x, i, u), (y, j, v) = side(batch.column(1)[at].values), side(batch.column(2)[at].values)
                p, q = np.nonzero((sims := x @ y.T) > threshold)
                a, b = i[p], j[q]
                good = a != b
                if other_video:
                    good &= pc.not_equal(u.take(pa.array(p)), v.take(pa.array(q))).to_numpy(zero_copy_only=False)
                if good.any():
                    a, b, sim = a[good], b[good], sims[p, q][good]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1).take(pa.array(np.zeros(len(a), int))), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim)], ["grp", "a", "b", "sim"])

    found = pairs.select("grp", "ra", "rb").mapInArrow(run, "grp string, a long, b long, sim double")
    return found.groupBy("grp", "a", "b").agg(F.max("sim").alias("sim"))


def greedy_keep(pairs: DataFrame) -> DataFrame:
    """grp, ord of scenes that fall to a kept earlier one, where scenes are taken in order and each kept one drops its
    later partners. pairs: grp, a, b with a < b.

    A scene is kept once all its earlier partners are dropped, and dropped once one of them is kept. So all scenes whose
    fate is settled are settled together, round by round, by joins over the pairs; no task sees a whole group."""
    open_ = stored(pairs.select("grp", "a", "b").distinct(), "pairs")
    dropped = None
    while True:
        waiting = open_.select("grp", F.col("b").alias("ord")).distinct()
        free = open_.select("grp", F.col("a").alias("ord")).distinct().join(waiting, ["grp", "ord"], "left_anti")
        gone = open_.join(free.withColumnRenamed("ord", "a"), ["grp", "a"], "left_semi").select("grp", F.col("b").alias("ord")).distinct()
        gone = stored(gone, "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        if gone.isEmpty():
            return dropped
        # a dropped scene drops nothing; a kept one has done its work
        left = open_.join(gone.withColumnRenamed("ord", "b"), ["grp", "b"], "left_anti").join(gone.withColumnRenamed("ord", "a"), ["grp", "a"], "left_anti")
        open_ = stored(left, "pairs")


def drop_near_copies(scenes: DataFrame, group: str, order: Sequence[F.Column | str], threshold: float = 0.95, name: F.Column | None = None) -> DataFrame:
    """Scenes without near-copies from other videos of the same group, in the given order. ``name``: in a group where any
    name marks an opening or ending, those stay and all others go, and no vectors are compared. Scenes without vectors
    stay. Columns of ``scenes`` are kept."""
    rows = scenes.withColumn("_grp", F.col(group).cast("string"))
    settled = None
    if name is not None:
        rows = rows.withColumn("_oped", N.is_op_ed(name))
        marked = rows.where("_oped").select("_grp").distinct()
        settled = rows.where("_oped").select(scenes.columns)
        rows = rows.join(marked, "_grp", "left_anti").drop("_oped")
    # a sort over all rows gives ordinals that rise in each group, whatever its size
    rows = stored(rows.orderBy("_grp", *order).withColumn("_ord", F.monotonically_increasing_id()), "ordered")
    pairs = conflicts(rows.select("_grp", F.col("_ord").alias("ord"), "video_path", "features"), "_grp", threshold)
    dropped = greedy_keep(pairs).select(F.col("grp").alias("_grp"), F.col("ord").alias("_ord"))
    kept = rows.join(dropped, ["_grp", "_ord"], "left_anti").select(scenes.columns)
    return kept if settled is None else kept.unionByName(settled)


def with_features(rows: DataFrame, scenes: DataFrame, scene: Sequence[str] = SCENE) -> DataFrame:
    """Adds the vectors of each row's scene, on original frames; null where there are none. Only scenes that rows name are
    read further."""
    needed = scenes.join(rows.select(*scene).distinct(), list(scene), "left_semi").select(*scene, "features")
    return rows.join(needed, list(scene), "left")


def islands(rows: DataFrame, gap: int | None, part: Sequence[str] = ("video_path",), order: Sequence[str] = ("start_frame", "scene_key")) -> DataFrame:
    """Adds island: rows of a video in order belong together while the next starts at most ``gap`` frames after the end of the
    row before it. A gap that is null or negative leaves each row alone."""
    w = Window.partitionBy(*part).orderBy(*order)
    if gap is None or gap < 0:
        return rows.withColumn("island", F.row_number().over(w).cast("long"))
    new = F.coalesce((F.col("start_frame") - F.lag("end_frame").over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_adjacent(rows: DataFrame, gap: int | None, labels: Sequence[str] = ("label",), part: Sequence[str] = ("video_path",), order: Sequence[str] = ("start_frame", "scene_key")) -> DataFrame:
    """One row for each island: first start, end of the last member, mean similarity, number of members, prompt numbers in
    order and, for each of ``labels``, its distinct values in order joined by ``_``."""
    keys = F.struct(*order)
    marked = islands(rows, gap, part, order)

    def joined(column: str) -> F.Column:
        listed = F.array_sort(F.collect_list(F.struct(keys.alias("k"), F.col(column).alias("v"))))
        return F.array_join(F.array_distinct(F.filter(F.transform(listed, lambda x: x["v"]), lambda v: v.isNotNull() & (v != ""))), "_").alias(column)

    prompts = [F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), F.col("prompt_idx").alias("v")))), lambda x: x["v"]).alias("prompt_idx")] if "prompt_idx" in rows.columns else []
    return marked.groupBy(*part, "island").agg(
        F.min("start_frame").alias("start_frame"), F.max_by("end_frame", keys).alias("end_frame"), F.avg("similarity").alias("similarity"),
        F.count("*").alias("members"), *prompts, *[joined(c) for c in labels],
    )


def asked_labels(rows: DataFrame, required: Sequence[str], scene: Sequence[str] = SCENE) -> DataFrame:
    """One label for each scene and required category: the first that is not blank, by ``ord``. rows: scene, category, label, ord."""
    valid = rows.where(F.col("category").isin(*required) & (F.trim(F.coalesce("label", F.lit(""))) != ""))
    w = Window.partitionBy(*scene, "category").orderBy("ord", "label")
    return valid.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "ord")


def verified(asked: DataFrame, answers: DataFrame, scenes: DataFrame, least: int = 4, scene: Sequence[str] = SCENE) -> DataFrame:
    """Scenes with matched, false_categories and state. scenes: scene, file_exists, frame_read.

    ``dropped``: the file is missing, there are no labels, or under ``least`` of them match; ``unverified`` (and kept): the
    frame could not be read; else ``kept``."""
    judged = asked.join(answers, [*scene, "category"], "left").withColumn("ok", F.coalesce("is_match", F.lit(False)))
    counts = judged.groupBy(*scene).agg(F.count_if("ok").alias("matched"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("category")))).alias("false_categories"), F.count("*").alias("asked"))
    out = scenes.join(counts, list(scene), "left")
    state = F.when(~F.col("file_exists"), "dropped").when(F.coalesce("asked", F.lit(0)) == 0, "dropped").when(~F.col("frame_read"), "unverified").when(F.col("matched") >= least, "kept").otherwise("dropped")
    return out.withColumn("state", state).withColumns({"matched": F.coalesce("matched", F.lit(0).cast("long")), "false_categories": F.when(F.col("frame_read"), F.col("false_categories"))}).drop("asked")


def strip_labels(labels: F.Column, false_categories: F.Column) -> F.Column:
    """A map of category to label without the categories that were not confirmed."""
    return F.map_filter(labels, lambda k, v: ~F.array_contains(F.coalesce(false_categories, F.array().cast("array<string>")), k))


def kept_only(rows: DataFrame, kept: DataFrame, scene: Sequence[str] = SCENE) -> DataFrame:
    return rows.join(kept.select(*scene).distinct(), list(scene), "left_semi")


def merge_maps(rows: DataFrame, keys: Sequence[str], column: str, order: Sequence[str], first: bool = True) -> DataFrame:
    """One map for each group: of a key that several rows have, the first row's value counts, or the last one's."""
    entries = rows.select(*keys, *order, F.explode(column).alias("_key", "_value"))
    pick = F.min_by("_value", F.struct(*order)) if first else F.max_by("_value", F.struct(*order))
    return entries.groupBy(*keys, "_key").agg(pick.alias("_value")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias(column))
