"""Movement and scale of shots: statistics of flow fields, votes of frame pairs, votes of clips."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of movements.
STATIC, PUSH, PULL, TRACK, PAN, TILT = "固定镜头", "推镜头", "拉镜头", "跟镜头", "摇镜头", "移镜头"
MOVEMENTS = (STATIC, PUSH, PULL, TRACK, PAN, TILT)


@dataclass(frozen=True)
class Flow:
    """Thresholds of the shot stage; ``CLIP`` has those of a single clip's analysis."""

    static: float = 0.35
    pan_tilt: float = 0.35
    radial: float = 0.22
    tracking: float = 0.50
    symmetry: float = 0.15
    dominance: float = 1.5
    static_factor: float = 0.6
    push_vote: float = 0.15
    tracking_vote: float = 0.20
    pan_tilt_vote: float = 0.20
    grid: int = 5


CLIP = Flow(static=0.4, pan_tilt=0.40, radial=0.25, tracking=0.55, symmetry=0.3, push_vote=0.20, tracking_vote=0.25)


def frame_pairs(frames: DataFrame, clip: str = "clip") -> DataFrame:
    """Each sampled frame with the one before it: clip, pair_no, frame_no, prev_frame."""
    w = Window.partitionBy(clip).orderBy("frame_no")
    return frames.withColumns({"prev_frame": F.lag("frame_no").over(w), "pair_no": F.row_number().over(w) - 2}).where("prev_frame is not null")


def flow_statistics(cells: DataFrame, key: Sequence[str] = ("clip", "pair_no"), p: Flow = Flow()) -> DataFrame:
    """Statistics of a flow field from its vectors: rows of key, x, y, dx, dy (pixels from 0) give one row for each key.

    Halves part at h // 2 and w // 2; cells of the grid have h // 5 rows, the last ones the rest; the centre leaves out 15
    per cent at each side. Everything is one grouped pass over the vectors; sizes come from a grouped maximum."""
    size = cells.groupBy(*key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    c = cells.join(size, list(key))
    mag = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    g = p.grid
    row, col = (F.least(F.lit(g - 1), F.floor(F.col(v) / F.greatest(F.floor(F.col(n) / g), F.lit(1)))).cast("int") for v, n in (("y", "h"), ("x", "w")))
    my, mx = F.floor(F.col("h") * 0.15), F.floor(F.col("w") * 0.15)
    top, bottom = F.col("y") < my, F.col("y") >= F.col("h") - my
    left, right = F.col("x") < mx, F.col("x") >= F.col("w") - mx
    c = c.withColumns({"mag": mag, "row": row, "col": col, "top": top, "bottom": bottom, "left": left, "right": right})
    low, up = F.col("x") < F.floor(F.col("w") / 2), F.col("y") < F.floor(F.col("h") / 2)
    centre = ~(F.col("top") | F.col("bottom") | F.col("left") | F.col("right"))

    def mean(value: str, where: Column) -> Column:
        return F.coalesce(F.avg(F.when(where, F.col(value))), F.lit(0.0))

    strips = {s: F.col(s) for s in ("top", "bottom", "left", "right")}
    whole = c.groupBy(*key).agg(
        F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"), F.avg("mag").alias("mean_mag"),
        mean("dx", low).alias("left_dx"), mean("dx", ~low).alias("right_dx"), mean("dy", up).alias("top_dy"), mean("dy", ~up).alias("bot_dy"),
        F.greatest(F.sqrt(F.avg(F.col("dx") * F.col("dx")) + F.avg(F.col("dy") * F.col("dy"))), F.lit(1e-8)).alias("energy"),
        mean("mag", centre).alias("centre_mag"),
        *[mean("mag", w).alias(f"mag_{s}") for s, w in strips.items()], *[mean("dx", w).alias(f"dx_{s}") for s, w in strips.items()], *[mean("dy", w).alias(f"dy_{s}") for s, w in strips.items()],
    )
    cell = c.groupBy(*key, "row", "col").agg(F.avg("mag").alias("m"))
    border = (F.col("row") == 0) | (F.col("row") == g - 1) | (F.col("col") == 0) | (F.col("col") == g - 1)
    grid = cell.groupBy(*key).agg(F.avg("m").alias("grid_mean"), F.stddev_pop("m").alias("grid_sd"), F.avg(F.when(border, F.col("m"))).alias("edge_mean"))
    out = whole.join(grid, list(key))
    edge = sum(F.col(f"mag_{s}") for s in strips) / 4
    ex, ey = (F.abs(sum(F.col(f"{d}_{s}") for s in strips) / 4) for d in ("dx", "dy"))
    push = ((F.col("right_dx") - F.col("left_dx")) + (F.col("bot_dy") - F.col("top_dy"))) / 2
    pan, tilt = (F.col("left_dx") + F.col("right_dx")) / 2, (F.col("top_dy") + F.col("bot_dy")) / 2

    def balanced(a: Column, b: Column) -> Column:
        return F.least(a, b) / F.greatest(a, b, F.lit(1e-8)) > min(p.symmetry, 0.15)

    symmetric = balanced(F.abs("right_dx"), F.abs("left_dx")) & balanced(F.abs("bot_dy"), F.abs("top_dy"))
    return out.select(
        *key, "mean_dx", "mean_dy", "mean_mag", push.alias("push_score"), pan.alias("pan_score"), tilt.alias("tilt_score"),
        (F.abs(push) / F.col("energy")).alias("ratio_push"), (F.abs(pan) / F.col("energy")).alias("ratio_pan"), (F.abs(tilt) / F.col("energy")).alias("ratio_tilt"),
        symmetric.alias("push_symmetric"), F.when(F.col("grid_mean") < 1e-8, 0.0).otherwise(F.col("grid_sd") / F.col("grid_mean")).alias("tracking_cv"), "edge_mean",
        edge.alias("edge_mag"), (F.col("centre_mag") / F.greatest(edge, F.lit(1e-8))).alias("center_edge_ratio"),
        F.when(ex + ey < 1e-6, 0.0).otherwise(F.greatest(ex, ey) / (ex + ey)).alias("edge_consistency"),
    )


def pair_vote(stats: DataFrame, p: Flow = Flow()) -> DataFrame:
    """Adds vote and score to rows of statistics: the strongest signal that qualifies, of equals the first of MOVEMENTS."""
    c = F.col
    static = F.least((1 / (1 + c("mean_mag") / max(p.static, 0.001))) * p.static_factor, F.lit(0.98))
    side = F.greatest(F.abs("pan_score"), F.abs("tilt_score"))
    radial = (c("ratio_push") >= p.radial) & c("push_symmetric") & ((F.abs("push_score") > side * p.dominance) | (side < p.static))
    off = F.abs(1 - c("center_edge_ratio"))
    able = (c("edge_consistency") > 0.5) & (c("edge_mag") >= p.static * 0.5)
    strong = (c("center_edge_ratio") < 0.75) & (c("tracking_cv") >= p.tracking * 0.4)
    weak = (c("edge_consistency") > 0.65) & (c("tracking_cv") >= p.tracking * 0.3)
    track = F.when(able & strong, c("edge_consistency") * off * 3).when(able & weak, c("edge_consistency") * F.greatest(off, F.lit(0.08)) * 2).otherwise(0.0)
    signals = {
        STATIC: static,
        PUSH: F.when(radial & (c("push_score") > 0), c("ratio_push")),
        PULL: F.when(radial & ~(c("push_score") > 0), c("ratio_push")),
        TRACK: F.when(track > 0.01, F.least(track, F.lit(0.85))),
        PAN: F.when(c("ratio_pan") >= p.pan_tilt, c("ratio_pan")),
        TILT: F.when(c("ratio_tilt") >= p.pan_tilt, c("ratio_tilt")),
    }
    best = F.greatest(*signals.values())
    vote = F.coalesce(*[F.when(v == best, k) for k, v in signals.items()])
    total = sum((F.coalesce(v, F.lit(0.0)) for v in signals.values()), F.lit(0.0)) + 0.01
    return stats.withColumns({"vote": vote, "score": F.least(best / total, F.lit(0.95))})


def clip_vote(votes: DataFrame, clip: str = "clip", p: Flow = Flow(), labels: Sequence[str] = MOVEMENTS) -> DataFrame:
    """movement and confidence of each clip from its pairs' votes (clip, vote, score): shares of weight; push and pull,
    tracking, pan and tilt, static qualify by their own share, the largest wins, in this order on a tie. Where none does,
    the clip is static with its share, or one half if that is more."""
    static, push, pull, track, pan, tilt = labels
    weight = {k: F.coalesce(F.sum(F.when(F.col("vote") == k, F.col("score"))), F.lit(0.0)) for k in labels}
    sums = votes.groupBy(clip).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), *[w.alias(f"w{i}") for i, w in enumerate(weight.values())])
    total = F.col("total")
    w0, w1, w2, w3, w4, w5 = (F.col(f"w{i}") for i in range(6))
    share = {"push": (w1 + w2) / total, "track": w3 / total, "side": (w4 + w5) / total, "static": w0 / total}
    able = {"push": share["push"] >= p.push_vote, "track": share["track"] >= p.tracking_vote, "side": share["side"] >= p.pan_tilt_vote, "static": share["static"] > 0.5}
    name = {"push": F.when(w1 >= w2, push).otherwise(pull), "track": F.lit(track), "side": F.when(w4 >= w5, pan).otherwise(tilt), "static": F.lit(static)}
    values = {k: F.when(able[k], share[k]) for k in share}
    best = F.greatest(*values.values())
    movement = F.coalesce(*[F.when(v == best, name[k]) for k, v in values.items()], F.lit(static))
    confidence = F.coalesce(best, F.greatest(share["static"], F.lit(0.5)))
    return sums.select(clip, F.when(total <= 0, static).otherwise(movement).alias("movement"), F.when(total <= 0, 0.0).otherwise(confidence).alias("confidence"))


def directions(votes: DataFrame, clip: str = "clip", dead: float = 0.1, order: Sequence[str] = ()) -> DataFrame:
    """Direction of pan, tilt and tracking of each clip from sums of scores and of movement times size; null inside the dead
    band. Where a sum is so near to a bound that rounding decides, it is taken row by row by ``order`` and then by value, so
    the result does not depend on partitions."""
    size = F.greatest("mean_mag", F.lit(0.01))
    terms = {"pan": F.col("pan_score"), "tilt": F.col("tilt_score"), "tx": F.col("mean_dx") * size, "ty": F.col("mean_dy") * size}
    places = [F.col(c).alias(f"place{i}") for i, c in enumerate(order)]
    rows = votes.select(F.col(clip).alias("clip"), *places, *[v.alias(k) for k, v in terms.items()])
    s = rows.groupBy("clip").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in terms], *[F.sum(F.abs(k)).alias(f"{k}_size") for k in terms])
    # no two orders of summing n numbers differ by more than n 2**-52 times the sum of their sizes; taken twice
    slack = {k: F.col("n") * F.col(f"{k}_size") * 2.0**-51 for k in terms}
    edges = [F.abs(F.abs(k) - dead) <= slack[k] for k in terms]
    edges.append((F.abs(F.abs("tx") - F.abs("ty")) <= slack["tx"] + slack["ty"]) & (F.abs("tx") + slack["tx"] >= dead))
    # two numbers have one sum
    near = (F.col("n") > 2) & reduce(or_, [F.coalesce(e, F.lit(False)) for e in edges])
    # running sums, which Spark takes row by row and spills where a clip has very many
    w = Window.partitionBy("clip").orderBy(*[f"place{i}" for i in range(len(order))], *terms)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = rows.join(s.where(near).select(F.col("clip").alias("near"), "n"), F.col("clip").eqNullSafe(F.col("near")))
    again = again.select("clip", "n", F.row_number().over(w).alias("at"), *[F.sum(k).over(upto).alias(k) for k in terms]).where("at = n")
    s = s.where(~near).select("clip", *terms).unionByName(again.select("clip", *terms))

    def sided(x: Column, plus: str, minus: str) -> Column:
        return F.when(F.abs(x) < dead, None).when(x > 0, plus).otherwise(minus)

    tx, ty = F.col("tx"), F.col("ty")
    tracking = F.when((F.abs(tx) > F.abs(ty)) & (F.abs(tx) >= dead), F.when(tx > 0, "left").otherwise("right")).when(F.abs(ty) >= dead, F.when(ty > 0, "up").otherwise("down"))
    return s.select(F.col("clip").alias(clip), sided(F.col("pan"), "left", "right").alias("pan_direction"), sided(F.col("tilt"), "up", "down").alias("tilt_direction"), tracking.alias("track_direction"))


def majority(rows: DataFrame, clip: str = "clip") -> DataFrame:
    """label of each clip with the largest sum of confidence, and its share; of equals the first by name."""
    sums = rows.groupBy(clip, "label").agg(F.sum("confidence").alias("weight"))
    total = Window.partitionBy(clip)
    w = total.orderBy(F.desc("weight"), "label")
    ranked = sums.withColumns({"total": F.sum("weight").over(total), "rn": F.row_number().over(w)}).where("rn = 1")
    return ranked.select(clip, "label", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("share"))
