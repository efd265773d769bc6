"""Vector columns: dot products, norms, truncation, pixel shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double; null where lengths differ or a side is null."""
    a, b = doubles(a), doubles(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column | str, floor: float = 0.0) -> Column:
    """Unit vector; ``floor`` is added to the norm. A zero vector stays where the floor is 0."""
    v = doubles(v)
    n = norm(v) + F.lit(floor)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def truncate(v: Column | str, dim: int, floor: float = 0.0) -> Column:
    """The first ``dim`` components, normalised again."""
    return normalise(F.slice(doubles(v), 1, dim), floor)


def mean_of(a: Column | str, b: Column | str) -> Column:
    """Componentwise mean, not normalised."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)


def dark_share(pixels: Column | str, level: float) -> Column:
    p = doubles(pixels)
    return F.size(F.filter(p, lambda x: x < level)) / F.size(p)


def bright_share(pixels: Column | str, level: float) -> Column:
    p = doubles(pixels)
    return F.size(F.filter(p, lambda x: x > level)) / F.size(p)


def dead_frame(pixels: Column | str, black: float | None, black_pct: float, white: float | None, white_pct: float) -> Column:
    """'black', 'white' or null for gray values; black is tested first, a level of None or 0 turns a test off."""
    out = F.lit(None).cast("string")
    if white:
        out = F.when(bright_share(pixels, white) >= white_pct / 100, "white").otherwise(out)
    if black:
        out = F.when(dark_share(pixels, black) >= black_pct / 100, "black").otherwise(out)
    return out


def blended(similarity: Column, rerank: Column, weight: float) -> Column:
    """similarity * (1 - weight) + rerank * 100 * weight; the similarity alone where there is no rerank score."""
    return F.when(rerank.isNull(), similarity).otherwise(similarity * (1 - weight) + rerank * 100 * weight)


def boosted(similarity: Column, score: Column) -> Column:
    """similarity + 50 * score, where scores over 1 are per cent."""
    return similarity + 50 * unit_score(score)


def unit_score(score: Column) -> Column:
    return F.when(score > 1, score / 100).otherwise(score)


def yes_no_probability(yes: Column, no: Column) -> Column:
    """The sigmoid of the difference of two logits."""
    return 1 / (1 + F.exp(no - yes))


def softmax_best(scores: Column | str) -> Column:
    """struct(label, confidence) of the largest of an array of logits; labels count from 0, the first of equals wins."""
    v = doubles(scores)
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.struct((F.array_position(v, top) - 1).cast("int").alias("label"), (1 / total).alias("confidence"))
