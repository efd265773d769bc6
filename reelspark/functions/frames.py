"""Frame numbers: times, offsets, plans of frames, picture sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rate that stands in where a rate is missing or not positive.
FPS = 25.0


def rate(fps: Column) -> Column:
    return F.when(fps > 0, fps.cast("double")).otherwise(F.lit(FPS))


def seconds(frame: Column, fps: Column) -> Column:
    return frame / rate(fps)


def rational_seconds(frame: Column, num: Column, den: Column) -> Column:
    """frame * den / num with nine decimals, as text."""
    return F.format_string("%.9f", (frame.cast("double") * den) / num)


def timecode(s: Column) -> Column:
    """HH:MM:SS.mmm; negative times are 0."""
    ms = F.floor(F.greatest(s.cast("double"), F.lit(0.0)) * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def duration_text(s: Column) -> Column:
    """MM:SS, from an hour HH:MM:SS; parts of a second are cut off."""
    t = F.floor(F.greatest(s.cast("double"), F.lit(0.0))).cast("long")
    short = F.format_string("%02d:%02d", F.floor(t / 60), t % 60)
    return F.when(t >= 3600, F.format_string("%02d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)).otherwise(short)


def shifted_start(start: Column, offset: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), start.cast("long") + offset)


def shifted_end(start: Column, end: Column, first: int, last: int) -> Column:
    """The shifted end, at least one frame after the shifted start."""
    return F.greatest(shifted_start(start, first) + 1, end.cast("long") + last)


def frame_at(s: Column, fps: Column) -> Column:
    return F.floor(s * fps).cast("long")


def middle(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def target_frame(start: Column, end: Column, which: Column) -> Column:
    """Start, end or middle frame of a scene for frame index 0, 2 or anything else."""
    return F.when(which == 0, start.cast("long")).when(which == 2, end.cast("long")).otherwise(middle(start, end))


def window_plan(start: Column, end: Column, most: int = 30) -> Column:
    """Frames about the middle of a scene, ``most`` at most; a scene without length has its middle alone."""
    mid = middle(start, end)
    n = F.least(F.lit(most).cast("long"), (end - start).cast("long"))
    first = F.greatest(start.cast("long"), mid - F.floor(n / 2).cast("long"))
    plan = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1).cast("long")) - 1), lambda i: F.least(end.cast("long"), first + i))
    return F.when(n > 0, plan).otherwise(F.array(mid))


def even_picks(n: Column, most: int) -> Column:
    """Positions of at most ``most`` of n items at even distances, first and last included."""
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long")) - 1)
    some = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("long")) if most > 1 else F.array(F.lit(0).cast("long"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= most, every).otherwise(some)


def seek(frame: Column, fps: Column, lead: float = 2.0) -> tuple[Column, Column]:
    """(seconds to seek to, frames from there) for a preview; the lead is 2 seconds, 1 for single frames."""
    at = F.greatest(F.lit(0.0), seconds(frame, fps) - lead)
    return at, (frame - F.floor(at * rate(fps))).cast("long")


def frame_count(nb: Column, duration: Column, fps: Column, decoded: Column) -> Column:
    """Stored count, else duration times rate, else the decoded count."""
    return F.coalesce(F.nullif(nb, F.lit(0)).cast("long"), F.nullif(F.floor(duration * fps).cast("long"), F.lit(0).cast("long")), decoded.cast("long"))


def constant_rate(real: Column, average: Column) -> Column:
    """Whether two rates are equal up to a millionth."""
    return F.abs(real - average) <= F.greatest(F.lit(1e-6), real * 1e-6)


def scaled(width: Column, height: Column, short: int, up: bool = False) -> tuple[Column, Column]:
    """(width, height) with the short side at ``short`` and both even; odd sizes go down by one, or up where ``up``."""
    factor = short / F.least(width, height)

    def even(x: Column) -> Column:
        x = F.floor(x * factor + (0.5 if up else 0.0)).cast("long")
        return x + x % 2 if up else x - x % 2

    wide = width >= height
    return F.when(wide, even(width)).otherwise(F.lit(short).cast("long")), F.when(wide, F.lit(short).cast("long")).otherwise(even(height))


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    n = n.cast("double")
    out = F.format_string("%.1f GB", n / 1024**3)
    for at, unit in ((1024**3, "MB"), (1024**2, "KB")):
        out = F.when(n < at, F.format_string(f"%.1f {unit}", n / (at / 1024))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.0f B", n)).otherwise(out)


def black_clip(start: Column, end: Column) -> Column:
    """Whether a first black stretch covers the head of a clip."""
    return F.coalesce((start < 0.1) & (end > 0.5), F.lit(False))


#: Numbers of patches that an encoder takes.
PATCHES = (128, 256, 576, 784, 1024)


def patch_bucket(width: Column, height: Column, patch: int = 16) -> Column:
    """The smallest number of PATCHES that holds a picture's patches, the largest where none does."""
    n = F.floor(width / patch) * F.floor(height / patch)
    out = F.lit(PATCHES[-1])
    for size in reversed(PATCHES[:-1]):
        out = F.when(n <= size, size).otherwise(out)
    return out
