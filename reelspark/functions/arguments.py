"""Arguments of a cutting tool as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decoder and encoders by accelerator.
ACCELERATORS = {
    "cuda": ("cuda", "h264_nvenc", "hevc_nvenc"),
    "qsv": ("qsv", "h264_qsv", "hevc_qsv"),
    "amf": ("dxva2", "h264_amf", "hevc_amf"),
    "videotoolbox": ("videotoolbox", "h264_videotoolbox", "hevc_videotoolbox"),
}
#: Presets by accelerator; others stay as they are.
PRESETS = {
    "cuda": {"ultrafast": "p1", "superfast": "p2", "veryfast": "p3", "faster": "p4", "fast": "p5", "medium": "p5", "slow": "p6", "slower": "p7", "veryslow": "p7"},
    "qsv": {"ultrafast": "veryfast", "superfast": "veryfast"},
    "amf": {"ultrafast": "speed", "superfast": "speed", "veryfast": "speed", "faster": "speed", "fast": "balanced", "medium": "balanced", "slow": "quality", "slower": "quality", "veryslow": "quality"},
}
#: Names of the two codecs, bit rates by quality and the rate that others take.
H264, HEVC = ("libx264", "h264"), ("libx265", "hevc", "h265")
BIT_RATES, BIT_RATE = {18: "8M", 20: "6M", 23: "4M", 26: "3M", 28: "2M"}, "4M"
#: Characters that a filter's path has a backslash before.
FILTER_MARKS = (":", ";", "[", "]", ",")


def filter_path(path: Column) -> Column:
    """A path inside a filter: forward slashes, single quotes closed and opened again, marks after a backslash, all in quotes."""
    plain = F.replace(F.translate(path, "\\", "/"), F.lit("'"), F.lit("'\\''"))
    marks = "".join(f"\\{m}" for m in FILTER_MARKS)
    return F.concat(F.lit("'"), F.regexp_replace(plain, f"([{marks}])", r"\\$1"), F.lit("'"))


def seconds_argument(frame: Column, fps_num: Column | int, fps_den: Column | int) -> Column:
    """A frame's time with nine places."""
    num, den = (F.lit(v) if isinstance(v, int) else v for v in (fps_num, fps_den))
    return F.format_string("%.9f", (frame * den).cast("double") / num)


def encoder(codec: str, preset: str, accelerator: str | None = None) -> tuple[str | None, str, str]:
    """(decoder, encoder, preset) for an accelerator; the given ones without a known accelerator."""
    if accelerator not in ACCELERATORS:
        return None, codec, preset
    decoder, h264, hevc = ACCELERATORS[accelerator]
    chosen = h264 if codec.lower() in H264 else hevc if codec.lower() in HEVC else codec
    return decoder, chosen, PRESETS.get(accelerator, {}).get(preset, preset)


def quality_arguments(crf: Column, chosen: str, accelerator: str | None = None, mode: str = "vbr", spatial: bool = True, temporal: bool = True, ahead: int = 20, low: int = 0, high: int = 2) -> Column:
    """array of arguments that set the quality of the encoder ``chosen``; a plain ``-crf`` where it is not the accelerator's."""

    def listed(*parts: str | Column) -> Column:
        return F.array(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    if accelerator == "cuda" and "nvenc" in chosen:
        rates = ("-rc:v", mode, "-cq:v", crf, "-qmin", crf + low, "-qmax", crf + high)
        return listed(*rates, "-spatial_aq", str(int(spatial)), "-temporal_aq", str(int(temporal)), "-rc-lookahead", str(ahead))
    if accelerator == "qsv" and "qsv" in chosen:
        return listed("-global_quality", crf, "-look_ahead", "1")
    if accelerator == "amf" and "amf" in chosen:
        return listed("-rc", "cqp", "-qp_i", crf, "-qp_p", crf, "-qp_b", crf)
    if accelerator == "videotoolbox" and "videotoolbox" in chosen:
        rates = F.create_map(*[F.lit(v) for pair in BIT_RATES.items() for v in pair])
        return listed("-b:v", F.coalesce(F.try_element_at(rates, crf.cast("int")), F.lit(BIT_RATE)))
    return listed("-crf", crf)
