"""Models and decoders as callables, and stand-ins that always give the same.

A seam is a function over a batch. ``by_batch`` runs it on the executors over Arrow batches, loaded once for each task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: English names of shot scales and their labels.
SHOT_SCALES = {"extreme_close_up": "大特写", "close_up": "特写", "medium": "中景", "full": "全景", "long": "远景"}


class Encoder(Protocol):
    """Texts or pictures to unit vectors."""

    def __call__(self, items: Sequence[str | bytes]) -> np.ndarray: ...


class Reranker(Protocol):
    """Scores between 0 and 1 of pairs of a picture and a text."""

    def __call__(self, frames: Sequence[bytes], texts: Sequence[str]) -> Sequence[float]: ...


class Verifier(Protocol):
    """Answers to questions about pictures, as text."""

    def __call__(self, frames: Sequence[bytes], questions: Sequence[str]) -> Sequence[str]: ...


class ShotAnalyser(Protocol):
    """(scale, movement) of clips; None where it can't say."""

    def __call__(self, frames: Sequence[bytes]) -> Sequence[tuple[str | None, str | None]]: ...


class FlowField(Protocol):
    """Displacements (dx, dy) of two gray pictures, each height by width."""

    def __call__(self, before: np.ndarray, after: np.ndarray) -> np.ndarray: ...


class FrameSource(Protocol):
    """Numbers of a video's frames to pictures; frames that can't be read are missing."""

    def __call__(self, path: str, frames: Sequence[int]) -> dict[int, bytes]: ...


def hashed_encoder(dim: int = 64) -> Encoder:
    """A stand-in: unit vectors from a hash of each item."""

    def encode(items: Sequence[str | bytes]) -> np.ndarray:
        out = np.zeros((len(items), dim))
        for i, x in enumerate(items):
            raw = x.encode() if isinstance(x, str) else bytes(x)
            out[i] = np.random.default_rng(int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")).normal(size=dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def hashed_score(frames: Sequence[bytes], texts: Sequence[str]) -> list[float]:
    """A stand-in reranker: the first 32 bits of a hash as a share of all."""
    return [int(hashlib.sha256(bytes(f) + t.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF for f, t in zip(frames, texts)]


def block_motion(before: np.ndarray, after: np.ndarray, block: int = 8, reach: int = 3) -> np.ndarray:
    """A stand-in flow: for each block the shift with the least absolute difference, the shortest of equals."""
    h, w = before.shape
    out = np.zeros((h, w, 2), np.float32)
    shifts = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))
    for y in range(0, h, block):
        for x in range(0, w, block):
            a = before[y : y + block, x : x + block].astype(int)
            best = None
            for dy, dx in shifts:
                if 0 <= y + dy and y + dy + a.shape[0] <= h and 0 <= x + dx and x + dx + a.shape[1] <= w:
                    cost = np.abs(a - after[y + dy : y + dy + a.shape[0], x + dx : x + dx + a.shape[1]].astype(int)).sum()
                    if best is None or cost < best[0]:
                        best = (cost, dx, dy)
            out[y : y + block, x : x + block] = best[1:] if best else (0, 0)
    return out


def encoded(rows: DataFrame, column: str, load: Callable[[], Encoder], out: str = "vec", batch: int = 128) -> DataFrame:
    """Adds the vectors of a text or binary column. ``load`` is called once in each task."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", {out} array<float>"

    def run(batches: Iterable[pa.RecordBatch]):
        encode = None
        for whole in batches:
            encode = encode or load()
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vecs = np.asarray(encode([x if x is not None else "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vecs.tolist(), pa.list_(pa.float32()))], [*part.schema.names, out])

    return rows.mapInArrow(run, schema)


def rerank_scores(rows: DataFrame, frame: str, text: str, load: Callable[[], Reranker], batch: int = 4) -> DataFrame:
    """Adds score; null where the picture is missing."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double"

    def run(batches: Iterable[pa.RecordBatch]):
        score = None
        for whole in batches:
            score = score or load()
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                frames, texts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (frame, text))
                have = [i for i, f in enumerate(frames) if f is not None]
                found = dict(zip(have, score([frames[i] for i in have], [texts[i] for i in have]))) if have else {}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([found.get(i) for i in range(part.num_rows)], pa.float64())], [*part.schema.names, "score"])

    return rows.mapInArrow(run, schema)


def answered(rows: DataFrame, frame: str, question: str, load: Callable[[], Verifier], batch: int = 4) -> DataFrame:
    """Adds answer; null where the picture is missing. A verifier that fails ends the job."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", answer string"

    def run(batches: Iterable[pa.RecordBatch]):
        ask = None
        for whole in batches:
            ask = ask or load()
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                frames, questions = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (frame, question))
                have = [i for i, f in enumerate(frames) if f is not None]
                found = dict(zip(have, ask([frames[i] for i in have], [questions[i] for i in have]))) if have else {}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([found.get(i) for i in range(part.num_rows)], pa.string())], [*part.schema.names, "answer"])

    return rows.mapInArrow(run, schema)


def analysed(rows: DataFrame, frame: str, load: Callable[[], ShotAnalyser], unknown: str = "未知") -> DataFrame:
    """Adds shot and movement; unknown where the analyser fails or can't say."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", shot string, movement string"

    def run(batches: Iterable[pa.RecordBatch]):
        look = None
        for part in batches:
            look = look or load()
            out = []
            for f in part.column(part.schema.get_field_index(frame)).to_pylist():
                try:
                    shot, movement = look([f])[0] if f is not None else (None, None)
                except Exception:  # noqa: BLE001  one clip that fails is an unknown one
                    shot, movement = None, None
                out.append((shot or unknown, movement or unknown))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a, pa.string()), pa.array(b, pa.string())], [*part.schema.names, "shot", "movement"])

    return rows.mapInArrow(run, schema)


def decoded_frames(requests: DataFrame, load: Callable[[], FrameSource]) -> DataFrame:
    """video_path, frame_no, picture for requested frames. Requests are made distinct and dealt by video, and a task decodes a
    video once; large videos are parted by ranges of frames, so no task takes an unbounded number."""
    wanted = requests.select("video_path", "frame_no").distinct()
    part = (wanted["frame_no"] / 30_000).cast("long")
    dealt = wanted.repartition("video_path", part).sortWithinPartitions("video_path", "frame_no")

    def run(batches: Iterable[pa.RecordBatch]):
        source = None
        for batch in batches:
            source = source or load()
            by_video: dict[str, list[int]] = {}
            for path, frame in zip(*(c.to_pylist() for c in batch.columns)):
                by_video.setdefault(path, []).append(frame)
            for path, frames in by_video.items():
                for at in range(0, len(frames), 30):
                    found = source(path, frames[at : at + 30])
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["video_path", "frame_no", "picture"])

    return dealt.mapInArrow(run, "video_path string, frame_no long, picture binary")


def flow_cells(pairs: DataFrame, load: Callable[[], FlowField], width: int = 320, height: int = 240, step: int = 1) -> DataFrame:
    """Vectors of the flow between gray pictures ``before`` and ``after`` (height by width bytes): clip, pair_no, x, y, dx, dy."""

    def run(batches: Iterable[pa.RecordBatch]):
        field = None
        for batch in batches:
            field = field or load()
            for clip, pair, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if a is None or b is None:
                    continue
                flow = field(*(np.frombuffer(x, np.uint8).reshape(height, width) for x in (a, b)))[::step, ::step]
                y, x = np.mgrid[: flow.shape[0], : flow.shape[1]]
                n = x.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([clip] * n), pa.array(np.full(n, pair, np.int64)), pa.array(x.ravel().astype(np.int32)), pa.array(y.ravel().astype(np.int32)), pa.array(flow[..., 0].ravel().astype(float)), pa.array(flow[..., 1].ravel().astype(float))],
                    ["clip", "pair_no", "x", "y", "dx", "dy"],
                )

    return pairs.select("clip", "pair_no", "before", "after").mapInArrow(run, "clip string, pair_no long, x int, y int, dx double, dy double")
