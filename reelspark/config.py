"""Settings of the retrieval plans, one value for each."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Base thresholds by model and their defaults.
THRESHOLDS = {"clip": 21.0, "fgclip2": 14.0}
RERANK_THRESHOLD, RERANK_WEIGHT = 51.0, 0.6
#: Texts that stand for "not set".
UNSET = ("", "none", "null", "unlimited", "default", "auto", "默认", "不限")


@dataclass(frozen=True)
class Settings:
    """Defaults are those of the label pipeline; a call may override any."""

    logit_scale: float = 100.0
    threshold: float = 21.0
    rerank_weight: float = 0.0
    rerank_threshold: float = RERANK_THRESHOLD
    candidates: int = 50
    shortlist: int = 3
    top_k: int | None = None
    search_mode: int = 1
    dedup_threshold: float = 0.95
    merge_gap: int | None = None
    min_matches: int = 4
    sample_step: int = 5
    minima_order: int = 2
    boundary_threshold: float = 0.85
    min_scene: int = 7
    start_offset: int = -2
    end_offset: int = 2
    required: tuple[str, ...] = field(default=())

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


def model_kind(name: str) -> str:
    """The model family that a name says: fgclip2, reranker, qwen, clip or auto."""
    low = (name or "").lower()
    for kind, marks in (("fgclip2", ("fgclip2", "fg-clip2", "fg_clip2")), ("reranker", ("reranker",)), ("qwen", ("qwen",)), ("clip", ("clip",))):
        if any(m in low for m in marks):
            return kind
    return "auto"


def threshold_for(model: str, rerank: bool = False, base: dict[str, float] | None = None, rerank_at: float = RERANK_THRESHOLD, weight: float = RERANK_WEIGHT) -> float:
    """Threshold of a model; with a reranker ``base * (1 - weight) + rerank_at * weight``."""
    base = base or THRESHOLDS
    value = base["fgclip2"] if model_kind(model) == "fgclip2" else base["clip"]
    return value * (1 - weight) + rerank_at * weight if rerank else value


def recall_threshold(threshold: float, rerank: bool, weight: float) -> float:
    """The relaxed threshold of the first pass before a reranker."""
    return max(5.0, 0.5 * threshold) if rerank and weight > 0 else threshold


def optional_int(value: object, name: str = "value") -> int | None:
    """None for unset texts and numbers up to 0; ValueError for anything that is no number."""
    if value is None or isinstance(value, str) and value.strip().lower() in UNSET:
        return None
    try:
        number = int(float(value))
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a number or unset, not {value!r}") from None
    return number if number > 0 else None
