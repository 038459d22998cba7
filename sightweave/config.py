"""Typed settings of the reconcile and its checks, read from plain nested dicts."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from numbers import Real

log = logging.getLogger(__name__)

SCORING_MODES = ("prototype", "max_exemplar", "consensus")


def camera_bars(overrides: object) -> dict[str, float]:
    """Per-camera same-camera bars: camera -> {"same_camera_threshold": bar in [0, 1]}.

    Anything else (other keys, other types, values out of range, not a mapping) is ignored and
    logged, so one bad entry never stops a run.
    """
    if overrides is None:
        return {}
    if not isinstance(overrides, dict):
        log.warning("per-camera settings are not a mapping; ignored")
        return {}
    bars: dict[str, float] = {}
    for camera, block in overrides.items():
        if not isinstance(block, dict):
            log.warning("settings of camera %s are not a mapping; ignored", camera)
            continue
        for name, value in block.items():
            if name != "same_camera_threshold":
                log.warning("camera %s: setting %s can't be overridden; ignored", camera, name)
            elif isinstance(value, bool) or not isinstance(value, Real) or not 0 <= float(value) <= 1:
                log.warning("camera %s: bar %r is no number from 0 to 1; ignored", camera, value)
            else:
                bars[str(camera)] = float(value)
    return bars


def merged(base: dict, override: dict | None) -> dict:
    """Settings with a camera's own block over the general ones; the later value wins."""
    return {**base, **(override or {})}


@dataclass(frozen=True)
class DetectorConfig:
    """What counts as a detected person."""

    confidence: float = 0.4
    class_id: int = 0


@dataclass(frozen=True)
class ReconcileConfig:
    """Bars and limits of the offline reconcile."""

    cross_bar: float = 0.70
    same_bar: float = 0.90
    bars: dict[str, float] = field(default_factory=dict)
    min_observations: int = 3
    reciprocal: bool = True
    scoring: str = "prototype"
    top_frac: float = 0.25
    cap: int = 64
    compat: bool = False

    def __post_init__(self) -> None:
        if self.scoring not in SCORING_MODES:
            log.warning("unknown scoring mode %r; prototype is used", self.scoring)
            object.__setattr__(self, "scoring", "prototype")

    def bar(self, camera: str) -> float:
        return self.bars.get(camera, self.same_bar)
