"""Calibration records kept as files: ``threshold-<name>.json``, the user's before the shipped ones.

A file that is found counts whole: keys it lacks take defaults, not another file's values.
"""

from __future__ import annotations

import json
from pathlib import Path

from .. import config

PLACEHOLDER, RED, AMBER = 0.90, 0.5, 0.35
#: Records that come with the package, by name: those published for neural model pairs and for a window classifier
#: (``band``). They do not apply to the stand-in scorers. Fixed values.
SHIPPED: dict[str, dict] = {
    "small": {"threshold": 0.9662},
    "big": {"threshold": 0.9777},
    "gemma-mlx": {"threshold": 0.784, "amber": 0.8391},
    "gemma-mlx-tech": {"threshold": 0.8019, "amber": 0.8147},
    "band": {"threshold": 0.5, "amber": 0.5},
    "band-tech": {"threshold": 0.5, "amber": 0.5},
}


def folder() -> Path:
    return config.folder() / "thresholds"


def save(name: str, record: dict, where: Path | None = None) -> Path:
    path = (where or folder()) / f"threshold-{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=2) + "\n")
    return path


def load(name: str, where: Path | None = None) -> dict:
    """The user's record, or else the shipped one, or an empty one."""
    path = (where or folder()) / f"threshold-{name}.json"
    return json.loads(path.read_text()) if path.exists() else dict(SHIPPED.get(name, {}))


def pair(name: str, explicit: float | None = None, where: Path | None = None) -> tuple[float, float | None, bool]:
    """(threshold, amber, calibrated): explicit before saved before the placeholder; amber is the saved one."""
    saved = load(name, where)
    threshold = explicit if explicit is not None else saved.get("threshold")
    return (PLACEHOLDER if threshold is None else threshold), saved.get("amber"), threshold is not None


def band(tag: str = "", where: Path | None = None) -> tuple[float, float, bool]:
    """(red, amber, fitted) of the window classifier's band."""
    saved = load(f"band-{tag}" if tag else "band", where)
    return saved.get("threshold", RED), saved.get("amber", AMBER), bool(saved)


def band_note(red: float, amber: float, fitted: bool) -> str | None:
    """What a reader should know of the band before a report."""
    if not fitted:
        return f"amber band at fixed {amber}: calibrate to fit it"
    if amber >= red:
        return "amber band empty: over a tenth of the human windows score red, so no edge below red means anything"
    return None
