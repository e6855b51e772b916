"""Where local model files are: the environment variable wins over the remembered folder."""

from __future__ import annotations

import json
import os
from pathlib import Path

VARIABLE = "QUILLSTREAM_MODELS"


def folder() -> Path:
    """The user's folder of settings and calibration records."""
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "quillstream"


def _file() -> Path:
    return folder() / "config.json"


def remember_models_dir(folder: str) -> None:
    _file().parent.mkdir(parents=True, exist_ok=True)
    _file().write_text(json.dumps({"models_dir": str(Path(folder).expanduser().resolve())}))


def models_dir() -> str | None:
    if os.environ.get(VARIABLE):
        return os.environ[VARIABLE]
    try:
        return json.loads(_file().read_text()).get("models_dir")
    except (OSError, ValueError):
        return None
