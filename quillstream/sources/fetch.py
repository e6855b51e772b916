"""Files from elsewhere: exemplars by address, models by name. Transports are given, so that no network is needed here."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from .. import config
from ..operators.scorers import MODEL_PAIRS

# Fixed values.
ATTEMPTS, LEAST_BYTES, MAGIC = 3, 100_000, b"%PDF"


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=120) as answer:
        return answer.read()


def exemplar(url: str, path: str, get: Callable[[str], bytes] = _get) -> bool:
    """Fetch a PDF once: at most three attempts, kept only if it is one and no stub. True if the file is there."""
    file = Path(path)
    if file.exists():
        return True
    for _ in range(ATTEMPTS):
        try:
            data = get(url)
        except (urllib.error.URLError, OSError):
            continue
        if len(data) > LEAST_BYTES and data.startswith(MAGIC):
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(data)
            return True
    return False


def _snapshot(repository: str) -> str:
    try:
        from huggingface_hub import snapshot_download
    except ImportError as e:
        raise RuntimeError("fetching models needs huggingface_hub, which is not installed") from e
    return snapshot_download(repository)


def models(folder: str | None, pair: str | None, more: list[str], fetch: Callable[[str], str] = _snapshot) -> list[str]:
    """Remember ``folder`` for later runs and fetch a pair's models and ``more``; where they are now."""
    if pair and pair not in MODEL_PAIRS:
        raise ValueError(f"a pair is one of {', '.join(MODEL_PAIRS)}")
    if folder:
        config.remember_models_dir(folder)
    where = config.models_dir()
    if where:
        Path(where).mkdir(parents=True, exist_ok=True)
        os.environ["HF_HOME"] = where
    return [fetch(r) for r in [*more, *(MODEL_PAIRS[pair] if pair else ())]]
