"""Run configurations: JSON objects that extend others."""

from __future__ import annotations

import json
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """over on top of base: objects merge, anything else replaces."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """The configuration with what it extends, paths being relative to the file that names them."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"configurations extend each other in a circle: {path}")
    own = json.loads(path.read_text())
    base = own.pop("extends", None)
    return merged(load(path.parent / base, (*seen, path)), own) if base else own
