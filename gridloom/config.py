"""Named folders from the environment, a settings file or defaults, in that order."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

PREFIX = "GRIDLOOM_"
KEYS = ("worlds", "properties", "palettes", "environments", "models", "output")


def folders(settings: str | Path | None = None, environ: Mapping[str, str] | None = None, defaults: Mapping[str, str] | None = None) -> dict[str, str]:
    """Every configured folder by name; unknown names in the file are an error."""
    environ = os.environ if environ is None else environ
    stored = json.loads(Path(settings).read_text()) if settings and Path(settings).exists() else {}
    if unknown := set(stored) - set(KEYS):
        raise ValueError(f"unknown folders: {', '.join(sorted(unknown))}")
    out = {}
    for key in KEYS:
        value = environ.get(PREFIX + key.upper()) or stored.get(key) or (defaults or {}).get(key)
        if value:
            out[key] = value
    return out


def required(name: str, configured: Mapping[str, str]) -> str:
    """A folder that must be there, or how to set it."""
    if name not in configured:
        raise KeyError(f"folder '{name}' is not configured: set {PREFIX}{name.upper()} or name it in the settings file")
    return configured[name]
