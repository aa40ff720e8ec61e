"""Driver-side configuration and single JSON documents."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path
from typing import Any


def resolve_path(value: str, name: str) -> Path:
    """A path with ``~`` and environment variables expanded; blank values and variables that are not set are errors."""
    if not value.strip():
        raise ValueError(f"{name} is blank")
    named = {a or b for a, b in re.findall(r"\$(?:(\w+)|\{([^}]*)\})", value)}
    if unset := sorted(named.difference(os.environ)):
        raise ValueError(f"{name}: {', '.join(unset)} not set")
    return Path(os.path.expandvars(value)).expanduser()


def deep_merge(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers win; mappings are merged key by key, everything else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def write_json(value: object, path: str | Path, exclusive: bool = True) -> None:
    """One JSON document, complete or not there at all; numbers that JSON lacks are an error."""
    path = Path(path)
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"
    handle, part = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        if exclusive:
            os.link(part, path)
        else:
            os.replace(part, path)
    finally:
        Path(part).unlink(missing_ok=True)


def write_snapshot(settings: dict[str, Any], path: str | Path) -> None:
    """The resolved settings of a run, once; JSON is YAML, too."""
    write_json(settings, path, exclusive=True)


def write_once(value: dict[str, Any], path: str | Path, identity) -> bool:
    """Write unless the same identity is there already; another identity at the path is an error."""
    path = Path(path)
    if path.exists():
        if identity(json.loads(path.read_text(encoding="utf-8"))) != identity(value):
            raise FileExistsError(f"{path} holds another document")
        return False
    write_json(value, path)
    return True
