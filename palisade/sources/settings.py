"""Settings files in YAML, where PyYAML is installed, or JSON, which is a part of it."""

from __future__ import annotations

import json
import sys
from pathlib import Path


def load(path: str | None) -> dict:
    """A file's mapping; a missing file is silent, a broken one or another kind of value warns, and both are empty."""
    try:
        text = Path(path).read_text() if path else ""
    except FileNotFoundError:
        return {}
    try:
        try:
            from yaml import YAMLError, safe_load
        except ImportError:
            YAMLError, safe_load = ValueError, json.loads
        try:
            given = safe_load(text) if text.strip() else {}
        except YAMLError as e:
            raise ValueError(e) from e
        if not isinstance(given, dict):
            raise ValueError("not a mapping")
        return given
    except ValueError as e:
        print(f"warning: {path}: {e}", file=sys.stderr)
        return {}


def secret_rules(path: str) -> list[tuple[str, str, int]]:
    """Rules (name, regex, group) of a file with a list "rules" of id or name, pattern or regex, and group (0); broken ones raise."""
    import re

    out = []
    for r in load(path).get("rules") or []:
        name, regex = r.get("id") or r.get("name"), r.get("pattern") or r.get("regex")
        if not name or not regex:
            raise ValueError(f"{path}: a rule needs a name and a pattern")
        re.compile(regex)
        out.append((str(name), str(regex), int(r.get("group", 0))))
    return out
