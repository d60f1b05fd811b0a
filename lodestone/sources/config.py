"""Settings as nested mappings: one file may extend another, the environment and single overrides come last."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from pathlib import Path


def merged(base: Mapping, over: Mapping) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(path: str | Path, read: Callable[[str], Mapping] = json.loads) -> dict:
    """The settings of a file over those that it extends, nearest last; a circle of files is refused."""
    seen, chain, at = set(), [], Path(path).resolve()
    while at is not None:
        if at in seen:
            raise ValueError(f"{at} extends itself")
        seen.add(at)
        own = dict(read(at.read_text()) or {})
        parent = own.pop("extends", None)
        chain.append(own)
        at = (at.parent / parent).resolve() if parent else None
    out: dict = {}
    for own in reversed(chain):
        out = merged(out, own)
    return out


def override(settings: Mapping, assignments: list[str]) -> dict:
    """settings with 'section.field=value' applied; the field must exist, the value takes the kind of the old one."""
    out = merged({}, settings)
    for a in assignments:
        path, eq, raw = a.partition("=")
        *sections, field = path.split(".")
        node = out
        for s in sections:
            if not isinstance(node.get(s), dict):
                raise ValueError(f"no section {s} in {a}")
            node[s] = dict(node[s])
            node = node[s]
        if not eq or field not in node:
            raise ValueError(f"no such setting: {a}")
        old = node[field]
        node[field] = raw.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(raw) if old is not None else raw
    return out
