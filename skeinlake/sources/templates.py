"""Rule templates from YAML files, and engine options."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path
from typing import ClassVar

from ..operators.rules import TemplateError, validate

MOST_BYTES = 64 << 10


def _no_repeats(yaml):
    class Loader(yaml.SafeLoader):
        """Refuses a key that stands twice in a mapping."""

    def mapping(loader, node, deep=False):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=deep)
            if key in out:
                raise TemplateError(f"key {key!r} twice")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Loader


def load(folder: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """(valid templates by file name, (file, error) of the others). A second template of an id is an error; the rest is kept."""
    import yaml

    loader = _no_repeats(yaml)
    found, errors, ids = [], [], set()
    for p in sorted(x for x in Path(folder).iterdir() if x.suffix in (".yaml", ".yml")):
        try:
            if p.stat().st_size > MOST_BYTES:
                raise TemplateError("file is too large")
            held = yaml.load(p.read_text("utf-8"), Loader=loader)  # noqa: S506
            if not isinstance(held, dict):
                raise TemplateError("no mapping")
            validate(held)
            if held["id"] in ids:
                raise TemplateError(f"id {held['id']} twice")
            ids.add(held["id"])
            found.append(held)
        except (OSError, UnicodeError, yaml.YAMLError, TemplateError, ValueError) as e:
            errors.append((p.name, str(e)))
    return found, errors


@dataclass
class Options:
    """Engine options: defaults, then a JSON, YAML or TOML file, then the environment (SKEINLAKE_NAME), each within its bounds."""

    max_depth: int = 3
    max_items: int = 10_000
    simhash_distance: int = 3
    history_limit: int = 500

    BOUNDS: ClassVar[dict[str, tuple[int, int]]] = {"max_depth": (0, 20), "max_items": (1, 10_000_000), "simhash_distance": (0, 16), "history_limit": (1, 500)}

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Options:
        held: dict = {}
        if path:
            text = Path(path).read_text("utf-8")
            if path.endswith(".toml"):
                import tomllib

                held = tomllib.loads(text)
            elif path.endswith(".json"):
                held = json.loads(text)
            else:
                import yaml

                held = yaml.safe_load(text) or {}
        env = dict(os.environ) if env is None else env
        names = [f.name for f in fields(cls)]
        if unknown := set(held) - set(names):
            raise ValueError(f"unknown options {sorted(unknown)}")
        held |= {n: env[f"SKEINLAKE_{n.upper()}"] for n in names if f"SKEINLAKE_{n.upper()}" in env}
        out = cls(**{n: int(v) for n, v in held.items()})
        for n, (lo, hi) in cls.BOUNDS.items():
            if not lo <= getattr(out, n) <= hi:
                raise ValueError(f"{n} must lie in {lo}..{hi}")
        return out


def plugins(group: str = "skeinlake.plugins") -> dict:
    """Entry points of the group that load; others are passed over."""
    from importlib.metadata import entry_points

    found = {}
    for e in entry_points(group=group):
        try:
            found[e.name] = e.load()
        except Exception:  # noqa: BLE001, S112  a broken plugin must not keep the engine from starting
            continue
    return found
