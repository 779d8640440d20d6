"""Settings: project lists, scoring knobs and vocabularies, read on the driver from small files."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field

from graphloom.functions import scalars as S

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}")
#: What the names of variables that set a knob begin with.
KNOB_PREFIX = "CK_SCORING_"


def expand(value: object, env: Mapping[str, str]) -> object:
    """``value`` with ``${NAME}`` and ``${NAME:-default}`` replaced in every text; an unknown name without a default is an error."""
    if isinstance(value, str):

        def put(m: re.Match) -> str:
            if m.group(1) in env:
                return env[m.group(1)]
            if m.group(2) is None:
                raise ValueError(f"unknown variable {m.group(1)}")
            return m.group(2)

        return _VARIABLE.sub(put, value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return [expand(v, env) for v in value] if isinstance(value, list) else value


def read_config(text: str, env: Mapping[str, str]) -> dict:
    """A TOML configuration with its variables expanded and its projects checked."""
    config = expand(tomllib.loads(text), env)
    config["projects"] = checked_projects(config.get("projects", []))
    return config


def checked_projects(projects: list[dict], exists=None) -> list[dict]:
    """Projects (name, path): names of letters, digits, dots and dashes, unlike; paths relative, not empty, and there if ``exists`` is given."""
    seen: set[str] = set()
    for p in projects:
        name, path = str(p.get("name", "")), str(p.get("path", ""))
        parts = path.replace("\\", "/").split("/")
        fault = "name" if not _NAME.fullmatch(name) else "twice" if name in seen else "path" if not path or path.startswith(("/", "~")) or ".." in parts or ":" in parts[0] else "missing" if exists and not exists(path) else None
        if fault:
            raise ValueError(f"project {name!r} at {path!r}: {fault}")
        seen.add(name)
    return projects


@dataclass
class Knobs:
    """Values of the scoring: defaults, over which a section of the configuration goes, over which variables go."""

    tiers: dict[str, float] = field(default_factory=lambda: dict(S.TIER_WEIGHT))
    tier_default: float = S.TIER_DEFAULT
    weights: dict[str, float] = field(default_factory=lambda: dict(S.EDGE_WEIGHT))
    weight_default: float = S.EDGE_DEFAULT
    roles: dict[str, str] = field(default_factory=dict)
    centrality_in_find: bool = False
    expansion: bool = True
    expansion_hop_decay: float = 0.6
    expansion_max: int = 5
    expansion_min_ratio: float = 0.5


def _flag(v: object) -> bool:
    return v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "on")


def knobs(section: Mapping | None = None, env: Mapping[str, str] | None = None) -> Knobs:
    """Knobs by section and variables. A role that names no tier, or a value that is no number, is an error.

    A variable names a tier or a kind of edge behind its prefix; kinds with a hyphen can only be set in the section.
    """
    k, section = Knobs(), dict(section or {})
    k.tiers |= {str(n).upper(): float(v) for n, v in section.get("authority_tiers", {}).items()}
    k.weights |= {str(n).lower(): float(v) for n, v in section.get("edge_weights", {}).items()}
    k.roles = {str(g).lower(): str(t).upper() for g, t in section.get("roles", {}).items()}
    plain = {"authority_default": ("tier_default", float), "edge_weight_default": ("weight_default", float), "centrality_in_find": ("centrality_in_find", _flag), "expansion": ("expansion", _flag), "expansion_hop_decay": ("expansion_hop_decay", float), "expansion_max": ("expansion_max", int), "expansion_min_ratio": ("expansion_min_ratio", float)}
    values = {n: v for n, v in section.items() if n in plain}
    for name, v in (env or {}).items():
        rest = name.removeprefix(KNOB_PREFIX).lower()
        if not name.startswith(KNOB_PREFIX):
            continue
        if rest in plain:
            values[rest] = v
        elif rest.startswith("authority_"):
            k.tiers[rest.removeprefix("authority_").upper()] = float(v)
        elif rest.startswith("edge_weight_"):
            k.weights[rest.removeprefix("edge_weight_")] = float(v)
    for n, v in values.items():
        setattr(k, plain[n][0], plain[n][1](v))
    if unknown := sorted(set(k.roles.values()) - set(k.tiers)):
        raise ValueError(f"roles name unknown tiers {unknown}")
    return k


def read_vocabulary(texts: list[str]) -> tuple[dict[str, dict], list[str]]:
    """(kinds, warnings) of YAML vocabularies, a base first and overlays after it; the last text that has a kind gives its entry.

    A text that cannot be read, or has another shape, is left out with a warning; nothing is raised.
    """
    import yaml

    kinds: dict[str, dict] = {}
    warnings: list[str] = []
    for i, text in enumerate(texts):
        try:
            doc = yaml.safe_load(text) or {}
            for part in ("nodes", "edges"):
                for row in doc.get(part) or []:
                    kinds[f"{part}:{row['kind']}"] = dict(row)
        except (yaml.YAMLError, AttributeError, KeyError, TypeError) as e:
            warnings.append(f"vocabulary {i}: {type(e).__name__}")
    return kinds, warnings
