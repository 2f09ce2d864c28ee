"""The transform configuration: YAML in, frozen dataclasses out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

import yaml

from .. import __version__
from ..functions.fakes import FAKES
from ..functions.passwords import METHODS

PASS_TWO = ("Template", *METHODS)
KNOWN = (*FAKES, "Bool", "Regex", *PASS_TWO)


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Version:
    major: int
    minor: int = 0
    patch: int = 0

    @staticmethod
    def parse(text: str) -> Version:
        """``major.minor.patch``, with a leading v or trailing parts left out; what is no number counts as 0."""
        parts = text.strip().removeprefix("v").split("-")[0].split("+")[0].split(".")
        numbers = [int(p) if p.isdigit() else 0 for p in parts[:3]]
        return Version(*(numbers + [0, 0, 0])[:3])

    @property
    def info(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


@dataclass(frozen=True)
class ColumnTransform:
    type: str
    options: Mapping[str, Any] = field(default_factory=lambda: MappingProxyType({}))

    @property
    def second_pass(self) -> bool:
        return self.type in PASS_TWO

    def text(self, name: str, required: bool = True) -> str | None:
        value = self.options.get(name)
        if value is None and not required:
            return None
        if not isinstance(value, str):
            raise ConfigError(f"{self.type} needs {name!r} as text")
        return value

    def number(self, name: str, default: int) -> int:
        value = self.options.get(name, default)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ConfigError(f"{self.type}: {name!r} is no number")
        return int(value)

    def flag(self, name: str, default: bool) -> bool:
        value = self.options.get(name, default)
        if not isinstance(value, bool):
            raise ConfigError(f"{self.type}: {name!r} is neither true nor false")
        return value


@dataclass(frozen=True)
class TransformConfig:
    major_version: int
    tables: Mapping[str, Mapping[str, ColumnTransform]]

    def columns(self, table: str) -> Mapping[str, ColumnTransform]:
        return self.tables.get(table) or {}


def _column(table: str, name: str, spec: Any) -> ColumnTransform:
    if isinstance(spec, str):
        made = ColumnTransform(spec)
    elif isinstance(spec, dict):
        if not isinstance(spec.get("type"), str):
            raise ConfigError(f"{table}.{name}: an object needs a 'type' as text")
        options = spec.get("config") or {k: v for k, v in spec.items() if k != "type"}
        if not isinstance(options, dict):
            raise ConfigError(f"{table}.{name}: config is no object")
        made = ColumnTransform(spec["type"], MappingProxyType(dict(options)))
    else:
        raise ConfigError(f"{table}.{name}: neither text nor object")
    if made.type not in KNOWN:
        raise ConfigError(f"{table}.{name}: unknown transform type {made.type}")
    return made


def parse_config(text: str, version: str = __version__) -> TransformConfig:
    """The configuration in a YAML text; an absent major_version is 0, and must be that of ``version``."""
    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"no YAML: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError("the configuration is no object")
    major = data.get("major_version", 0)
    if not isinstance(major, int) or major != Version.parse(version).major:
        raise ConfigError(f"major_version {major!r} is not that of {version}")
    tables = data.get("tables") or {}
    if not isinstance(tables, dict):
        raise ConfigError("tables is no object")
    return TransformConfig(major, {t: {c: _column(t, c, s) for c, s in (columns or {}).items()} for t, columns in tables.items()})


def load_config(path: str) -> TransformConfig:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())
