"""Settings of the panel pipeline as plain dataclasses; operators take what they need as arguments."""

from __future__ import annotations

import json
import math
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Cleaning:
    blip: float = math.log(1.5)
    scale: float = math.log(4.0)
    window: int = 31
    min_obs: int = 5
    smooth: int = 3
    ffill: int = 7


@dataclass(frozen=True)
class Target:
    change_days: int = 14
    threshold: float = 0.15
    by_category: dict = field(default_factory=dict)
    by_commodity: dict = field(default_factory=dict)
    horizon: int = 14
    cooldown: int = 14


@dataclass(frozen=True)
class Features:
    returns: tuple = (1, 3, 7, 14, 28)
    volatility: tuple = (7, 14, 30)
    zscores: tuple = (30, 90)
    neighbours: int = 3
    leaders: int = 3
    calendar_cap: int = 120
    min_date: str = "2018-04-01"
    weekdays_only: bool = True
    centre_provinces: tuple = ()


@dataclass(frozen=True)
class Network:
    lags: int = 2
    alpha: float = 0.05
    min_obs: int = 60
    window: int = 14


@dataclass(frozen=True)
class Validation:
    first_test: str = "2022-01-01"
    block_months: int = 3
    val_days: int = 120
    purge_days: int = 14


@dataclass(frozen=True)
class Settings:
    """All sections, and the folders that a project's ``paths`` name, relative ones below the file's folder."""

    cleaning: Cleaning = Cleaning()
    target: Target = Target()
    features: Features = Features()
    network: Network = Network()
    validation: Validation = Validation()
    paths: dict[str, Path] = field(default_factory=dict)


def find(start: str | Path, name: str) -> Path:
    """The file ``name`` in ``start`` or the nearest folder above it."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / name).exists():
            return folder / name
    raise FileNotFoundError(f"no {name} in {here} or above")


def load(path: str | Path) -> Settings:
    """Settings from a TOML or JSON file (YAML where its reader is installed); what a file leaves out keeps its default.

    Sections and names that aren't known are errors, since a misspelt setting would be passed over otherwise.  Lists become tuples.
    """
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml

        raw = yaml.safe_load(path.read_text("utf-8"))
    else:
        raw = tomllib.loads(path.read_text("utf-8")) if path.suffix == ".toml" else json.loads(path.read_text("utf-8"))
    sections = {f.name: type(f.default) for f in fields(Settings) if f.name != "paths"}
    if unknown := set(raw or {}) - {*sections, "paths"}:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    made = {}
    for name, values in (raw or {}).items():
        if name == "paths":
            made[name] = {k: path.resolve().parent / v for k, v in values.items()}
            continue
        kind = sections[name]
        if unknown := set(values or {}) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown settings in {name}: {', '.join(sorted(unknown))}")
        made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (values or {}).items()})
    return Settings(**made)
