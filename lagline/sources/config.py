"""Settings: YAML over defaults, everything resolved and checked at load."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import yaml

from ..operators.delay import Delay
from ..operators.splits import check_ratios

#: Microseconds of a duration's unit.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
#: Options that a dataset may set.
OPTIONS = ("start_date", "val_fraction", "entity_key", "delay", "campaign_gap")

#: Defaults and datasets' own settings.
DEFAULTS = """
paths: {raw: data/raw, processed: data/processed}
split: {ratios: [0.8, 0.1, 0.1]}
campaign: {gap: 1d}
delay: {median_days: 7.0, sigma: 1.0, seed: 0, max_delay_days: null}
datasets:
  paysim: {start_date: "2023-01-01", delay: {median_days: 1.0}}
  banksim: {start_date: "2023-01-01"}
  sparkov: {val_fraction: 0.1}
  sparkov_slow: {val_fraction: 0.1, delay: {median_days: 15.0, sigma: 1.665, max_delay_days: 365}}
  ibm_ccf: {entity_key: user}
  ieee_cis: {start_date: "2017-12-01"}
  saml_d: {delay: {median_days: 30.0}}
  amaretto: {campaign_gap: 1h}
"""


class ConfigError(ValueError):
    pass


def duration_us(value) -> int:
    """'1d', '12h', '30min' in microseconds; a number without a unit is refused."""
    got = re.fullmatch(r"\s*(\d+\.?\d*|\.\d+)\s*([A-Za-z]+)\s*", value) if isinstance(value, str) else None
    unit = got[2].lower() if got else ""
    unit = {"day": "d", "days": "d", "hour": "h", "hours": "h", "m": "min", "minute": "min", "minutes": "min", "sec": "s"}.get(unit, unit)
    if unit not in UNITS:
        raise ConfigError(f"{value!r} isn't a duration with a unit, like 1d, 12h or 30min")
    return round(float(got[1]) * UNITS[unit])


def merged(base: dict, over: dict) -> dict:
    """over laid on base, mapping by mapping."""
    both = {k for k in over if isinstance(over[k], dict) and isinstance(base.get(k), dict)}
    return {**base, **{k: merged(base[k], v) if k in both else v for k, v in over.items()}}


@dataclass(frozen=True)
class Config:
    raw: Path
    processed: Path
    ratios: tuple[float, float, float]
    delay: Delay
    gap_us: int
    datasets: dict = field(default_factory=dict)

    def options(self, name: str) -> dict:
        return self.datasets.get(name, {})

    def gap_for(self, name: str) -> int:
        own = self.options(name).get("campaign_gap")
        return self.gap_us if own is None else duration_us(own)

    def delay_for(self, name: str) -> Delay:
        return _delay(self.delay, self.options(name).get("delay") or {}, f"datasets.{name}.delay")


def _delay(base: Delay, over, where: str) -> Delay:
    if not isinstance(over, dict):
        raise ConfigError(f"{where} isn't a mapping")
    unknown = sorted(set(over) - {f.name for f in fields(Delay)})
    if unknown:
        raise ConfigError(f"{where} has unknown setting(s) {unknown}")
    try:
        return replace(base, **{k: int(v) if k == "seed" else None if v is None else float(v) for k, v in over.items()})
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{where}: {e}") from e


def _yaml(path: Path | str) -> dict:
    try:
        return yaml.safe_load(Path(path).read_text()) or {}
    except FileNotFoundError as e:
        raise ConfigError(f"no settings at {path}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} isn't YAML: {e}") from e


def load(path: Path | str | None = None) -> Config:
    data = yaml.safe_load(DEFAULTS)
    if path is not None:
        data = merged(data, _yaml(path))
    paths, sets = data.get("paths"), data.get("datasets") or {}
    if not isinstance(paths, dict) or not paths.get("raw") or not paths.get("processed"):
        raise ConfigError("paths.raw and paths.processed are needed")
    if not isinstance(sets, dict):
        raise ConfigError("datasets isn't a mapping")
    for name, options in sets.items():
        if not isinstance(options, dict):
            raise ConfigError(f"datasets.{name} isn't a mapping")
        unknown = sorted(set(options) - set(OPTIONS))
        if unknown:
            raise ConfigError(f"datasets.{name} has unknown option(s) {unknown}; known are {', '.join(OPTIONS)}")
    ratios = (data.get("split") or {}).get("ratios")
    try:
        ratios = check_ratios([float(r) for r in ratios])
    except (TypeError, ValueError) as e:
        raise ConfigError(f"split.ratios: {e}") from e
    out = Config(Path(paths["raw"]), Path(paths["processed"]), ratios, _delay(Delay(), data.get("delay") or {}, "delay"), duration_us((data.get("campaign") or {}).get("gap", "1d")), sets)
    for name in sets:  # a bad override fails now, not halfway through a run over all
        out.delay_for(name)
        out.gap_for(name)
    return out
