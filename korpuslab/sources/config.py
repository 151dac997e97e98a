"""The run configuration: a YAML file with a closed set of fields."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from korpuslab.errors import ConfigError

try:
    import yaml
except ModuleNotFoundError:  # YAML files then cannot be read; mappings still can
    yaml = None


#: The names of the configuration's fields, and which of them are texts or paths.
@dataclass(frozen=True)
class RunConfig:
    seed: int
    ledger_path: Path
    artifact_dir: Path
    engine: str
    model_repository: str
    model_revision: str
    normalizer_version: str
    source_root: Path | None = None
    decoding: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {f.name: v.as_posix() if isinstance(v := getattr(self, f.name), Path) else v for f in fields(self)}


OPTIONAL = {"source_root", "decoding"}
ALLOWED = {f.name for f in fields(RunConfig)}
TEXTS = ("engine", "model_repository", "model_revision", "normalizer_version")
PATHS = ("ledger_path", "artifact_dir", "source_root")


def check(raw: Any, base: Path) -> RunConfig:
    """A mapping as a configuration; relative paths start from ``base``."""
    if not isinstance(raw, dict):
        raise ConfigError("a configuration is a mapping")
    for what, names in (("unknown", set(raw) - ALLOWED), ("missing", ALLOWED - OPTIONAL - set(raw))):
        if names:
            raise ConfigError(f"{what} fields: {', '.join(sorted(map(str, names)))}")
    if type(raw["seed"]) is not int:
        raise ConfigError("seed is not an integer")
    if not isinstance(raw.get("decoding") or {}, dict):
        raise ConfigError("decoding is not a mapping")
    values = dict(raw) | {"decoding": dict(raw.get("decoding") or {})}
    for name in TEXTS + PATHS:
        value = values.get(name)
        if value is None and name in OPTIONAL:
            continue
        if not isinstance(value, str) or not value.strip():
            raise ConfigError(f"{name} is not a text")
        if name in PATHS:
            values[name] = (base / Path(value).expanduser()).resolve()
    return RunConfig(**values)


def load_config(path: str | Path) -> RunConfig:
    path = Path(path).expanduser().resolve()
    if yaml is None:
        raise ConfigError("reading YAML needs the yaml package")
    if not path.is_file():
        raise ConfigError(f"there is no file {path}")
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as error:
        raise ConfigError(f"{path} is not YAML: {error}") from error
    return check(raw, path.parent)
