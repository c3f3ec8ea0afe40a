"""Configurations: dataclasses of the driver, read from mappings and TOML files."""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .errors import ConfigError, IoError, TomlError

CAPTURE_OUTPUTS = ("Text", "Node", "Full")
CONFIG_NAME = "treeloom.toml"


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def convert_keys(x, f):
    """Keys of nested mappings converted by ``f``; lists are followed."""
    if isinstance(x, dict):
        return {f(k): convert_keys(v, f) for k, v in x.items()}
    return [convert_keys(v, f) for v in x] if isinstance(x, list) else x


@dataclass(frozen=True)
class ExtractionPattern:
    query: str
    capture_output: str = "Full"
    child_fields: tuple[str, ...] = ()
    max_results: int | None = None
    byte_range: tuple[int, int] | None = None

    def __post_init__(self):
        if self.capture_output not in CAPTURE_OUTPUTS:
            raise ConfigError(f"capture_output must be one of {', '.join(CAPTURE_OUTPUTS)}")
        object.__setattr__(self, "child_fields", tuple(self.child_fields))
        if self.byte_range is not None:
            object.__setattr__(self, "byte_range", tuple(self.byte_range))


def _from(cls, d: dict):
    d = {snake(k): v for k, v in d.items()}
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in d.items() if k in known})


@dataclass(frozen=True)
class ExtractionConfig:
    language: str
    patterns: dict[str, ExtractionPattern] = field(default_factory=dict)

    @classmethod
    def of(cls, d: dict | ExtractionConfig) -> ExtractionConfig:
        if isinstance(d, cls):
            return d
        return cls(d["language"], {k: p if isinstance(p, ExtractionPattern) else _from(ExtractionPattern, p) for k, p in (d.get("patterns") or {}).items()})


@dataclass(frozen=True)
class ProcessConfig:
    language: str
    structure: bool = True
    imports: bool = True
    exports: bool = True
    comments: bool = False
    docstrings: bool = False
    symbols: bool = False
    diagnostics: bool = False
    chunk_max_size: int | None = None
    extractions: dict[str, ExtractionPattern] | None = None

    @classmethod
    def of(cls, d: dict | ProcessConfig) -> ProcessConfig:
        if isinstance(d, cls):
            return d
        c = _from(cls, d)
        if c.extractions:
            c = replace(c, extractions=ExtractionConfig.of({"language": c.language, "patterns": c.extractions}).patterns)
        return c

    def with_chunking(self, size: int) -> ProcessConfig:
        return replace(self, chunk_max_size=size)

    def all(self) -> ProcessConfig:
        """Every feature but chunking, which needs a size."""
        return replace(self, structure=True, imports=True, exports=True, comments=True, docstrings=True, symbols=True, diagnostics=True)

    def minimal(self) -> ProcessConfig:
        return replace(self, structure=False, imports=False, exports=False, comments=False, docstrings=False, symbols=False, diagnostics=False)

    def folded(self, all: bool = False, **flags: bool) -> ProcessConfig:
        """As a command line folds flags: all of them, or any given one replaces the defaults."""
        if all:
            return self.all()
        return replace(self.minimal(), **{k: True for k, v in flags.items() if v}) if any(flags.values()) else self


@dataclass(frozen=True)
class PackConfig:
    """What the TOML file says: where caches go, and the languages and groups to have ready."""

    cache_dir: str | None = None
    languages: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str | Path) -> PackConfig:
        try:
            d = tomllib.loads(Path(path).read_text())
        except OSError as e:
            raise IoError(f"{path}: {e}") from e
        except tomllib.TOMLDecodeError as e:
            raise TomlError(f"{path}: {e}") from e
        return cls(d.get("cache_dir"), tuple(d.get("languages") or ()), tuple(d.get("groups") or ()))

    @classmethod
    def discover(cls, start: str | Path = ".") -> PackConfig | None:
        """The file of the nearest folder upward that has one."""
        here = Path(start).resolve()
        for d in (here, *here.parents):
            if (d / CONFIG_NAME).is_file():
                return cls.load(d / CONFIG_NAME)
        return None

    def save(self, folder: str | Path = ".") -> Path:
        """Write the file into a folder."""
        rows = [f"{k} = {_toml_string(v)}" if isinstance(v, str) else f"{k} = [{', '.join(map(_toml_string, v))}]" for k, v in asdict(self).items() if v]
        path = Path(folder) / CONFIG_NAME
        path.write_text("\n".join(rows) + "\n")
        return path


def _toml_string(s: str) -> str:
    """A basic string: quotes, backslashes and control characters are escaped."""
    out = "".join("\\" + ch if ch in '"\\' else f"\\u{ord(ch):04x}" if ord(ch) < 32 or ord(ch) == 127 else ch for ch in s)
    return f'"{out}"'
