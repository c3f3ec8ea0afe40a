"""What is left of parser downloads where parsers come with the package: the same calls, answered by the registry."""

from __future__ import annotations

import platform
import shutil
from pathlib import Path

from treeloom.plans.config import PackConfig
from treeloom.plans.errors import DownloadError, LanguageNotFound

from . import registry as R

_state: dict[str, Path | None] = {"dir": None}


def configure(config: PackConfig) -> None:
    _state["dir"] = Path(config.cache_dir) if config.cache_dir else None


def cache_dir() -> Path:
    return _state["dir"] or Path.home() / ".cache" / "treeloom"


def manifest_languages() -> list[str]:
    """Sorted languages that have a parser here."""
    from treeloom.operators.parsers import PARSERS

    return sorted({*PARSERS, *R._ADDED})


def downloaded_languages() -> list[str]:
    return manifest_languages()


def download(names: list[str]) -> int:
    """Number of parsers that became available: none, since all are; names without one raise."""
    for n in names:
        if R.resolve_alias(n) not in manifest_languages():
            raise DownloadError(f"no parser for {n}")
    return 0


def ensure_group(group: str) -> list[str]:
    """Languages of a group that have a parser."""
    if group not in R.GROUPS:
        raise DownloadError(f"no group {group}")
    return [x for x in R.GROUPS[group].split() if x in manifest_languages()]


def download_all() -> int:
    return download(manifest_languages())


def init(config: PackConfig) -> None:
    """Configure, and make sure that what the configuration names is there."""
    configure(config)
    try:
        for n in config.languages:
            R.get_parser(n)
    except LanguageNotFound as e:
        raise DownloadError(str(e)) from e
    for g in config.groups:
        ensure_group(g)


def clean_cache() -> None:
    """Delete the cache folder, if it is one of ours."""
    d = cache_dir()
    if d.name == "treeloom" and d.is_dir():
        shutil.rmtree(d)


def platform_key() -> str:
    return f"{platform.system().lower()}-{platform.machine().lower()}"
