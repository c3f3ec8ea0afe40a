"""Parsers by language: functions from bytes to the root of a concrete syntax tree."""

from __future__ import annotations

from collections.abc import Callable

from . import clike, css_, html_, json_, python_, ruby_, toml_
from .base import Node

PARSERS: dict[str, Callable[[bytes], Node]] = {
    "json": json_.parse,
    "html": html_.parse,
    "python": python_.parse,
    "ruby": ruby_.parse,
    "css": css_.parse,
    "toml": toml_.parse,
    **{x: clike.parser_of(x) for x in ("javascript", "typescript", "tsx", "rust", "go", "java", "kotlin", "c")},
}
