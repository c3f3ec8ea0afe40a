"""Declarative extraction: named patterns with projections, limits and ranges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.registry import get_parser, resolve_alias
from treeloom.plans import schemas as S
from treeloom.plans.config import ExtractionConfig, ExtractionPattern
from treeloom.plans.errors import QueryError

from .nodes import from_trees, parsed
from .squery import MATCHED, NODE, SHOWN, Compiled, Matcher, compile_query, node_struct, of_language

_CAPTURE = pa.struct([("name", pa.string()), ("node", NODE), ("text", pa.string()), ("child_fields", pa.map_(pa.string(), pa.string())), ("start_byte", pa.int64())])
MATCH = pa.list_(pa.struct([("pattern_index", pa.int64()), ("captures", pa.list_(_CAPTURE))]))
MATCHES = f"array<struct<pattern_index:bigint,captures:array<{S.CAPTURE_RESULT}>>>"
RESULT = f"doc_id bigint, pattern_name string, total_count bigint, matches {MATCHES}"


def compile_extraction(config: ExtractionConfig | dict) -> dict[str, tuple[ExtractionPattern, Compiled]]:
    """All patterns compiled; the first bad one raises with its name."""
    config = ExtractionConfig.of(config)
    get_parser(config.language)
    out = {}
    for name, p in config.patterns.items():
        try:
            out[name] = (p, compile_query(config.language, p.query))
        except QueryError as e:
            raise QueryError(f"pattern '{name}': {e}") from e
    return out


def extract_one(compiled: dict[str, tuple[ExtractionPattern, Compiled]], c: dict[str, list], raw: bytes):
    """(pattern name, total, matches) of each pattern in one document."""
    m = Matcher(c, raw)

    def text(i: int) -> str:
        return raw[c["start_byte"][i] : c["end_byte"][i]].decode("utf-8", "replace")

    for name, (p, q) in compiled.items():
        found = m.matches(q)
        if p.byte_range is not None:
            lo, hi = p.byte_range
            found = [x for x in found if c["end_byte"][x[0]] > lo and c["start_byte"][x[0]] < hi]
        kept = found if p.max_results is None else found[: p.max_results]
        matches = []
        for _, n, caps in kept:
            captures = []
            for x, i in caps:
                fields = {f: next((text(k) for k in m.kids[i] if c["field_name"][k] == f), None) for f in p.child_fields}
                captures.append({
                    "name": x, "node": node_struct(c, i) if p.capture_output != "Text" else None, "text": text(i) if p.capture_output != "Node" else None,
                    "child_fields": list(fields.items()), "start_byte": c["start_byte"][i],
                })
            matches.append({"pattern_index": n, "captures": captures})
        matches.sort(key=lambda x: x["captures"][0]["start_byte"] if x["captures"] else 0)
        yield name, len(found), matches


def extract_patterns(sources: DataFrame, config: ExtractionConfig | dict) -> DataFrame:
    """(doc_id, pattern_name, total_count, matches): one row for each source of the language and pattern.

    ``max_results`` keeps the first in document order; total_count has all.
    Matches are sorted by the begin of their first capture.
    """
    config = ExtractionConfig.of(config)
    compiled = compile_extraction(config)

    return parsed(of_language(sources, resolve_alias(config.language)), RESULT, _rows(compiled), _ARROW)


def extract_from_trees(trees: DataFrame, config: ExtractionConfig | dict) -> DataFrame:
    """The same from trees (doc_id, language, raw, nodes) that have been parsed before; nothing is parsed again."""
    config = ExtractionConfig.of(config)
    whole = any(p.capture_output != "Text" for p in config.patterns.values())
    return from_trees(trees.where(F.col("language") == resolve_alias(config.language)), RESULT, _rows(compile_extraction(config)), _ARROW, SHOWN if whole else MATCHED)


_ARROW = [("doc_id", pa.int64()), ("pattern_name", pa.string()), ("total_count", pa.int64()), ("matches", MATCH)]


def _rows(compiled: dict[str, tuple[ExtractionPattern, Compiled]]):
    def rows(d, _, raw, c):
        for name, total, matches in extract_one(compiled, c, raw):
            yield d, name, total, matches

    return rows


def as_map(results: DataFrame) -> DataFrame:
    """(doc_id, results): a map from pattern names to (matches, total_count), one row a document."""
    entry = F.struct("pattern_name", F.struct("matches", "total_count"))
    return results.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("results"))


def validate_extraction(config: ExtractionConfig | dict, strict: bool = False) -> dict:
    """valid, and for each pattern valid, capture_names, pattern_count, warnings and errors.

    Wrong queries don't raise unless ``strict``; an unknown language does.
    """
    config = ExtractionConfig.of(config)
    get_parser(config.language)
    out = {}
    for name, p in config.patterns.items():
        warnings = [f"empty child field name in pattern '{name}'" for f in p.child_fields if not f]
        try:
            q = compile_query(config.language, p.query)
            out[name] = {"valid": True, "capture_names": q.capture_names, "pattern_count": len(q.patterns), "warnings": warnings, "errors": []}
        except QueryError as e:
            if strict:
                raise
            out[name] = {"valid": False, "capture_names": [], "pattern_count": 0, "warnings": warnings, "errors": [str(e)]}
    return {"valid": all(x["valid"] for x in out.values()), "patterns": out}


def validation_rows(spark: SparkSession, config: ExtractionConfig | dict) -> DataFrame:
    """``validate_extraction`` as a DataFrame."""
    rows = [(k, v["valid"], v["capture_names"], v["pattern_count"], v["warnings"], v["errors"]) for k, v in validate_extraction(config)["patterns"].items()]
    return spark.createDataFrame(rows, "pattern_name string, valid boolean, capture_names array<string>, pattern_count bigint, warnings array<string>, errors array<string>")
