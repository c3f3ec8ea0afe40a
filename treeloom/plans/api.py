"""Entry points over DataFrames of sources (doc_id, text, and language or path)."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions.registry import get_parser, resolve_alias
from treeloom.operators.chunk import chunks
from treeloom.operators.extract import compile_extraction
from treeloom.operators.intel import FEATURES, metrics
from treeloom.operators.nodes import trees
from treeloom.operators.squery import of_language

from .config import ExtractionConfig, ProcessConfig, camel, convert_keys


def process(sources: DataFrame, config: ProcessConfig | dict) -> DataFrame:
    """doc_id, language, metrics and the configured features of each source in the configuration's language.

    Features that the configuration leaves out are empty arrays. One parse
    serves all of them, extractions and chunks included.
    """
    config = ProcessConfig.of(config)
    get_parser(config.language)
    mine = of_language(sources, resolve_alias(config.language))
    compiled = compile_extraction(ExtractionConfig(config.language, config.extractions)) if config.extractions else None
    base = trees(mine, chunk_max_size=config.chunk_max_size, extractions=compiled)
    # An unconfigured feature has the type of the configured one, and no row is visited for it.
    cols = [(f() if getattr(config, name) else F.filter(f(), lambda x: F.lit(False))).alias(name) for name, f in FEATURES.items()]
    extra = [chunks(base).alias("chunks")] if config.chunk_max_size is not None else []
    if compiled is not None:
        extra.append(F.col("extractions"))
    return base.select("doc_id", "language", metrics().alias("metrics"), *cols, *extra)


def extract_intelligence(sources: DataFrame, language: str) -> DataFrame:
    """Everything but chunks and extractions."""
    return process(sources, ProcessConfig(language).all())


def to_json(results: DataFrame, camel_case: bool = False) -> DataFrame:
    """(doc_id, json) of process results; nulls and empty arrays are left out, keys may be camel-cased.

    Case and empties are settled in the schema and by expressions, not row by row.
    """
    cols = []
    for f in results.schema.fields:
        if f.name == "doc_id":
            continue
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.when(F.size(c) > 0, c)
        if camel_case:
            c = c.cast(_camel_type(f.dataType))
        cols.append(c.alias(camel(f.name) if camel_case else f.name))
    return results.select("doc_id", F.to_json(F.struct(*cols)).alias("json"))


def _camel_type(t):
    from pyspark.sql import types as T

    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(camel(f.name), _camel_type(f.dataType), True) for f in t.fields])
    return T.ArrayType(_camel_type(t.elementType)) if isinstance(t, T.ArrayType) else t


def config_json(config: ProcessConfig, camel_case: bool = False) -> str:
    d = asdict(config)
    return json.dumps(convert_keys(d, camel) if camel_case else d)
