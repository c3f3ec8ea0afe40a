"""Language detection as expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import registry as R


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_extension(ext: Column | str) -> Column:
    """The extension in lower case; null unless it is ASCII of at most 32 bytes."""
    ext = _c(ext)
    return F.when(ext.rlike(r"\A\p{ASCII}{0,32}\z"), F.lower(ext))


def detect_language_from_extension(ext: Column | str) -> Column:
    """Language of an extension without its dot, or null."""
    return F.element_at(R.literal_map(R.EXTENSIONS), normal_extension(ext))


def path_extension(path: Column | str) -> Column:
    """Last suffix of the last path segment; null without one, and for names that only begin with a dot."""
    seg = F.element_at(F.split(F.regexp_replace(_c(path), r"/+(\./*)*\z", ""), "/"), -1)
    return F.when(seg.rlike(r"(?s)\A.+\.[^.]*\z") & (seg != ".."), F.regexp_extract(seg, r"(?s)\A.+\.([^.]*)\z", 1))


def detect_language_from_path(path: Column | str) -> Column:
    return detect_language_from_extension(path_extension(path))


def strip_version(name: Column) -> Column:
    """The name before its first digit, and before a dot just in front of that."""
    return F.regexp_replace(name, r"(?s)\.?[0-9].*$", "")


def interpreter(content: Column | str) -> Column:
    """Program that the first line's ``#!`` names; null without one."""
    text = _c(content)
    line = F.regexp_extract(text, r"\A#!([^\n]*)", 1)
    words = F.filter(F.split(line, r"[ \t\x0c\r]+"), lambda w: w != "")
    first = F.element_at(words, 1)
    rest = F.filter(F.slice(words, 2, 1 << 20), lambda w: ~w.startswith("-"))
    program = F.when((first == "env") | first.endswith("/env"), F.when(F.size(rest) > 0, F.element_at(rest, 1))).otherwise(F.element_at(F.split(first, "/"), -1))
    return F.when(text.startswith("#!") & (F.size(words) > 0), strip_version(program))


def detect_language_from_content(content: Column | str) -> Column:
    return F.element_at(R.literal_map(R.INTERPRETERS), interpreter(content))


def detect_language(path: Column | str, content: Column | str) -> Column:
    """By path, or else by content."""
    return F.coalesce(detect_language_from_path(path), detect_language_from_content(content))


def extension_ambiguity(ext: Column | str) -> Column:
    """struct(assigned, alternatives) of an extension that several languages use, or null."""
    rows = [x for k, (a, o) in sorted(R.AMBIGUITIES.items()) for x in (F.lit(k), F.struct(F.lit(a).alias("assigned"), F.array(*map(F.lit, o)).alias("alternatives")))]
    return F.element_at(F.create_map(*rows), normal_extension(ext))


def register_functions(spark: SparkSession) -> None:
    """SQL functions of this module, and ``parse_nodes(text, language)`` as a table function.

    The scalar ones are SQL expressions over the same tables, so the optimizer
    sees through them.
    """
    from treeloom.operators.nodes import register_table_function

    def case(d: dict[str, str], x: str) -> str:
        return f"element_at(map({', '.join(f'{k!r}, {v!r}' for k, v in d.items())}), {x})"

    ext = r"CASE WHEN ext RLIKE r'\A\p{ASCII}{0,32}\z' THEN lower(ext) END"
    seg = r"element_at(split(regexp_replace(path, r'/+(\./*)*\z', ''), '/'), -1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_language_from_extension(ext STRING) RETURNS STRING RETURN {case(R.EXTENSIONS, ext)}")
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION detect_language_from_path(path STRING) RETURNS STRING RETURN CASE WHEN {seg} RLIKE r'(?s)\A.+\.[^.]*\z' THEN detect_language_from_extension(regexp_extract({seg}, r'(?s)\A.+\.([^.]*)\z', 1)) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION resolve_alias(name STRING) RETURNS STRING RETURN coalesce({case(R.ALIASES, 'name')}, name)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_language(name STRING) RETURNS BOOLEAN RETURN coalesce({case({k: 'y' for k in R.LANGUAGES}, 'resolve_alias(name)')} = 'y', false)")
    words = r"filter(split(regexp_extract(content, r'\A#!([^\n]*)', 1), r'[ \t\x0c\r]+'), w -> w <> '')"
    rest = f"filter(slice({words}, 2, 1048576), w -> NOT startswith(w, '-'))"
    program = f"CASE WHEN element_at({words}, 1) = 'env' OR endswith(element_at({words}, 1), '/env') THEN try_element_at({rest}, 1) ELSE element_at(split(element_at({words}, 1), '/'), -1) END"
    pairs = ", ".join(f"'{k}', named_struct('assigned', '{a}', 'alternatives', array({', '.join(repr(x) for x in o)}))" for k, (a, o) in sorted(R.AMBIGUITIES.items()))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extension_ambiguity(ext STRING) RETURNS STRUCT<assigned: STRING, alternatives: ARRAY<STRING>> RETURN element_at(map({pairs}), {ext})")
    stripped = f"regexp_replace({program}, r'(?s)\\.?[0-9].*$', '')"
    body = f"CASE WHEN startswith(content, '#!') AND size({words}) > 0 THEN {case(R.INTERPRETERS, stripped)} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_language_from_content(content STRING) RETURNS STRING RETURN {body}")
    register_table_function(spark)
