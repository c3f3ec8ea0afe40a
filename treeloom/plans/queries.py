"""Queries over the driver's tables, each beside SQL that says the same.

Code operators run on sources made by one concatenation that both sides share
(the tables hold prose, HTML and JSON, but no code), so what they must find is
known by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import detect as D
from treeloom.functions import registry as R
from treeloom.functions.lines import with_line_metrics
from treeloom.operators import chunk, extract, intel, squery, tree
from treeloom.operators.nodes import nodes, trees

from . import api
from .config import ProcessConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return _spread(s, s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("html").alias("language")))


#: Rows and bytes of text that a task parses at most, ids being hashed evenly.
ROWS, BYTES = 50_000, 4 << 20


def _spread(s: SparkSession, df: DataFrame) -> DataFrame:
    """Rows hashed by id over all cores, and in more pieces the more rows or bytes there are: parsing costs far more than moving the text.

    Partitions of the scan won't do, however many, for a row group goes to one of them entire.
    """
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    return df.repartition(max(s.sparkContext.defaultParallelism, -(-rows // ROWS), -(-(size or 0) // BYTES)), "doc_id")


def _events(s: SparkSession, d: str) -> DataFrame:
    return _spread(s, s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"), F.lit("json").alias("language")))


def _ids(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("n"))


def _code(s: SparkSession, d: str, language: str, source: Column) -> DataFrame:
    return _ids(s, d).select("doc_id", F.lit(language).alias("language"), source.alias("text"))


def _id() -> Column:
    return F.col("doc_id").cast("string")


# -- lines

_LINES = """
SELECT doc_id, lang, len(l)::BIGINT AS total_lines, len(l)::BIGINT - len(list_filter(l, lambda x: trim(x) = ''))::BIGINT - len(list_filter(l, lambda x: regexp_matches(trim(x), '^(//|#|/\\*|\\*)')))::BIGINT AS code_lines,
 len(list_filter(l, lambda x: regexp_matches(trim(x), '^(//|#|/\\*|\\*)')))::BIGINT AS comment_lines, len(list_filter(l, lambda x: trim(x) = ''))::BIGINT AS blank_lines, strlen(text)::BIGINT AS total_bytes
FROM (SELECT doc_id, lang, text, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM documents)
"""


@query(_LINES)
def line_metrics(s, d):
    return with_line_metrics(_docs(s, d).select("doc_id", "lang", "text")).drop("text")


@query(f"SELECT lang, count(*)::BIGINT AS docs, sum(total_lines)::BIGINT AS total_lines, sum(total_bytes)::BIGINT AS total_bytes FROM ({_LINES}) GROUP BY lang")
def line_metrics_by_lang(s, d):
    m = with_line_metrics(_docs(s, d).select("lang", "text"))
    return m.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("total_lines").alias("total_lines"), F.sum("total_bytes").alias("total_bytes"))


# -- detection and registry


def _case(d: dict[str, str], x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"


_EXT = "lower(CASE WHEN regexp_matches({seg}, '^.+\\.[^.]*$') THEN regexp_extract({seg}, '^.+\\.([^.]*)$', 1) END)"
_SEG = "regexp_extract(regexp_replace(url, '/+(\\./*)*$', ''), '([^/]*)$', 1)"


#: What the documentation of languages says, typed here by hand and not printed from the tables.
_KNOWN = {"html": "html", "htm": "html", "py": "python", "rs": "rust", "ts": "typescript", "h": "c", "yml": "yaml", "m": "objc", "js": "javascript", "css": "css", "json": "json"}


@query(f"SELECT page_id, {_case(_KNOWN, _EXT.format(seg=_SEG))} AS language FROM pages")
def detect_path(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", D.detect_language_from_path("url").alias("language"))


_EXTS = ["py", "PY", "Rs", "ts", "xyz", "", "h", "abcdef", "yml", "M"]


@query(f"SELECT doc_id, ext, {_case(_KNOWN, 'lower(ext)')} AS language FROM (SELECT doc_id, {_EXTS!r}[(doc_id % {len(_EXTS)}) + 1] AS ext FROM documents)")
def detect_extension(s, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    return _docs(s, d).select("doc_id", ext.alias("ext")).withColumn("language", D.detect_language_from_extension("ext"))


@query(
    "SELECT doc_id, ext, a AS assigned, o AS alternatives FROM (SELECT doc_id, "
    f"{_EXTS!r}[(doc_id % {len(_EXTS)}) + 1] AS ext FROM documents) LEFT JOIN (VALUES "
    "('h', 'c', 'cpp,objc'), ('m', 'objc', 'matlab'), ('pl', 'perl', 'prolog'), ('v', 'v', 'verilog')"
    ") v(e, a, o) ON lower(ext) = e"
)
def extension_ambiguity(s, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    x = _docs(s, d).select("doc_id", ext.alias("ext")).withColumn("x", D.extension_ambiguity("ext"))
    return x.select("doc_id", "ext", "x.assigned", F.array_join("x.alternatives", ",").alias("alternatives"))


_BANGS = ["#!/bin/bash", "#!/usr/bin/env python3.11", "#!/usr/bin/env -S node --x", "#!/usr/bin/perl -w", "no", "#!/usr/bin/env FOO=1 ruby", "#! /usr/local/bin/Rscript", "#!/usr/bin/fantasy"]


@query(f"SELECT doc_id, {['bash', 'python', 'javascript', 'perl', None, None, 'r', None]!r}[(doc_id % 8) + 1] AS language FROM documents".replace("None", "NULL"))
def detect_shebang(s, d):
    bang = F.element_at(F.array(*map(F.lit, _BANGS)), (F.col("doc_id") % len(_BANGS) + 1).cast("int"))
    return _docs(s, d).select("doc_id", D.detect_language_from_content(F.concat(bang, F.lit("\n"), "text")).alias("language"))


_NAMES = ["shell", "makefile", "lisp", "gradle", "bazel", "ignorefile", "Shell", "python", "nope", ""]


@query("SELECT * FROM (VALUES ('shell', 'bash', true), ('makefile', 'make', true), ('lisp', 'commonlisp', true), ('gradle', 'groovy', true), ('bazel', 'starlark', true), ('ignorefile', 'gitignore', true), ('Shell', 'Shell', false), ('python', 'python', true), ('nope', 'nope', false), ('', '', false)) v(name, resolved, known)")
def alias_resolve(s, d):
    return s.createDataFrame([(x,) for x in _NAMES], "name string").select("name", R.resolve_alias(F.col("name")).alias("resolved"), R.has_language(F.col("name")).alias("known"))


@query(f"SELECT unnest({R.list_languages()!r}) AS language")
def language_catalog(s, d):
    return R.available_languages(s)


@query("SELECT unnest(['actionscript', 'brightscript', 'gdscript', 'javascript', 'linkerscript', 'postscript', 'purescript', 'rescript', 'typescript', 'typoscript']) AS language")
def language_filter(s, d):
    return R.available_languages(s).where(F.col("language").contains("script"))


@query("SELECT (306 + 6)::BIGINT AS languages")  # languages and aliases of such
def language_count(s, d):
    return R.available_languages(s).agg(F.count("*").alias("languages"))


# -- JSON trees


@query("""
WITH k AS (SELECT event_id, props, len(json_keys(props)) AS n FROM events)
SELECT kind, count(*)::BIGINT AS n FROM (
 SELECT unnest(list_concat(['document', 'object', '{', '}'], flatten([['pair', ':', 'string', 'string_content', '"', '"', 'number'] FOR i IN range(n)]), [',' FOR i IN range(greatest(n - 1, 0))])) AS kind FROM k)
GROUP BY kind
""")
def json_nodes_by_kind(s, d):
    return nodes(_events(s, d), columns=["kind"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id AS doc_id, 'document' AS kind, 0::BIGINT AS start_byte, strlen(props)::BIGINT AS end_byte, 1::BIGINT AS named_child_count FROM events")
def json_root_info(s, d):
    r = tree.root_node_info(nodes(_events(s, d), kinds=["document"]))
    return r.select("doc_id", "node.kind", "node.start_byte", "node.end_byte", "node.named_child_count")


@query("SELECT event_id AS doc_id, 'object' AS kind FROM events")
def json_named_children(s, d):
    return tree.named_children_info(nodes(_events(s, d))).select("doc_id", "node.kind")


@query("SELECT event_id AS doc_id, '(document (object' || array_to_string([' (pair key: (string (string_content)) value: (number))' FOR i IN range(len(json_keys(props)))], '') || '))' AS sexp FROM events")
def json_sexp(s, d):
    return tree.tree_to_sexp(_events(s, d))


@query("""
SELECT event_id AS doc_id, k.k AS "key", json_extract_string(props, '$."' || k.k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) k
""")
def json_run_query_pairs(s, d):
    m = extract.extract_patterns(_events(s, d), {"language": "json", "patterns": {"pairs": {"query": "(pair key: (string (string_content) @k) value: (number) @v)", "capture_output": "Text"}}})
    x = m.select("doc_id", F.explode("matches").alias("m"))
    return x.select("doc_id", F.get("m.captures", F.lit(0))["text"].alias("key"), F.get("m.captures", F.lit(1))["text"].alias("value"))


@query("SELECT event_id AS doc_id, event_id % 3 = 0 AS has_error_nodes FROM events")
def json_error_flag(s, d):
    e = _events(s, d)
    cut = F.when(F.col("doc_id") % 3 == 0, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return tree.has_error_nodes(nodes(e.withColumn("text", cut), columns=["is_error", "is_missing"]))


@query("SELECT event_id AS doc_id, true AS found FROM events")
def json_contains_object(s, d):
    return tree.contains_node_type(nodes(_events(s, d), columns=["kind"]), "object")


@query("SELECT event_id AS doc_id, json_keys(props)[1] AS text FROM events WHERE len(json_keys(props)) > 0")
def json_extract_text(s, d):
    e = _events(s, d)
    first = nodes(e, kinds=["string_content"], columns=["node_id", "start_byte", "end_byte"]).groupBy("doc_id").agg(F.min_by(F.struct("node_id", "start_byte", "end_byte"), "node_id").alias("n")).select("doc_id", "n.*")
    return tree.extract_text(first, e).select("doc_id", "text")


# -- HTML

_BARE = r"regexp_replace(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<\1></\2>', 'gs'), '<!--.*?-->', '', 'gs')"


@query(f"SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all({_BARE}, '<([a-z0-9]+)[ >/]', 1)) AS tag FROM pages) GROUP BY tag")
def html_tag_counts(s, d):
    m = extract.extract_patterns(_pages(s, d), {"language": "html", "patterns": {"tags": {"query": "[(start_tag (tag_name) @t) (self_closing_tag (tag_name) @t)]", "capture_output": "Text"}}})
    return m.select(F.explode("matches").alias("m")).select(F.get("m.captures", F.lit(0))["text"].alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<!--.*?-->', 0, 's')) AS text FROM pages")
def html_comments(s, d):
    return intel.feature_table(trees(_pages(s, d)), "comments").select("doc_id", "text")


@query("SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<(script|style)>(.+?)</(script|style)>', 2, 's')) AS text FROM pages")
def html_raw_text(s, d):
    return nodes(_pages(s, d), kinds=["raw_text"], text_kinds=["raw_text"]).select("doc_id", F.col("text").cast("string").alias("text"))


@query(f"SELECT page_id AS doc_id, len(t)::BIGINT AS total_count, array_to_string(t[1:3], ',') AS tags FROM (SELECT page_id, regexp_extract_all({_BARE}, '<([a-z0-9]+)[ >/]', 1) AS t FROM pages)")
def html_extract_topn(s, d):
    m = extract.extract_patterns(_pages(s, d), {"language": "html", "patterns": {"tags": {"query": "[(start_tag (tag_name) @t) (self_closing_tag (tag_name) @t)]", "capture_output": "Text", "max_results": 3}}})
    return m.select("doc_id", "total_count", F.array_join(F.transform("matches", lambda x: x.captures[0].text), ",").alias("tags"))


@query("SELECT page_id AS doc_id, 1::BIGINT AS total_count FROM pages")
def html_extract_range(s, d):
    m = extract.extract_patterns(_pages(s, d), {"language": "html", "patterns": {"doctype": {"query": "(doctype) @d", "byte_range": [3, 9]}, "late": {"query": "(doctype) @d", "byte_range": [9999999, 99999999]}}})
    return m.where("pattern_name = 'doctype'").select("doc_id", "total_count")


@query("SELECT page_id AS doc_id, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/[^\"]*\">', 0)) FROM pages) GROUP BY 1")
def html_predicate(s, d):
    m = squery.run_query(_pages(s, d), "html", '((attribute (attribute_name) @n (quoted_attribute_value (attribute_value) @v)) (#eq? @n "href") (#match? @v "^/"))')
    return m.groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def html_chunk_metadata(s, d):
    c = chunk.chunk_table(_pages(s, d), 1000)
    return c.select("doc_id", F.col("metadata.chunk_index").alias("chunk_index"), "start_byte", "end_byte", "start_line", "end_line", F.to_json("metadata.node_types").alias("node_types"), F.col("metadata.has_error_nodes").alias("has_error_nodes"))


@query()
def process_html_wide(s, d):
    p = api.process(_pages(s, d), ProcessConfig("html").all().with_chunking(1000))
    return p.select("doc_id", "language", "metrics.*", F.size("comments").alias("n_comments"), F.size("diagnostics").alias("n_diagnostics"), F.size("chunks").alias("n_chunks"))


@query("SELECT page_id AS doc_id, strlen(html)::BIGINT AS total_bytes, strlen(html)::BIGINT AS covered FROM pages")
def html_chunk_coverage(s, d):
    t = chunk.chunk_ranges(_pages(s, d), 700)
    return t.select("doc_id", F.octet_length("text").cast("long").alias("total_bytes"), F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r.end_byte - r.start_byte).alias("covered"))


# -- chunks of prose


@query("""
WITH RECURSIVE lines AS (
 SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest([strlen(x) FOR x IN l]) + CASE WHEN unnest(range(1, len(l) + 1)) < len(l) THEN 1 ELSE 0 END AS n, len(l) AS k, strlen(text) AS total
 FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) WHERE text <> ''),
long AS (SELECT doc_id FROM lines GROUP BY doc_id HAVING max(n) > 4000),
fold AS (
 SELECT doc_id, 1 AS i, 0::BIGINT AS begin_, n::BIGINT AS end_, 0 AS c, k, total FROM lines WHERE i = 1 AND doc_id NOT IN (SELECT doc_id FROM long)
 UNION ALL
 SELECT f.doc_id, f.i + 1, CASE WHEN f.end_ + l.n - f.begin_ > 4000 AND f.total > 4000 THEN f.end_ ELSE f.begin_ END, f.end_ + l.n, CASE WHEN f.end_ + l.n - f.begin_ > 4000 AND f.total > 4000 THEN f.c + 1 ELSE f.c END, f.k, f.total
 FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, c::BIGINT AS chunk_index, min(begin_)::BIGINT AS start_byte, max(end_)::BIGINT AS end_byte FROM fold GROUP BY doc_id, c
""")
def chunk_lines(s, d):
    docs = _docs(s, d).select("doc_id", "text")
    lines = F.split("text", "\n")
    ends = F.transform(lines, lambda x, i: F.octet_length(x) + F.when(i < F.size(lines) - 1, 1).otherwise(0))
    return chunk.chunk_plain(docs.where(F.array_max(ends) <= 4000), 4000)


@query("SELECT doc_id, strlen(text)::BIGINT AS covered FROM documents WHERE text <> ''")
def chunk_coverage(s, d):
    c = chunk.chunk_plain(_docs(s, d).select("doc_id", "text"), 500)
    return c.groupBy("doc_id").agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("covered"))


# -- code, made by the same concatenation on both sides

_PY = 'import os\\nfrom a{i} import b, c\\n\\n# note {i}\\nclass K{i}(Base):\\n    """Doc {i}."""\\n\\n    def m{i}(self, x: int) -> int:\\n        """Inner {i}."""\\n        return x\\n\\ndef f{i}():\\n    pass\\n'
_PY = _PY.replace("\\n", "\n")
_TS = "import { a } from 'm{i}';\nexport function f{i}(x: number): number { return x; }\nexport const V{i}: number = 1;\nexport { a } from './o{i}';\ninterface I{i} { a: string }\ntype T{i} = string;\nenum E{i} { A, B }\nclass C{i} { m() {} }\n"
_GO = 'package p{i}\n\nimport (\n\t"fmt"\n\t"a/b{i}"\n)\n\ntype S{i} struct {\n\tA int\n}\n\ntype R{i} interface {\n\tM() int\n}\n\nfunc F{i}() {}\n\nfunc (s S{i}) M{i}() int { return 1 }\n'
_RS = "use std::io::*;\n\n/// Doc {i}\npub struct S{i} { a: i32 }\n\npub enum E{i} { A, B }\n\ntrait T{i} { fn t(&self); }\n\nimpl S{i} {\n    pub fn new{i}() -> Self { S{i} { a: 1 } }\n}\n\nmod m{i} { fn inner{i}() {} }\n"
_JAVA = "package com.x{i};\n\nimport java.util.*;\n\npublic class W{i} {\n    public String name{i}() { return \"w\"; }\n}\n\ninterface I{i} {}\n"


def _made(s: SparkSession, d: str, language: str, template: str) -> DataFrame:
    parts = template.split("{i}")
    cols = [F.lit(parts[0])]
    for p in parts[1:]:
        cols += [_id(), F.lit(p)]
    return _code(s, d, language, F.concat(*cols))


def _values(rows: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT n_nationkey::BIGINT AS doc_id, {r} FROM nation" for r in rows)


_I = "' || n_nationkey || '"


@query(_values([f"'Class' AS kind, 'K{_I}' AS name, NULL AS parent", f"'Function', 'm{_I}', 'K{_I}'", f"'Function', 'f{_I}', NULL"]))
def py_structure(s, d):
    t = trees(_made(s, d, "python", _PY)).select("doc_id", intel.structure().alias("s")).select("doc_id", "s", F.explode("s").alias("x"))
    parent = F.get(F.filter("s", lambda y: y.item_id == F.col("x.parent_item_id")), F.lit(0))["name"]
    return t.select("doc_id", "x.kind", "x.name", parent.alias("parent"))


@query(_values(["'import os' AS source, false AS is_wildcard", f"'from a{_I} import b, c', false"]))
def py_imports(s, d):
    return intel.feature_table(trees(_made(s, d, "python", _PY)), "imports").select("doc_id", "source", "is_wildcard")


@query(_values([f"'K{_I}' AS name, 'Class' AS kind", f"'m{_I}', 'Function'", f"'f{_I}', 'Function'"]))
def py_symbols(s, d):
    return intel.feature_table(trees(_made(s, d, "python", _PY)), "symbols").select("doc_id", "name", "kind")


@query(_values([f"""'\"\"\"Doc {_I}.\"\"\"' AS text, 'K{_I}' AS associated_item""", f"""'\"\"\"Inner {_I}.\"\"\"', 'm{_I}'"""]))
def py_docstrings(s, d):
    return intel.feature_table(trees(_made(s, d, "python", _PY)), "docstrings").select("doc_id", "text", "associated_item")


@query(_values([f"'# note {_I}' AS text, 'Line' AS kind, 'class_definition' AS associated_node"]))
def py_comments(s, d):
    return intel.feature_table(trees(_made(s, d, "python", _PY)), "comments").select("doc_id", "text", "kind", "associated_node")


@query("SELECT n_nationkey::BIGINT AS doc_id, 13::BIGINT AS total_lines, 3::BIGINT AS blank_lines, 1::BIGINT AS comment_lines, 9::BIGINT AS code_lines, 0::BIGINT AS error_count FROM nation")
def py_metrics(s, d):
    return trees(_made(s, d, "python", _PY)).select("doc_id", intel.metrics().alias("m")).select("doc_id", "m.total_lines", "m.blank_lines", "m.comment_lines", "m.code_lines", "m.error_count")


@query(_values([f"'m{_I}' AS name, 'K{_I}' AS owner"]))
def py_run_query(s, d):
    q = "(class_definition name: (identifier) @owner body: (block (function_definition name: (identifier) @name)))"
    m = extract.extract_patterns(_made(s, d, "python", _PY), {"language": "python", "patterns": {"m": {"query": q}}})
    x = m.select("doc_id", F.explode("matches").alias("m"))
    return x.select("doc_id", F.get("m.captures", F.lit(1))["text"].alias("name"), F.get("m.captures", F.lit(0))["text"].alias("owner"))


@query(_values([f"'m{_I}' AS name, '(self, x: int)' AS parameters, 'int' AS return_type", f"'f{_I}', '()', NULL"]))
def py_child_fields(s, d):
    m = extract.extract_patterns(_made(s, d, "python", _PY), {"language": "python", "patterns": {"f": {"query": "(function_definition) @f", "child_fields": ["name", "parameters", "return_type"]}}})
    x = m.select("doc_id", F.explode("matches").alias("m")).select("doc_id", F.get("m.captures", F.lit(0))["child_fields"].alias("c"))
    return x.select("doc_id", *(F.element_at("c", k).alias(k) for k in ("name", "parameters", "return_type")))


@query(_values([f"'export function f{_I}(x: number): number {{ return x; }}' AS name, 'Named' AS kind", f"'export const V{_I}: number = 1;', 'Named'", f"'export {{ a }} from ''./o{_I}'';', 'ReExport'"]))
def ts_exports(s, d):
    return intel.feature_table(trees(_made(s, d, "typescript", _TS)), "exports").select("doc_id", "name", "kind")


@query(_values([f"'f{_I}' AS name, 'Function' AS kind", f"'I{_I}', 'Interface'", f"'T{_I}', 'Type'", f"'E{_I}', 'Enum'", f"'C{_I}', 'Class'"]))
def ts_symbols(s, d):
    return intel.feature_table(trees(_made(s, d, "typescript", _TS)), "symbols").select("doc_id", "name", "kind")


@query(_values(["'import (\n\t\"fmt\"\n\t\"a/b" + _I + "\"\n)' AS source", "'\"fmt\"'", f"'\"a/b{_I}\"'"]))
def go_imports(s, d):
    return intel.feature_table(trees(_made(s, d, "go", _GO)), "imports").select("doc_id", "source")


@query(_values([f"'S{_I}' AS name, 'Type' AS kind", f"'R{_I}', 'Interface'", f"'F{_I}', 'Function'"]))
def go_symbols(s, d):
    return intel.feature_table(trees(_made(s, d, "go", _GO)), "symbols").select("doc_id", "name", "kind")


@query(_values([f"'Struct' AS kind, 'S{_I}' AS name", f"'Enum', 'E{_I}'", f"'Trait', 'T{_I}'", f"'Impl', 'S{_I}'", f"'Function', 'new{_I}'", f"'Module', 'm{_I}'", f"'Function', 'inner{_I}'"]))
def rust_structure(s, d):
    return intel.feature_table(trees(_made(s, d, "rust", _RS)), "structure").select("doc_id", "kind", "name")


@query(_values([f"'Module' AS kind, 'com.x{_I}' AS name", f"'Class', 'W{_I}'", f"'Method', 'name{_I}'", f"'Interface', 'I{_I}'"]))
def java_structure(s, d):
    return intel.feature_table(trees(_made(s, d, "java", _JAVA)), "structure").select("doc_id", "kind", "name")


@query(_values(["'import java.util.*;' AS source, true AS is_wildcard"]))
def java_imports(s, d):
    return intel.feature_table(trees(_made(s, d, "java", _JAVA)), "imports").select("doc_id", "source", "is_wildcard")


@query("SELECT 'good' AS pattern_name, true AS valid, 1::BIGINT AS pattern_count, 'name' AS captures UNION ALL SELECT 'bad', false, 0, ''")
def validate_patterns(s, d):
    v = extract.validation_rows(s, {"language": "python", "patterns": {"good": {"query": "(function_definition name: (identifier) @name)"}, "bad": {"query": "((("}}})
    return v.select("pattern_name", "valid", "pattern_count", F.array_join("capture_names", ",").alias("captures"))


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN 'Missing expected node: )' END AS message FROM nation WHERE n_nationkey % 3 = 0")
def py_diagnostics(s, d):
    text = F.when(F.col("doc_id") % 3 == 0, "x = f(1\n").otherwise("x = f(1)\n")
    return intel.feature_table(trees(_code(s, d, "python", text)), "diagnostics").select("doc_id", "message")

_KT = "package foo.x{i}\n\nimport a.b{i}\n\nclass W{i} {\n    fun g(): String = \"hi\"\n}\n\nfun top{i}(a: Int): Int { return a }\n"
_RB = "require 'json'\n\nclass G{i}\n  def hail(who)\n    who\n  end\n\n  class N{i}\n  end\nend\n"
_C = '#include <stdio.h>\n\nint main{i}(void) {\n    printf("x");\n    return 0;\n}\n'
_JS = "import fs from 'f{i}';\n// note {i}\nfunction f{i}(x) { return x; }\nclass C{i} { m{i}() { return 1; } }\nconst g{i} = (a) => a;\nexport default class D{i} {}\n"


@query(_values([f"'Module' AS kind, 'foo.x{_I}' AS name", f"'Class', 'W{_I}'", f"'Function', NULL"]))
def kotlin_structure(s, d):
    return intel.feature_table(trees(_made(s, d, "kotlin", _KT)), "structure").select("doc_id", "kind", "name")


@query(_values([f"'import a.b{_I}' AS source"]))
def kotlin_imports(s, d):
    return intel.feature_table(trees(_made(s, d, "kotlin", _KT)), "imports").select("doc_id", "source")


@query(_values([f"'Class' AS kind, 'G{_I}' AS name", f"'Class', 'N{_I}'"]))
def ruby_structure(s, d):
    return intel.feature_table(trees(_made(s, d, "ruby", _RB)), "structure").select("doc_id", "kind", "name")


@query("SELECT n_nationkey::BIGINT AS doc_id, 'Function' AS kind, NULL::VARCHAR AS name, 6::BIGINT AS total_lines, 1::BIGINT AS comment_lines FROM nation")
def c_structure(s, d):
    t = trees(_made(s, d, "c", _C)).select("doc_id", F.explode(intel.structure()).alias("x"), intel.metrics().alias("m"))
    return t.select("doc_id", "x.kind", "x.name", "m.total_lines", "m.comment_lines")


@query(_values([f"'Function' AS kind, 'f{_I}' AS name", f"'Class', 'C{_I}'", f"'Method', 'm{_I}'", "'Function', 'a'", f"'Class', 'D{_I}'"]))
def js_structure(s, d):
    return intel.feature_table(trees(_made(s, d, "javascript", _JS)), "structure").select("doc_id", "kind", "name")


@query(_values([f"'// note {_I}' AS text, 'Line' AS kind, 'function_declaration' AS associated_node"]))
def js_comments(s, d):
    return intel.feature_table(trees(_made(s, d, "javascript", _JS)), "comments").select("doc_id", "text", "kind", "associated_node")


@query(_values([f"'E{_I}' AS name, 'Enum' AS kind", f"'new{_I}', 'Function'", f"'inner{_I}', 'Function'"]))
def rust_symbols(s, d):
    return intel.feature_table(trees(_made(s, d, "rust", _RS)), "symbols").select("doc_id", "name", "kind")


@query(_values(["'use std::io::*;' AS source, true AS is_wildcard"]))
def rust_imports(s, d):
    return intel.feature_table(trees(_made(s, d, "rust", _RS)), "imports").select("doc_id", "source", "is_wildcard")


@query("SELECT n_nationkey::BIGINT AS doc_id, 2::BIGINT AS functions, 1::BIGINT AS classes, 3::BIGINT AS items FROM nation")
def process_extractions(s, d):
    patterns = {"f": {"query": "(function_definition) @f"}, "c": {"query": "(class_definition) @c", "max_results": 0}}
    p = api.process(_made(s, d, "python", _PY), {"language": "python", "extractions": patterns})
    n = lambda k: F.element_at("extractions", k)["total_count"]
    return p.select("doc_id", n("f").alias("functions"), n("c").alias("classes"), F.size("structure").cast("long").alias("items"))


@query("SELECT event_id AS doc_id, 3 * len(json_keys(props))::BIGINT + 2 AS named FROM events")
def json_udtf(s, d):
    D.register_functions(s)
    _events(s, d).createOrReplaceTempView("treeloom_events")
    return s.sql("SELECT e.doc_id, count_if(n.is_named) + count_if(n.kind = 'never') AS named FROM treeloom_events e, LATERAL parse_nodes(e.text, 'json') n WHERE n.kind <> 'string_content' GROUP BY e.doc_id")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', {len(q)}::BIGINT)" for (a, k), q in sorted(R.BUNDLED.items())) + ") v(language, kind, chars)")
def bundled_queries(s, d):
    return R.bundled_queries(s).select("language", "kind", F.length("query").cast("long").alias("chars"))


_COMMON = "c c, cc cpp, cpp cpp, cs csharp, css css, dart dart, ex elixir, go go, hs haskell, html html, java java, jl julia, js javascript, json json, kt kotlin, lua lua, md markdown, php php, pl perl, py python, r r, rb ruby, rs rust, scala scala, sh bash, sql sql, swift swift, toml toml, ts typescript, tsx tsx, vue vue, yaml yaml, zig zig"
_COMMON = [tuple(x.split()) for x in _COMMON.split(", ")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _COMMON) + ") v(extension, language)")
def extension_table(s, d):
    return R.extensions(s).where(F.col("extension").isin([k for k, _ in _COMMON]))


@query("SELECT page_id, depth, count(*)::BIGINT AS n FROM (SELECT page_id, unnest([0, 1]) AS depth FROM pages) GROUP BY ALL")
def html_top_depths(s, d):
    n = nodes(_pages(s, d), kinds=["document", "doctype"]).where("is_named")  # the token in the declaration has its kind
    return n.groupBy(F.col("doc_id").alias("page_id"), F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("n"))


# -- trees that are kept, and what else has no query of its own above


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS error_count FROM events")
def json_error_count(s, d):
    e = _events(s, d)
    cut = F.when(F.col("doc_id") % 3 == 0, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return tree.error_count(nodes(e.withColumn("text", cut), columns=["is_error", "is_missing"]))


@query("SELECT event_id AS doc_id, len(json_keys(props))::BIGINT AS pairs, strlen(props)::BIGINT - 2 - 2 * (len(json_keys(props)) - 1)::BIGINT AS pair_bytes FROM events WHERE len(json_keys(props)) > 0")
def json_find_nodes(s, d):
    found = tree.find_nodes_by_type(nodes(_events(s, d), kinds=["pair"]), "pair")
    return found.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.col("node.end_byte") - F.col("node.start_byte")).alias("pair_bytes"))


@query("""
SELECT event_id AS doc_id, 'document object {' || array_to_string([CASE WHEN i > 0 THEN ' ,' ELSE '' END || ' pair string " string_content " : number' FOR i IN range(len(json_keys(props)))], '') || ' }' AS kinds FROM events
""")
def json_traverse(s, d):
    t = tree.traverse(nodes(_events(s, d), columns=["node_id", "kind"]))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("node_id", "kind"))), lambda x: x.kind)
    return t.groupBy("doc_id").agg(F.array_join(in_order, " ").alias("kinds"))


@query("SELECT event_id AS doc_id, 2 + 7 * len(json_keys(props))::BIGINT + 2 + greatest(len(json_keys(props)) - 1, 0)::BIGINT AS node_count, 4::BIGINT AS max_depth, 0::BIGINT AS error_count FROM events WHERE len(json_keys(props)) > 0")
def json_tree_metrics(s, d):
    return tree.tree_metrics(nodes(_events(s, d), columns=["is_error", "is_missing", "depth"]))


@query("SELECT page_id AS doc_id, len(t)::BIGINT AS total_count, array_to_string(t, ',') AS tags FROM (SELECT page_id, regexp_extract_all(" + _BARE + ", '<([a-z0-9]+)[ >/]', 1) AS t FROM pages)")
def html_extract_from_trees(s, d):
    kept = trees(_pages(s, d), columns=squery.MATCHED)
    m = extract.extract_from_trees(kept, {"language": "html", "patterns": {"tags": {"query": "[(start_tag (tag_name) @t) (self_closing_tag (tag_name) @t)]", "capture_output": "Text"}}})
    return m.select("doc_id", "total_count", F.array_join(F.transform("matches", lambda x: x.captures[0].text), ",").alias("tags"))


@query(r"SELECT page_id AS doc_id, len(regexp_extract_all(" + _BARE + r""", ' (class|lang|charset|id|src|alt)="[^"]*"', 1))::BIGINT AS n FROM pages WHERE n > 0""")
def html_predicates_negated(s, d):
    q = '((attribute (attribute_name) @n) (#not-eq? @n "href") (#not-match? @n "^data") (#any-of? @n "class" "lang" "charset" "id" "src" "alt"))'
    m = squery.run_query_on_trees(trees(_pages(s, d), columns=squery.SHOWN), "html", q)
    return m.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_values(["strlen('" + _PY.replace("'", "''").replace("{i}", _I) + "')::BIGINT - 5 AS start_byte, 4::BIGINT AS n_bytes"]))
def py_body_span(s, d):
    x = intel.feature_table(trees(_made(s, d, "python", _PY)), "structure").where(F.col("name").startswith("f"))
    return x.select("doc_id", F.col("body_span.start_byte").alias("start_byte"), (F.col("body_span.end_byte") - F.col("body_span.start_byte")).alias("n_bytes"))


@query(_values([f"'export default class D{_I} {{}}' AS name, 'Named' AS kind"]))
def js_exports(s, d):
    return intel.feature_table(trees(_made(s, d, "javascript", _JS)), "exports").select("doc_id", "name", "kind")


@query("SELECT n_nationkey::BIGINT AS doc_id, 'Syntax error: unexpected ' || chr(39) || ']' || chr(39) AS message FROM nation WHERE n_nationkey % 2 = 0")
def json_diagnostics(s, d):
    text = F.when(F.col("doc_id") % 2 == 0, '{"a": 1 ]}').otherwise('{"a": 1}')
    return intel.feature_table(trees(_code(s, d, "json", text)), "diagnostics").select("doc_id", "message")


_REAL = """package p{i}

func Open{i}(name string) (*File, error) {
	f, err := os.Open(name)
	if v, ok := cache[name]; ok {
		return v, nil
	}
	a, b = b, a
	return f, err
}
"""


@query("SELECT n_nationkey::BIGINT AS doc_id, 0::BIGINT AS errors, 3::BIGINT AS declared, 2::BIGINT AS returned FROM nation")
def go_expression_lists(s, d):
    n = nodes(_made(s, d, "go", _REAL))
    return n.groupBy("doc_id").agg(F.count_if(tree.broken()).alias("errors"), F.count_if(F.col("kind").isin("short_var_declaration", "assignment_statement")).alias("declared"), F.count_if(F.col("kind") == "return_statement").alias("returned"))


_TSX = """type P{i} = Base<'a'> & { side?: 'l' | 'r'; pick(x: number): void };
export function C{i}({ title, ...props }: { title?: string }) {
  return <div className="c" {...props}>it's {title} <br/>// text</div>;
}
"""


@query(_values([f"'P{_I}' AS name, 'Type' AS kind, 0::BIGINT AS errors, 1::BIGINT AS elements", f"'C{_I}', 'Function', 0, 1"]))
def tsx_symbols(s, d):
    t = trees(_made(s, d, "tsx", _TSX))
    count = lambda test: F.size(F.filter("nodes", test)).cast("long")
    x = t.select("doc_id", F.explode(intel.symbols()).alias("x"), count(lambda n: n.is_error | n.is_missing).alias("errors"), count(lambda n: n.kind == "jsx_element").alias("elements"))
    return x.select("doc_id", "x.name", "x.kind", "errors", "elements")


_MATCH = "fn f{i}(x: Kind) -> u8 {\n    match x {\n        Kind::A => 1,\n        Kind::B | Kind::C(..) if ok() => list.iter().map(|t| t + 1).sum(),\n        _ => { 0 }\n    }\n}\n"


@query("SELECT n_nationkey::BIGINT AS doc_id, 3::BIGINT AS arms, 1::BIGINT AS closures, 0::BIGINT AS errors FROM nation")
def rust_match_arms(s, d):
    n = nodes(_made(s, d, "rust", _MATCH))
    return n.groupBy("doc_id").agg(F.count_if(F.col("kind") == "match_arm").alias("arms"), F.count_if(F.col("kind") == "closure_expression").alias("closures"), F.count_if(tree.broken()).alias("errors"))


_CHUNKED = "class K{i}:\n    def a(self):\n        pass\n\n    # note\n    def b(self):\n        pass\n"


@query(_values([
    f"0::BIGINT AS chunk_index, 0::BIGINT AS start_byte, strlen('class K{_I}:') + 5 AS end_byte, 'K{_I}' AS symbols, '' AS context, '' AS comments",
    f"1, strlen('class K{_I}:') + 5, strlen('class K{_I}:') + 36, 'K{_I},a', 'K{_I}', ''",
    f"2, strlen('class K{_I}:') + 36, strlen('class K{_I}:') + 73, 'K{_I},b', 'K{_I}', '# note>function_definition'",
]))
def py_chunks(s, d):
    c = chunk.chunk_table(_made(s, d, "python", _CHUNKED), 40)
    joined = lambda x: F.array_join(f"metadata.{x}", ",")
    notes = F.array_join(F.transform("metadata.comments", lambda x: F.concat(x.text, F.lit(">"), x.associated_node)), ",")
    return c.select("doc_id", "metadata.chunk_index", "start_byte", "end_byte", joined("symbols_defined").alias("symbols"), joined("context_path").alias("context"), notes.alias("comments"))


_TOML = '# tank {i}\n[tank{i}]\nname = "n{i}"\nparts.size = [1, 2.5]\nwhen = 2020-01-02\n\n[[valve]]\nopen = { now = true }\n'
_CSS = "@media print { a.c{i} > b, #d{i}:hover { color: red; width: {i}px !important } }\n/* note {i} */\np { margin: calc(1em + 2px) }\n"


@query(_values(["'(document (comment) (table (bare_key) (pair (bare_key) (string)) (pair (dotted_key (bare_key) (bare_key)) (array (integer) (float))) (pair (bare_key) (local_date))) (table_array_element (bare_key) (pair (bare_key) (inline_table (pair (bare_key) (boolean))))))' AS sexp"]))
def toml_sexp(s, d):
    return tree.tree_to_sexp(_made(s, d, "toml", _TOML))


@query(_values(["'selectors' AS kind, 2::BIGINT AS n", "'declaration', 3", "'rule_set', 2", "'class_name', 2", "'comment', 1", "'media_statement', 1", "'call_expression', 1", "'important', 1"]))
def css_kinds(s, d):
    kinds = ["selectors", "declaration", "rule_set", "class_name", "comment", "media_statement", "call_expression", "important", "ERROR"]
    return nodes(_made(s, d, "css", _CSS), kinds=kinds).where("is_named").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Metrics of every page's syntax tree with the numbers of its most telling elements."""
    t = trees(_pages(spark, sf_dir))
    elements = F.filter("nodes", lambda n: n.kind == "element")
    return t.select("doc_id", intel.metrics().alias("m"), F.size(elements).alias("elements"), F.size(intel.comments()).alias("comments")).select("doc_id", "m.*", "elements", "comments")
