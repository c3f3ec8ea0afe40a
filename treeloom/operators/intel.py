"""Code intelligence: structure, imports, exports, comments, docstrings, symbols, diagnostics and metrics.

Each feature is a column expression over the array of a document's nodes, so a
feature that isn't selected isn't computed, and nothing is shuffled. Ids in the
links make every lookup of a name, body, parent or sibling one array access.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.lines import line_metrics

from .nodes import STRUCTURE, slice_raw

_JS = ("javascript", "typescript", "tsx")
IMPORTS: dict[str, tuple[str, ...]] = {
    "python": ("import_statement", "import_from_statement"), **{x: ("import_statement",) for x in _JS}, "rust": ("use_declaration",),
    "go": ("import_declaration", "import_spec"), "java": ("import_declaration",), "kotlin": ("import_declaration",),
}
COMMENTS = ("comment", "line_comment", "block_comment", "doc_comment", "documentation_comment")
SYMBOLS: dict[str, str] = {
    k: what
    for what, kinds in {
        "Function": "function_definition function_declaration function_item", "Class": "class_definition class_declaration", "Type": "type_alias_declaration type_item", "Interface": "interface_declaration",
        "Enum": "enum_item enum_declaration", "Constant": "const_item const_declaration", "Variable": "let_declaration variable_declaration lexical_declaration",
    }.items()
    for k in kinds.split()
}


def _map(d: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), key)


def _node(i: Column) -> Column:
    return F.when(i.isNotNull(), F.get("nodes", i.cast("int")))


def text_of(n: Column) -> Column:
    return slice_raw(n["start_byte"], n["end_byte"])


def span(n: Column) -> Column:
    return F.struct(
        n["start_byte"].alias("start_byte"), n["end_byte"].alias("end_byte"), n["start_row"].alias("start_line"), n["start_col"].alias("start_column"), n["end_row"].alias("end_line"), n["end_col"].alias("end_column"),
    )


def metrics() -> Column:
    m = line_metrics("text")
    broken = F.filter("nodes", lambda n: n.is_error | n.is_missing)
    return F.struct(
        *(m[x].alias(x) for x in ("total_lines", "code_lines", "comment_lines", "blank_lines", "total_bytes")),
        F.size("nodes").cast("long").alias("node_count"), F.size(broken).cast("long").alias("error_count"), F.array_max(F.transform("nodes", lambda n: n.depth)).alias("max_depth"),
    )


def structure() -> Column:
    """Items in document order; parent_item_id is the item around one, null at the top."""
    items = F.filter("nodes", lambda n: n.reached & _map(STRUCTURE, n.kind).isNotNull())

    def item(n: Column) -> Column:
        name = _node(n.name_id)
        named = text_of(name)
        nothing = F.lit(None).cast("string")
        return F.struct(
            n.node_id.alias("item_id"), n.item_id.alias("parent_item_id"), _map(STRUCTURE, n.kind).alias("kind"), F.coalesce(F.when(named != "", named), text_of(_node(n.fallback_name_id))).alias("name"),
            nothing.alias("visibility"), span(n).alias("span"), F.array().cast("array<string>").alias("decorators"), nothing.alias("doc_comment"), nothing.alias("signature"), F.when(n.body_id.isNotNull(), span(_node(n.body_id))).alias("body_span"),
        )

    return F.transform(items, item)


def imports() -> Column:
    wanted = F.lit(False)
    for lang, kinds in IMPORTS.items():
        wanted = F.when(F.col("language") == lang, F.lit(",".join(kinds))).otherwise(wanted.cast("string"))
    found = F.filter("nodes", lambda n: F.array_contains(F.split(wanted, ","), n.kind))
    return F.transform(found, lambda n: F.struct(text_of(n).alias("source"), F.array().cast("array<string>").alias("items"), F.lit(None).cast("string").alias("alias"), text_of(n).contains("*").alias("is_wildcard"), span(n).alias("span")))


def exports() -> Column:
    found = F.filter("nodes", lambda n: F.col("language").isin(*_JS) & (n.kind == "export_statement"))

    def item(n: Column) -> Column:
        default = F.exists("nodes", lambda k: (k.parent_id == n.node_id) & (k.field_name == "default"))
        return F.struct(F.element_at(F.split(text_of(n), r"\r?\n"), 1).alias("name"), F.when(default, "Default").when(n.source_id.isNotNull(), "ReExport").otherwise("Named").alias("kind"), span(n).alias("span"))

    return F.transform(found, item)


def comment_kind(kind: Column, text: Column, hashes: bool = True) -> Column:
    doc = text.startswith("///") | text.startswith("//!") | text.startswith("/**") | text.startswith("/*!")
    if hashes:
        doc = doc | text.startswith("##")
    return F.when(kind.isin("doc_comment", "documentation_comment"), "Doc").when(kind == "block_comment", "Block").when(doc, "Doc").otherwise("Line")


def comments() -> Column:
    found = F.filter("nodes", lambda n: n.kind.isin(*COMMENTS))
    return F.transform(found, lambda n: F.struct(text_of(n).alias("text"), comment_kind(n.kind, text_of(n)).alias("kind"), span(n).alias("span"), _node(n.next_named_id)["kind"].alias("associated_node")))


def docstrings() -> Column:
    def is_doc(n: Column) -> Column:
        first, parent = _node(n.node_id + 1), _node(n.parent_id)
        return (F.col("language") == "python") & (n.kind == "expression_statement") & (first["parent_id"] == n.node_id) & first["kind"].isin("string", "concatenated_string") & parent["kind"].isin("block", "module")

    def item(n: Column) -> Column:
        owner = _node(_node(n.parent_id)["parent_id"])
        return F.struct(
            text_of(_node(n.node_id + 1)).alias("text"), F.lit("PythonTripleQuote").alias("format"), span(n).alias("span"), text_of(_node(owner["name_id"])).alias("associated_item"),
            F.array().cast("array<struct<kind:string,name:string,description:string>>").alias("parsed_sections"),
        )

    return F.transform(F.filter("nodes", is_doc), item)


def symbols() -> Column:
    def kind(n: Column) -> Column:
        return F.when(n.kind == "type_spec", F.when(_node(n.type_id)["kind"] == "interface_type", "Interface").otherwise("Type")).otherwise(_map(SYMBOLS, n.kind))

    found = F.filter("nodes", lambda n: kind(n).isNotNull() & n.name_id.isNotNull())
    return F.transform(found, lambda n: F.struct(text_of(_node(n.name_id)).alias("name"), kind(n).alias("kind"), span(n).alias("span"), text_of(_node(n.type_id)).alias("type_annotation"), F.lit(None).cast("string").alias("doc")))


def diagnostics() -> Column:
    found = F.filter("nodes", lambda n: n.is_error | n.is_missing)
    message = lambda n: F.when(n.is_error, F.concat(F.lit("Syntax error: unexpected '"), text_of(n), F.lit("'"))).otherwise(F.concat(F.lit("Missing expected node: "), n.kind))
    return F.transform(found, lambda n: F.struct(message(n).alias("message"), F.lit("Error").alias("severity"), span(n).alias("span")))


FEATURES = {"structure": structure, "imports": imports, "exports": exports, "comments": comments, "docstrings": docstrings, "symbols": symbols, "diagnostics": diagnostics}


def feature_table(trees: DataFrame, feature: str) -> DataFrame:
    """One feature of all trees as rows: doc_id, position, and the feature's fields."""
    col = FEATURES[feature]()
    return trees.select("doc_id", "language", F.posexplode(col).alias("position", "x")).select("doc_id", "language", "position", "x.*")
