"""Parsing: a DataFrame of sources becomes trees (one row a document) or nodes (one row a node).

Both come from one pass of Arrow batches through the parser, with no shuffle.
Only rows of a language with a parser reach Python; the others get their error
column from an expression. Arrow batches are kept small, for a row is a whole
source.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import registry as R
from treeloom.plans import schemas as S

from .parsers.base import COLUMNS, Node, flatten, sexp

BATCH_ROWS, MOST_FRAMES = 256, 500_000
STRUCTURE: dict[str, str] = {
    kind: what
    for what, kinds in {
        "Function": "function_definition function_declaration function_item arrow_function", "Method": "method_definition method_declaration", "Class": "class_definition class_declaration class", "Struct": "struct_item struct_definition struct_declaration",
        "Interface": "interface_declaration interface_definition", "Enum": "enum_item enum_definition enum_declaration", "Module": "module_definition mod_item package_header package_declaration", "Trait": "trait_item", "Impl": "impl_item",
    }.items()
    for kind in kinds.split()
}

#: Beside the node's own columns: ids of its name, body and type fields and next named sibling, of the item it
#: lies in, and whether the walk that collects items reaches it (below an item it goes on in the body alone).
LINKS = [("name_id", "bigint"), ("fallback_name_id", "bigint"), ("body_id", "bigint"), ("type_id", "bigint"), ("source_id", "bigint"), ("next_named_id", "bigint"), ("item_id", "bigint"), ("reached", "boolean")]
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
_NAMES = [n for n, _ in S.TREE_FIELDS]


def normal(sources: DataFrame) -> DataFrame:
    """doc_id, language (aliases resolved, in want of one detected from the path or the text), text, error of each source."""
    from treeloom.functions.detect import detect_language

    cols = sources.columns
    path = F.col("path") if "path" in cols else F.lit(None).cast("string")
    lang = R.resolve_alias(F.col("language")) if "language" in cols else F.lit(None).cast("string")
    text = F.col("text")
    if dict(sources.dtypes)["text"] == "binary":
        text = F.when(F.is_valid_utf8(F.col("text").cast("string")), F.col("text").cast("string"))
    out = sources.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(lang, R.resolve_alias(detect_language(path, text))).alias("language"), text.alias("text"), F.col("text").isNull().alias("__null"))
    with_parser = sorted({*_parsers()})
    error = (
        F.when(F.col("__null"), "no text")
        .when(F.col("text").isNull(), "not valid UTF-8")
        .when(F.col("language").isNull(), "language not found")
        .when(~F.col("language").isin(*with_parser), F.concat(F.lit("language not found: "), "language"))
    )
    return out.withColumn("error", error).drop("__null")


def _parsers() -> dict[str, Callable[[bytes], Node]]:
    from .parsers import PARSERS

    return {**PARSERS, **R._ADDED}


def parse_one(language: str, text: bytes, parsers: dict | None = None, wanted: Collection[str] | None = None) -> dict[str, list]:
    """Columns of one document's nodes, the ``wanted`` ones or all.

    Parsers recurse on the heap, so deep nesting is let go as deep as the text
    can be, up to ``MOST_FRAMES``; a parser that gives up beyond yields a root
    that is an error.
    """
    parser = (parsers or _parsers())[language]
    limit = sys.getrecursionlimit()
    for frames in (limit, min(MOST_FRAMES, limit + 40 * len(text))):
        try:
            sys.setrecursionlimit(max(limit, frames))
            return flatten(parser(text), text, wanted)
        except RecursionError:
            continue
        finally:
            sys.setrecursionlimit(limit)
    return flatten(Node("ERROR", 0, len(text)), text, wanted)


def links(c: dict[str, list]) -> dict[str, list]:
    """The link columns of one document's nodes."""
    n = len(c["kind"])
    out: dict[str, list] = {name: [None] * n for name, _ in LINKS}
    out["reached"] = [True] * n
    field, kind, parent, named = c["field_name"], c["kind"], c["parent_id"], c["is_named"]
    prev_named: dict[int, int] = {}
    last_named: dict[int, int] = {}
    matched = [k in STRUCTURE for k in kind]
    seen: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        f = field[i]
        if f in ("name", "body", "type", "source"):
            key = f"{f}_id"
            if out[key][p] is None:
                out[key][p] = i
        if named[i]:
            if kind[i] in ("type_identifier", "identifier", "scoped_identifier"):
                seen.setdefault((p, kind[i]), i)
            if p in last_named:
                prev_named[i] = last_named[p]
            last_named[p] = i
        out["reached"][i] = out["reached"][p] and (not matched[p] or f == "body")
        out["item_id"][i] = p if matched[p] and out["reached"][p] else out["item_id"][p]
    for i, q in prev_named.items():
        out["next_named_id"][q] = i
    # Anonymous nodes have a next named sibling too; only comments ask for it, and they are named.
    for k in ("scoped_identifier", "identifier", "type_identifier"):
        for (p, kk), i in seen.items():
            if kk == k:
                out["fallback_name_id"][p] = i
    return out


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def parsed(sources: DataFrame, schema: str, rows: Callable[[int, str, bytes, dict], Iterator[tuple]], arrow: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Run ``rows(doc_id, language, text, columns)`` over each good source in the workers and collect what it yields."""
    small_batches(sources.sparkSession)
    added = dict(R._ADDED)

    def run(batches):
        known = {**_parsers(), **added}
        names = [n for n, _ in arrow]
        for b in batches:
            out: list[list] = [[] for _ in arrow]
            ids, langs, texts = (b.column(i).to_pylist() for i in range(3))
            for d, lang, text in zip(ids, langs, texts):
                raw = text.encode()
                for row in rows(d, lang, raw, parse_one(lang, raw, known)):
                    for col, v in zip(out, row):
                        col.append(v)
                if len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, arrow)], names)
                    out = [[] for _ in arrow]
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, arrow)], names)

    return normal(sources).where("error is null").select("doc_id", "language", "text").mapInArrow(run, schema)


def nodes(sources: DataFrame, kinds: Collection[str] | None = None, text_kinds: Collection[str] = (), columns: Collection[str] | None = None) -> DataFrame:
    """The node table: one row for each node, in pre-order within its document.

    ``kinds`` keeps only nodes of those kinds (ids and parents stay as they
    are); ``text_kinds`` fills ``text`` for nodes of those kinds; ``columns``
    are those wanted of a node's own, beside ``doc_id``, instead of all with
    language and text. All are pushed into the parse. Sources that can't be
    parsed give no row; see ``parse_errors``.
    """
    if columns is not None:
        if text_kinds or not set(columns) <= set(_NAMES):
            raise ValueError(f"columns must be some of {', '.join(_NAMES)}, without text_kinds")
        return _some_columns(sources, kinds, [(n, t) for n, t in S.TREE_FIELDS if n in columns])
    keep, texts = frozenset(kinds) if kinds is not None else None, frozenset(text_kinds)
    small_batches(sources.sparkSession)
    added = dict(R._ADDED)
    fields = S.TREE_FIELDS

    def run(batches):
        known = {**_parsers(), **added}

        def batch():
            arrays = [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(cols[n], _TYPES[t]) for n, t in fields), pa.array(slices, pa.binary()) if texts else pa.nulls(len(ids), pa.binary())]
            return pa.record_batch(arrays, ["doc_id", "language", *_NAMES, "text"])

        for b in batches:
            ids, langs, slices, cols = [], [], [], {n: [] for n in _NAMES}
            for d, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                c = parse_one(lang, raw, known)
                on = None if keep is None else [i for i, k in enumerate(c["kind"]) if k in keep]
                if on is not None:
                    c = {n: [x[i] for i in on] for n, x in c.items()}
                for n in _NAMES:
                    cols[n] += c[n]
                if texts:
                    slices += [raw[a:z] if k in texts else None for k, a, z in zip(c["kind"], c["start_byte"], c["end_byte"])]
                ids += [d] * len(c["kind"])
                langs += [lang] * len(c["kind"])
                if len(ids) > 50_000:
                    yield batch()
                    ids, langs, slices, cols = [], [], [], {n: [] for n in _NAMES}
            yield batch()

    return normal(sources).where("error is null").select("doc_id", "language", "text").mapInArrow(run, S.NODES)


def _some_columns(sources: DataFrame, kinds: Collection[str] | None, fields: list[tuple[str, str]]) -> DataFrame:
    keep = frozenset(kinds) if kinds is not None else None
    small_batches(sources.sparkSession)
    added = dict(R._ADDED)
    wanted = frozenset(n for n, _ in fields) | {"kind"}

    def run(batches):
        known = {**_parsers(), **added}

        def batch():
            return pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(cols[n], _TYPES[t]) for n, t in fields)], ["doc_id", *(n for n, _ in fields)])

        for b in batches:
            ids, cols = [], {n: [] for n, _ in fields}
            for d, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                c = parse_one(lang, text.encode(), known, wanted)
                on = None if keep is None else [i for i, k in enumerate(c["kind"]) if k in keep]
                for n, col in cols.items():
                    col += c[n] if on is None else [c[n][i] for i in on]
                ids += [d] * len(c["kind"] if on is None else on)
                if len(ids) > 50_000:
                    yield batch()
                    ids, cols = [], {n: [] for n, _ in fields}
            yield batch()

    schema = ", ".join(f"{n} {t}" for n, t in [("doc_id", "bigint"), *fields])
    return normal(sources).where("error is null").select("doc_id", "language", "text").mapInArrow(run, schema)


RANGE = pa.struct([
    ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("node_types", pa.list_(pa.string())), ("context_path", pa.list_(pa.string())), ("symbols_defined", pa.list_(pa.string())),
    ("comments", pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string()), ("span", pa.struct([(n, pa.int64()) for n in ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")])), ("associated_node", pa.string())]))),
    ("has_error_nodes", pa.bool_()),
])


def trees(sources: DataFrame, want_sexp: bool = False, chunk_max_size: int | None = None, extractions: dict | None = None, want_nodes: bool = True, columns: Collection[str] | None = None) -> DataFrame:
    """doc_id, language, raw, text, nodes, sexp, ranges, extractions: each source with its nodes and their links as one array.

    What is local to a document can then be asked with higher-order functions
    and never needs a join or a shuffle; ``raw`` has the text's bytes, which
    slices are taken from. The last three columns are null unless asked for: the
    S-expression, the byte ranges of chunks with what is in them, and the
    results of compiled patterns by name. All come from the one parse, and
    leave it as Arrow columns; nodes don't leave it where they aren't wanted,
    and have only ``columns`` where these are given.
    """
    from . import chunk, extract

    small_batches(sources.sparkSession)
    fields = [(n, t) for n, t in [*S.TREE_FIELDS, *LINKS] if columns is None or n in columns]
    if columns is not None and len(fields) != len(set(columns)):
        raise ValueError(f"columns must be some of {', '.join(n for n, _ in [*S.TREE_FIELDS, *LINKS])}")
    linked = chunk_max_size is not None or want_nodes and any(f in LINKS for f in fields)
    # What is made beside the nodes needs more of them.
    wanted = None if columns is None or linked or want_sexp or extractions is not None else frozenset(n for n, _ in fields)
    added = dict(R._ADDED)
    result = pa.map_(pa.string(), pa.struct([("matches", extract.MATCH), ("total_count", pa.int64())]))

    def run(batches):
        known = {**_parsers(), **added}

        def batch():
            arrays = [pa.array(cols[n], _TYPES[t]) for n, t in fields]
            tree = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, [n for n, _ in fields])) if want_nodes else pa.nulls(len(ids), pa.list_(pa.struct([(n, _TYPES[t]) for n, t in fields])))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(raws, pa.binary()), tree, pa.array(sexps, pa.string()), pa.array(ranges, pa.list_(RANGE)), pa.array(found, result)], ["doc_id", "language", "raw", "nodes", "sexp", "ranges", "extractions"])

        for b in batches:
            ids, langs, raws, sexps, ranges, found, ends, cols = [], [], [], [], [], [], [0], {n: [] for n, _ in fields}
            for d, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                c = parse_one(lang, raw, known, wanted)
                if linked:
                    c = {**c, **links(c)}
                if want_nodes:
                    for n, _ in fields:
                        cols[n] += c[n]
                ids.append(d)
                langs.append(lang)
                raws.append(raw)
                ends.append(len(cols[fields[0][0]]))
                sexps.append(sexp(c) if want_sexp else None)
                ranges.append(chunk.described(c, raw, chunk.split_code(raw, chunk.starts_by_depth(c), chunk_max_size)) if chunk_max_size is not None else None)
                found.append([(name, {"matches": m, "total_count": total}) for name, total, m in extract.extract_one(extractions, c, raw)] if extractions is not None else None)
                if ends[-1] > 50_000:
                    yield batch()
                    ids, langs, raws, sexps, ranges, found, ends, cols = [], [], [], [], [], [], [0], {n: [] for n, _ in fields}
            yield batch()

    span = "struct<start_byte:bigint,end_byte:bigint,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint>"
    ranges_ = f"array<struct<start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint,node_types:array<string>,context_path:array<string>,symbols_defined:array<string>,comments:array<struct<text:string,kind:string,span:{span},associated_node:string>>,has_error_nodes:boolean>>"
    schema = f"doc_id bigint, language string, raw binary, nodes array<struct<{','.join(f"{n}:{t}" for n, t in fields)}>>, sexp string, ranges {ranges_}, extractions map<string,struct<matches:{extract.MATCHES},total_count:bigint>>"
    out = normal(sources).where("error is null").select("doc_id", "language", "text").mapInArrow(run, schema)
    return out.select("doc_id", "language", "raw", F.col("raw").cast("string").alias("text"), "nodes", "sexp", "ranges", "extractions")


def from_trees(trees_: DataFrame, schema: str, rows: Callable[[int, str, bytes, dict], Iterator[tuple]], arrow: list[tuple[str, pa.DataType]], columns: Collection[str] = tuple(_NAMES)) -> DataFrame:
    """Run ``rows(doc_id, language, raw, columns)`` over trees that have been parsed before, from a table of them, say.

    Only the named columns of nodes are read and sent to Python, each as an array of its own.
    """
    small_batches(trees_.sparkSession)
    columns = list(columns)

    def run(batches):
        names = [n for n, _ in arrow]
        for b in batches:
            out: list[list] = [[] for _ in arrow]
            ids, langs, raws = (b.column(i).to_pylist() for i in range(3))
            lists = {n: b.column(3 + k) for k, n in enumerate(columns)}
            there = lists[columns[0]].is_valid().to_pylist()
            ends = {n: x.offsets.to_pylist() for n, x in lists.items()}
            first = ends[columns[0]]
            at = 0
            while at < len(ids):
                # Documents of so many nodes together, one at least, are turned into lists at once.
                to = at + 1
                while to < len(ids) and first[to + 1] - first[at] <= 50_000:
                    to += 1
                values = {n: _values(x.values[ends[n][at] : ends[n][to]]) for n, x in lists.items()}
                for k in range(at, to):
                    if not there[k]:
                        continue
                    a, z = first[k] - first[at], first[k + 1] - first[at]
                    for row in rows(ids[k], langs[k], raws[k], {n: x[a:z] for n, x in values.items()}):
                        for col, v in zip(out, row):
                            col.append(v)
                at = to
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, arrow)], names)

    return trees_.select("doc_id", "language", "raw", *(F.col(f"nodes.{n}").alias(n) for n in columns)).mapInArrow(run, schema)


def _values(a: pa.Array) -> list:
    """The array's values, without an object of Arrow for each."""
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        d = a.dictionary_encode()
        words = [*d.dictionary.to_pylist(), None]
        return [words[i] for i in d.indices.fill_null(len(words) - 1).to_numpy().tolist()]
    values = a.fill_null(False if pa.types.is_boolean(a.type) else 0).to_numpy(zero_copy_only=False).tolist()
    return values if not a.null_count else [x if ok else None for x, ok in zip(values, a.is_valid().to_numpy(zero_copy_only=False).tolist())]


def parse_errors(sources: DataFrame) -> DataFrame:
    """(doc_id, language, error) of sources that can't be parsed."""
    return normal(sources).where("error is not null").select("doc_id", "language", "error")


def slice_text(text: Column | str, start: Column, end: Column) -> Column:
    """Text of a byte range; null where the range is outside the text or cuts a character."""
    raw = F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")
    part = raw.substr(start.cast("int") + 1, (end - start).cast("int"))
    ok = (start >= 0) & (start <= end) & (end <= F.octet_length(raw))
    return F.when(ok & F.is_valid_utf8(part.cast("string")), part.cast("string"))


def slice_raw(start: Column, end: Column) -> Column:
    """The same of a tree's ``raw`` bytes, which needs no encoding of the whole text."""
    part = F.col("raw").substr(start.cast("int") + 1, (end - start).cast("int"))
    ok = (start >= 0) & (start <= end) & (end <= F.octet_length("raw"))
    return F.when(ok & F.is_valid_utf8(part.cast("string")), part.cast("string"))


def register_table_function(spark: SparkSession) -> None:
    """``parse_nodes(text, language)`` in SQL: one row for each node."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=", ".join(f"{n} {t}" for n, t in S.TREE_FIELDS))
    class ParseNodes:
        def __init__(self):
            self.known = _parsers()

        def eval(self, text: str, language: str):
            lang = R.resolve_alias(language) if language is not None else None
            if text is None or lang not in self.known:
                return
            c = parse_one(lang, text.encode(), self.known)
            yield from zip(*(c[n] for n in _NAMES))

    spark.udtf.register("parse_nodes", ParseNodes)


assert set(_NAMES) == set(COLUMNS)
