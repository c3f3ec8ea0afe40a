"""Chunking of sources by bytes, at the boundaries that the syntax offers.

Where to cut is a sequential fold, so it runs in the worker beside the parse,
one document at a time; what is in the chunks (lines, node kinds, names,
comments) is gathered in one sweep over the nodes there too.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import slice_raw, trees

DEFINITIONS = frozenset(
    "class_declaration class_definition enum_declaration enum_item function_declaration function_definition function_item impl_item method_declaration method_definition struct_definition struct_item trait_item".split()
)
NOTES = frozenset(("comment", "line_comment", "block_comment"))


def split_at_bytes(text: bytes, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """Cuts every ``most`` bytes, moved back to the begin of a character but at least one character on."""
    out = []
    while lo < hi:
        cut = min(lo + most, hi)
        if cut < hi:
            while cut > lo and text[cut] & 0xC0 == 0x80:
                cut -= 1
            if cut == lo:
                cut = lo + 1
                while cut < hi and text[cut] & 0xC0 == 0x80:
                    cut += 1
        out.append((lo, cut))
        lo = cut
    return out


def split_at_lines(text: bytes, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """Lines merged while they fit; a longer line is cut by bytes."""
    out, begin, at = [], lo, lo
    while at < hi:
        nl = text.find(b"\n", at, hi)
        end = nl + 1 if nl >= 0 else hi
        if end - begin > most:
            if at > begin:
                out.append((begin, at))
                begin = at
            if end - begin > most:
                out += split_at_bytes(text, begin, end, most)
                begin = end
        at = end
    if begin < hi:
        out.append((begin, hi))
    return out


def split_code(text: bytes, starts_by_depth: dict[int, list[int]], most: int) -> list[tuple[int, int]]:
    """Byte ranges of at most ``most`` bytes that cover the text.

    At each depth the farthest node begin that fits ends a chunk; what is longer
    goes down a depth, then to lines, then to bytes. The order of work is kept
    on a stack, so depth doesn't matter.
    """
    if not text or most <= 0:
        return []
    if len(text) <= most:
        return [(0, len(text))]
    deepest = max(starts_by_depth, default=0)
    marks = {d: sorted(set(v)) for d, v in starts_by_depth.items()}
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 1)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo <= most:
            out.append((lo, hi))
            continue
        while depth <= deepest:
            m = marks.get(depth, [])
            inside = m[bisect_right(m, lo) : bisect_left(m, hi)]
            if inside:
                break
            depth += 1
        else:
            out += split_at_lines(text, lo, hi, most)
            continue
        parts, begin, ends = [], lo, [*inside, hi]
        k = 0
        while begin < hi:
            j = bisect_right(ends, begin + most) - 1
            if j >= k and ends[j] > begin:
                parts.append((begin, ends[j], depth))
                begin, k = ends[j], j + 1
            else:  # the next section is too long by itself
                nxt = bisect_right(ends, begin)
                parts.append((begin, ends[nxt], depth + 1))
                begin, k = ends[nxt], nxt + 1
        stack.extend(reversed(parts))
    return out


def starts_by_depth(c: dict[str, list]) -> dict[int, list[int]]:
    """Begins of a document's nodes by depth, the root left out."""
    by: dict[int, list[int]] = {}
    for depth, start in zip(c["depth"], c["start_byte"]):
        if depth:
            by.setdefault(depth, []).append(start)
    return by


def described(c: dict[str, list], raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges with their lines, and what the nodes (with links) that overlap or lie within each of them tell."""
    out, line, at = [], 0, 0
    for a, b in ranges:
        inner = raw.count(b"\n", a, b)
        line += raw.count(b"\n", at, a)
        out.append({"start_byte": a, "end_byte": b, "start_line": line, "end_line": line + inner, "node_types": [], "context_path": [], "symbols_defined": [], "comments": [], "has_error_nodes": False})
        line, at = line + inner, b
    ends = [b for _, b in ranges]
    kind, start, end, parent, last = c["kind"], c["start_byte"], c["end_byte"], c["parent_id"], c["last_desc_id"]
    text = lambda i: raw[start[i] : end[i]].decode("utf-8", "replace")

    def name_of(i: int) -> int | None:
        if c["name_id"][i] is not None:
            return c["name_id"][i]
        fields: dict[str, int] = {}
        j = i + 1
        while j <= last[i]:
            fields.setdefault(c["field_name"][j], j)
            j = last[j] + 1
        return fields.get("declarator", fields.get("binding"))

    for i in range(len(kind)):
        bad, top = c["is_error"][i] or c["is_missing"][i], c["depth"][i] <= 1
        defined, note = kind[i] in DEFINITIONS, kind[i] in NOTES
        if not (bad or top or defined or note):
            continue
        name = name_of(i) if defined else None
        k = bisect_right(ends, start[i])
        while k < len(out) and out[k]["start_byte"] < end[i]:
            r = out[k]
            k += 1
            within = r["start_byte"] <= start[i] and end[i] <= r["end_byte"]
            if top and within and kind[i] not in r["node_types"]:
                r["node_types"].append(kind[i])
            if bad:
                r["has_error_nodes"] = True
            if name is not None:
                r["symbols_defined"].append(text(name))
                if start[i] < r["start_byte"]:
                    r["context_path"].append(text(name))
            if note and within:
                t = text(i)
                after = c["next_named_id"][i]
                what = "Block" if kind[i] == "block_comment" else "Doc" if t.startswith(("///", "//!", "/**", "/*!")) else "Line"
                where = dict(zip(("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column"), (c[f][i] for f in ("start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col"))))
                r["comments"].append({"text": t, "kind": what, "span": where, "associated_node": None if after is None else kind[after]})
    return out


def chunk_ranges(sources: DataFrame, most: int) -> DataFrame:
    """doc_id, language, raw, text, ranges: sources with their chunks' byte ranges and what is in them."""
    return trees(sources, chunk_max_size=most, want_nodes=False).drop("nodes", "sexp", "extractions")


def chunk_plain(sources: DataFrame, most: int) -> DataFrame:
    """(doc_id, chunk_index, start_byte, end_byte) of texts without syntax: lines, then bytes."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<struct<start_byte:bigint,end_byte:bigint>>")
    def cut(s):
        return s.map(lambda t: [{"start_byte": a, "end_byte": b} for a, b in split_code(t.encode(), {}, most)] if t is not None else None)

    return sources.select("doc_id", F.posexplode(cut(F.col("text").cast("string"))).alias("chunk_index", "r")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "r.start_byte", "r.end_byte")


def chunks(with_ranges: DataFrame) -> Column:
    """The chunk structs of a row of ``chunk_ranges``, or of trees with ranges."""
    total = F.size("ranges").cast("long")

    def chunk(r: Column, i: Column) -> Column:
        meta = F.struct(
            F.col("language").alias("language"), i.cast("long").alias("chunk_index"), total.alias("total_chunks"), r.node_types.alias("node_types"), r.context_path.alias("context_path"), r.symbols_defined.alias("symbols_defined"),
            r.comments.alias("comments"), F.array().cast("array<string>").alias("docstrings"), r.has_error_nodes.alias("has_error_nodes"),
        )
        return F.struct(slice_raw(r.start_byte, r.end_byte).alias("content"), r.start_byte.alias("start_byte"), r.end_byte.alias("end_byte"), r.start_line.alias("start_line"), r.end_line.alias("end_line"), meta.alias("metadata"))

    return F.transform("ranges", chunk)


def chunk_table(sources: DataFrame, most: int) -> DataFrame:
    """One row for each chunk of each source."""
    t = chunk_ranges(sources, most)
    return t.select("doc_id", F.explode(chunks(t)).alias("c")).select("doc_id", "c.*")
