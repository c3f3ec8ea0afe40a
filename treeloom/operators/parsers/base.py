"""Nodes, and their layout as rows.

Parsers read bytes as Latin-1, one character a byte, so positions are byte
positions throughout.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Collection


class Node:
    """One node of a concrete syntax tree. Anonymous nodes are punctuation and keywords."""

    __slots__ = ("kind", "named", "start", "end", "field", "children", "missing")

    def __init__(self, kind: str, start: int, end: int, children: list[Node] | None = None, named: bool = True, field: str | None = None, missing: bool = False):
        self.kind, self.start, self.end, self.named, self.field, self.missing = kind, start, end, named, field, missing
        self.children = children if children is not None else []

    def at(self, field: str) -> Node:
        self.field = field
        return self

    def child(self, field: str) -> Node | None:
        return next((c for c in self.children if c.field == field), None)


def inner(kind: str, children: list[Node], field: str | None = None) -> Node:
    """A named node around its children."""
    return Node(kind, children[0].start, children[-1].end, children, field=field)


def place_extras(root: Node, extras: list[Node]) -> None:
    """Put comments (in order) into the deepest nodes around them, between the children they lie between."""
    for e in extras:
        node = root
        while True:
            nxt = None
            lo, hi = 0, len(node.children)
            while lo < hi:
                mid = (lo + hi) // 2
                if node.children[mid].start > e.start:
                    hi = mid
                else:
                    lo = mid + 1
            if lo and node.children[lo - 1].start <= e.start and node.children[lo - 1].end >= e.end and node.children[lo - 1].children:
                nxt = node.children[lo - 1]
            if nxt is None:
                node.children.insert(lo, e)
                break
            node = nxt


COLUMNS = ("node_id", "parent_id", "last_desc_id", "sib_idx", "named_sib_idx", "depth", "field_name", "kind", "is_named", "start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col", "named_child_count", "is_error", "is_missing")


#: Columns that a node says without its parent.
_OWN = {
    "kind": lambda nodes: [x.kind for x in nodes], "is_named": lambda nodes: [x.named for x in nodes], "field_name": lambda nodes: [x.field for x in nodes], "start_byte": lambda nodes: [x.start for x in nodes],
    "end_byte": lambda nodes: [x.end for x in nodes], "is_error": lambda nodes: [x.kind == "ERROR" for x in nodes], "is_missing": lambda nodes: [x.missing for x in nodes], "node_id": lambda nodes: list(range(len(nodes))),
}


def flatten(root: Node, data: bytes, wanted: Collection[str] | None = None) -> dict[str, list]:
    """Columns of the node table in pre-order, the ``wanted`` ones or all; no recursion, so depth doesn't matter."""
    if wanted is not None:
        if not all(n in _OWN or n in ("depth", "parent_id") for n in wanted):
            every = flatten(root, data)
            return {n: every[n] for n in wanted}
        nodes, parents, depths, stack = [], [], [], [(root, None, 0)]
        while stack:
            node, parent, depth = stack.pop()
            if node.children:
                n = len(nodes)
                stack += [(c, n, depth + 1) for c in node.children[::-1]]
            nodes.append(node)
            parents.append(parent)
            depths.append(depth)
        placed = {"depth": depths, "parent_id": parents}
        return {n: placed[n] if n in placed else _OWN[n](nodes) for n in wanted}
    begins = [0]
    at = data.find(b"\n")
    while at >= 0:
        begins.append(at + 1)
        at = data.find(b"\n", at + 1)
    one_line = len(begins) == 1
    nodes: list[Node] = []
    parents: list[int | None] = []
    last: list[int] = []
    sibs: list[int] = []
    named_sibs: list[int | None] = []
    depths: list[int] = []
    stack: list[tuple[Node | None, int | None, int, int, int]] = [(root, None, 0, 0, 0)]
    pop, push = stack.pop, stack.append
    n = 0
    while stack:
        node, parent, sib, named_sib, depth = pop()
        if node is None:  # all of the subtree of ``parent`` is out
            last[parent] = n - 1
            continue
        nodes.append(node)
        parents.append(parent)
        last.append(n)
        sibs.append(sib)
        named_sibs.append(named_sib if node.named else None)
        depths.append(depth)
        children = node.children
        if children:
            push((None, n, 0, 0, 0))
            depth += 1
            if len(children) == 1:
                push((children[0], n, 0, 0, depth))
            else:
                named = sum(c.named for c in children)
                for k in range(len(children) - 1, -1, -1):
                    c = children[k]
                    named -= c.named
                    push((c, n, k, named, depth))
        n += 1
    start, end = [x.start for x in nodes], [x.end for x in nodes]
    if one_line:
        r1 = r2 = [0] * n
        c1, c2 = start, end
    else:
        r1, r2 = [bisect_right(begins, x) - 1 for x in start], [bisect_right(begins, x) - 1 for x in end]
        c1, c2 = [x - begins[r] for x, r in zip(start, r1)], [x - begins[r] for x, r in zip(end, r2)]
    kind = [x.kind for x in nodes]
    count = [0] * n
    for p, x in zip(parents, nodes):
        if p is not None and x.named:
            count[p] += 1
    return {
        "node_id": list(range(n)), "parent_id": parents, "last_desc_id": last, "sib_idx": sibs, "named_sib_idx": named_sibs, "depth": depths, "field_name": [x.field for x in nodes], "kind": kind, "is_named": [x.named for x in nodes],
        "start_byte": start, "end_byte": end, "start_row": r1, "start_col": c1, "end_row": r2, "end_col": c2, "named_child_count": count, "is_error": [k == "ERROR" for k in kind], "is_missing": [x.missing for x in nodes],
    }


def sexp(cols: dict[str, list]) -> str:
    """S-expression of the named nodes with field labels; missing nodes show as such."""
    out: list[str] = []
    ends: list[int] = []
    for i, (named, missing, field, kind, last) in enumerate(zip(cols["is_named"], cols["is_missing"], cols["field_name"], cols["kind"], cols["last_desc_id"])):
        while ends and ends[-1] < i:
            out.append(")")
            ends.pop()
        if not (named or missing):
            continue
        if missing:
            kind = f"MISSING {kind}" if named else f'MISSING "{kind}"'
        out.append(f"{' ' if out else ''}{field}: ({kind}" if field else f"{' ' if out else ''}({kind}")
        ends.append(last)
    return "".join(out) + ")" * len(ends)
