"""HTML: exact concrete syntax with implied end tags, raw text and entities."""

from __future__ import annotations

import re

from .base import Node

VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source track wbr".split())
_NAME = re.compile(r"[A-Za-z0-9:_.-]+")
_ATTR = re.compile(r"[^<>\"'/=\s]+")
_UNQUOTED = re.compile(r"[^<>\"'=\s]+")
_SPACE = re.compile(r"\s*")
_ENTITY = re.compile(r"&(?:#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,5})|[A-Za-z]{1,30});?")
_TEXT = re.compile(r"[^<>&\s](?:[^<>&]*[^<>&\s])?")
#: Block tags that a paragraph can't hold.
_NOT_IN_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "rb": {"rb", "rt"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}


def _leaf(text: str, a: int) -> Node:
    return Node(text, a, a + len(text), named=False)


def _tag(s: str, i: int) -> tuple[Node, int, str, bool]:
    """Start tag at ``<``: node, position behind it, lower-case name, whether it closes itself."""
    m = _NAME.match(s, i + 1)
    kids = [_leaf("<", i), Node("tag_name", m.start(), m.end())]
    j, n = m.end(), len(s)
    while True:
        j = _SPACE.match(s, j).end()
        if j >= n:
            kids.append(Node(">", kids[-1].end, kids[-1].end, named=False, missing=True))
            return Node("start_tag", i, kids[-1].end, kids), j, m[0].lower(), False
        if s.startswith("/>", j):
            kids.append(_leaf("/>", j))
            return Node("self_closing_tag", i, j + 2, kids), j + 2, m[0].lower(), True
        if s[j] == ">":
            kids.append(_leaf(">", j))
            return Node("start_tag", i, j + 1, kids), j + 1, m[0].lower(), False
        if s[j] == "<":
            kids.append(Node(">", kids[-1].end, kids[-1].end, named=False, missing=True))
            return Node("start_tag", i, kids[-1].end, kids), j, m[0].lower(), False
        a = _ATTR.match(s, j)
        if not a:
            kids.append(Node("ERROR", j, j + 1, [_leaf(s[j], j)]))
            j += 1
            continue
        parts = [Node("attribute_name", a.start(), a.end())]
        j = a.end()
        k = _SPACE.match(s, j).end()
        if k < n and s[k] == "=":
            parts.append(_leaf("=", k))
            k = _SPACE.match(s, k + 1).end()
            if k < n and s[k] in "\"'":
                q = s.find(s[k], k + 1)
                e = q if q >= 0 else n
                inner = [_leaf(s[k], k)] + ([Node("attribute_value", k + 1, e)] if e > k + 1 else [])
                inner.append(_leaf(s[k], e) if q >= 0 else Node(s[k], e, e, named=False, missing=True))
                parts.append(Node("quoted_attribute_value", k, inner[-1].end, inner))
            elif u := _UNQUOTED.match(s, k):
                parts.append(Node("attribute_value", u.start(), u.end()))
            j = parts[-1].end
        kids.append(Node("attribute", parts[0].start, parts[-1].end, parts))


def parse(data: bytes) -> Node:
    s = data.decode("latin-1")
    low = s.lower()
    root = Node("document", 0, len(s))
    stack: list[tuple[Node, str]] = [(root, "")]
    i, n = 0, len(s)

    def add(node: Node) -> None:
        stack[-1][0].children.append(node)

    def shut(end: int) -> None:
        node, _ = stack.pop()
        node.end = end if end > node.end else node.end
        if node.children:
            node.end = max(node.end, node.children[-1].end)

    while i < n:
        c = s[i]
        if c.isspace():
            i += 1
        elif c == "<":
            if s.startswith("<!--", i):
                e = s.find("-->", i + 4)
                e = e + 3 if e >= 0 else n
                add(Node("comment", i, e))
                i = e
            elif low.startswith("<!doctype", i):
                e = s.find(">", i)
                kids = [_leaf("<!", i), Node("doctype", i + 2, i + 9, named=False), _leaf(">", e) if e >= 0 else Node(">", n, n, named=False, missing=True)]
                add(Node("doctype", i, kids[-1].end, kids))
                i = kids[-1].end
            elif s.startswith("</", i) and (m := _NAME.match(s, i + 2)):
                e = s.find(">", m.end())
                stop = e + 1 if e >= 0 and "<" not in s[m.end() : e] else m.end()
                kids = [_leaf("</", i), Node("tag_name", m.start(), m.end())]
                kids.append(_leaf(">", stop - 1) if stop > m.end() else Node(">", stop, stop, named=False, missing=True))
                name = m[0].lower()
                if any(x == name for _, x in stack[1:]):
                    while stack[-1][1] != name:
                        shut(i if not stack[-1][0].children else 0)
                    add(Node("end_tag", i, stop, kids))
                    shut(stop)
                else:
                    kids[1].kind = "erroneous_end_tag_name"
                    add(Node("erroneous_end_tag", i, stop, kids))
                i = stop
            elif _NAME.match(s, i + 1) and s[i + 1 : i + 2].isalpha():
                tag, j, name, closed = _tag(s, i)
                close, scope = _CLOSES.get(name, set()), _SCOPE.get(name, set())
                while len(stack) > 1 and (stack[-1][1] in close and stack[-1][1] not in scope or stack[-1][1] == "p" and name in _NOT_IN_P):
                    shut(0)
                if closed or name in VOID:
                    add(Node("element", tag.start, tag.end, [tag]))
                elif name in ("script", "style"):
                    e = low.find(f"</{name}", j)
                    e = e if e >= 0 else n
                    kids = [tag] + ([Node("raw_text", j, e)] if e > j else [])
                    if e < n:
                        g = s.find(">", e)
                        g = g + 1 if g >= 0 else n
                        kids.append(Node("end_tag", e, g, [_leaf("</", e), Node("tag_name", e + 2, e + 2 + len(name)), _leaf(">", g - 1)]))
                    add(Node(f"{name}_element", i, kids[-1].end, kids))
                    j = kids[-1].end
                else:
                    el = Node("element", i, tag.end, [tag])
                    add(el)
                    stack.append((el, name))
                i = j
            else:
                add(Node("ERROR", i, i + 1, [_leaf("<", i)]))
                i += 1
        elif m := (_ENTITY.match(s, i) if c == "&" else None):
            add(Node("entity", i, m.end()))
            i = m.end()
        elif m := _TEXT.match(s, i):
            add(Node("text", i, m.end()))
            i = m.end()
        else:
            add(Node("ERROR" if c == ">" else "text", i, i + 1))
            i += 1
    while len(stack) > 1:
        shut(0)
    return root
